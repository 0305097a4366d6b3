"""Readers and sinks on small files, the stream, statistics and the oracles at the smallest scale."""

import math
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from motifspark import queries
from motifspark.operators import stats
from motifspark.operators.kernel import Background, Pwm, Scorer
from motifspark.plans import commands
from motifspark.sources import readers, sinks
from motifspark.streaming import fasta_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


def test_fasta(spark, put):
    path = put("a.fa", "preamble\n>  s1 some words\r\nACGT\r\nac gt\r\n>s2\nTT\n>s3\n")
    rows = [(r.seq_id, r.header, r.seq, r.n) for r in readers.read_fasta(spark, path, preamble=True).orderBy("seq_idx").collect()]
    assert rows == [("s1", "s1 some words", "ACGTacgt", 8), ("s2", "s2", "TT", 2), ("s3", "s3", "", 0)]
    assert readers.read_fasta(spark, path, ["s2"]).count() == 1
    assert readers.read_fasta_reverse_complement(spark, path).where("seq_id = 's1'").first().seq == "acgtACGT"


def test_matrices(spark, put):
    path = put("p.txt", "> M1\n=\t1\t1\t1\t1\n=\t0\t2\t0\t0\n\n\n> M2\n=\t3\t1\t0\t0")
    lib = readers.read_pwms(spark, path, 0.5)
    assert [(p.pwm_id, len(p.mat)) for p in lib] == [("M1", 2), ("M2", 1)]
    assert np.allclose(lib[0].mat[1], [0.125, 0.625, 0.125, 0.125])
    assert readers.read_pwm(spark, path, "m2") == [[3, 1, 0, 0]] and readers.read_pwm(spark, path, "zz") is None
    assert [p.pwm_id for p in readers.read_pwms(spark, path, included=["M2"])] == ["M2"]
    assert readers.read_pwms(spark, put("t.txt", "> x AC=M00001 y\n=\t1\t1\t1\t1\n"), transfac=True)[0].pwm_id == "M00001"
    with pytest.raises(ValueError):
        readers.read_pwms(spark, put("d.txt", "> a\n=\t1\t1\t1\t1\n\n> a\n=\t1\t1\t1\t1\n"))
    groups = readers.read_site_groups(spark, put("s.txt", ">g1\nACG\nAXT\n\n>g2\nTT\n"))
    counts = {(r.pwm_id, r.pos): (r.a, r.c, r.g, r.t) for r in readers.count_matrices(groups).collect()}
    assert counts == {("g1", 0): (2, 0, 0, 0), ("g1", 1): (0, 1, 0, 0), ("g1", 2): (0, 0, 1, 1), ("g2", 0): (0, 0, 0, 1), ("g2", 1): (0, 0, 0, 1)}
    assert sinks.pwm_lines([Pwm(0, "M", [[0.125, 0.5, 0.25, 0.12345]])]) == ["> M", "=\t0.1250\t0.5000\t0.2500\t0.1235" if f"{0.12345:.4f}" == "0.1235" else "=\t0.1250\t0.5000\t0.2500\t0.1234", ""]
    assert sinks.wmm_lines(Pwm(0, "M", [[1.0, 0.0, 0.5, 0.5]]))[0].split("\t")[1::3] == ["-inf", "-inf"]


def test_columns(spark, put):
    rows = readers.read_double_column(spark, put("c.txt", "a 1.5\nb\t-2\n\n"), ["b"]).collect()
    assert [(r.row_idx, r.label, r.value) for r in rows] == [(1, "b", -2.0)]
    roe = readers.read_roe(spark, put("r.table", "MaxPeakLoc\tHalfWidth\tLeft\tRight\nA\t-3\t8.5\t-11\t6\nB\tNA\tNA\tNA\tNA\n"), "FWD").orderBy("row_idx").collect()
    assert (roe[0].max_peak_loc, roe[0].half_width, roe[1].max_peak_loc) == (-3.0, 8.5, None)
    lists = readers.read_label_lists(spark, put("l.txt", "x\t,a,b,\ny\tc\n"), ",").orderBy("row_idx").collect()
    assert [r["items"] for r in lists] == [["a", "b"], ["c"]]
    isl = {r.name: [(i.x, i.y) for i in r.islands] for r in readers.read_islands(spark, put("i.txt", "head\nn 1,2 3,4\nn 5,6\n")).collect()}
    assert isl == {"n": [(5, 6)]}
    draws = readers.read_draws(spark, put("d.txt", "\tf1\nid_a_Chr1_674_-12\t0.5\n")).collect()
    assert [(r.label, r.pos) for r in draws] == [("id_a_Chr1_674", -12)]
    assert readers.read_vector(spark, put("v.txt", "0.1\n0.2\n")) == [0.1, 0.2]
    assert readers.read_matrix(spark, put("m.txt", "1 2\n3\t4\n")) == [[1, 2], [3, 4]]


def test_intervals_and_histograms(spark, put, tmp_path):
    tiles = readers.read_open_tiles(spark, put("leaf", "s1\tx\tChr1\ta\tb\t-5\t9\n"), put("root", "s2\tx\tChr2\ta\tb\t1\t2\n"))
    assert sorted((r.seq_id, r.tissue, r.start, r.end) for r in tiles.collect()) == [("s1", "LEAF", -5, 9), ("s2", "ROOT", 1, 2)]
    put("L/s1_0.overlap", "a%W_1\tx\tChr1\ta\tb\t-5\t9\n")
    put("R/s2_0.overlap", "a%W_2\tx\tChr1\ta\tb\t0\t1\n")
    wins = readers.read_open_windows(spark, str(tmp_path / "L"), str(tmp_path / "R"))
    assert sorted((r.seq_id, r.feature_id, r.tissue) for r in wins.collect()) == [("s1", "W_1", "LEAF"), ("s2", "W_2", "ROOT")]
    put("H/M.hbin", "0,-5,0\t0.6\n1,0,5\t0.4\n\n0,-5,0\t0.1\n1,0,5\t0.9\n")
    hist = readers.read_histograms(spark, str(tmp_path / "H"))
    assert sorted((r.kind, r.lb, r.height) for r in hist.collect()) == [("BG", -5.0, 0.6), ("BG", 0.0, 0.4), ("FG", -5.0, 0.1), ("FG", 0.0, 0.9)]
    row = ["x"] * 16 + ["M", "REV"] + ["x"] * 8 + ["AAC", "ttgg"]
    sites = readers.read_sites(spark, put("sites", "\t".join(["h"] * 28) + "\n" + "\t".join(row) + "\n"))
    lib = readers.pwm_table(spark, [Pwm(0, "M", [[0.1, 0.2, 0.3, 0.4]] * 3)])
    got = stats.site_statistics(sites, lib, hist).first()
    b = stats.SITE_BACKGROUND
    want = math.log(0.3) + 2 * math.log(0.4) - math.log(b[2]) - math.log(b[2]) - math.log(b[3])
    assert got.motif_rc == "GTT" and got.flank_rc == "GGTT" and math.isclose(got.score, want)
    assert math.isclose(got.fp, 0.0, abs_tol=1e-12) and math.isclose(got.fn, 1.0)
    null = spark.createDataFrame([("ANC",)], "m string").select(stats.lagged_score(F.col("m"), F.array(*[F.lit(0.25)] * 12)).alias("s"))
    assert null.first().s is None


def test_sinks(spark, tmp_path):
    hits = spark.createDataFrame([("FWD", 0, "M", 0, "s0", 3, 1.0625), ("FWD", 0, "M", 0, "s0", -4, 2.0), ("FWD", 0, "M", 1, "s1", 0, 0.5)], "strand string, pwm_idx int, pwm_id string, seq_idx long, seq_id string, loc long, score double")
    assert [r.line for r in sinks.hit_lines(hits).collect()] == [">\tM\t2", "s0\t-4\t3", "s1\t0"]
    assert [r.line for r in sinks.hit_lines(hits, "scores").collect()] == [">\tM\t2", "s0\t2.000\t1.062", "s1\t0.500"]
    sinks.write_hits(hits, str(tmp_path / "h"))
    assert (tmp_path / "h.scores" / "strand=FWD").exists()
    curve = hits.select("strand", "pwm_id", "loc", F.col("score").alias("cumscore"))
    pwms = spark.createDataFrame([(0, "M")], "pwm_idx int, pwm_id string")
    line = sinks.curve_lines(curve, pwms).first()
    assert (line.locs, line.cumscores) == ("M\t-4\t0\t3", "M\t2.00\t0.50\t1.06")
    sinks.write_curves(curve, pwms, str(tmp_path / "c"))
    back = readers.read_curves(spark, str(tmp_path / "c.locs" / "strand=FWD"), str(tmp_path / "c.cumscores" / "strand=FWD"), "FWD")
    assert sorted((r["loc"], r.cumscore) for r in back.collect()) == [(-4, 2.0), (0, 0.5), (3, 1.06)]
    roe = spark.createDataFrame([(0, "A", -3, 8.5, -11, 6), (1, "B", None, None, None, None)], "row_idx int, pwm_id string, max_peak_loc int, half_width double, left int, right int")
    assert [r.line for r in sinks.roe_lines(roe).collect()] == ["MaxPeakLoc\tHalfWidth\tLeft\tRight", "A\t-3\t8.5\t-11\t6", "B\tNA\tNA\tNA\tNA"]
    wide = spark.createDataFrame([("s0_0", 1.5, 0.0), ("s1_0", 0.0, 2.0)], "sample string, f1 double, feature2 double").coalesce(1)
    data = b"".join(bytes(r.data) for r in sinks.binary_matrix(wide).orderBy("part").collect())
    assert data[:2] == b"!!" and struct.unpack(">iiqi", data[2:22]) == (2, 2, 2, 9) and data[22:34] == b"\x02f1\x08feature2"
    assert data.endswith(b"\x04s1_0" + struct.pack(">2d", 0, 2) + b"!!!!")
    sinks.write_wide(wide, str(tmp_path / "w"))
    bg = Background("global", [0.25, 0.25, 0.3, 0.2], [[0.25] * 4] * 4)
    assert sinks.background_lines(bg)["M0"] == ["0.2500", "0.2500", "0.3000", "0.2000"] and sinks.background_lines(bg)["M1"][0].endswith(" ")
    sinks.write_lines(spark, ["b", "a"], str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["b", "a"]
    seqs = spark.createDataFrame([(0, "s", "ACGTA")], "seq_idx long, seq_id string, seq string")
    assert [r.line for r in sinks.fasta_lines(seqs, 2).collect()] == [">s", "AC", "GT", "A"]


def test_stream(spark, put, tmp_path):
    put("in/a.fa", ">s1\nAACAAA\n>s2\nCCC\n")
    scorer = Scorer([Pwm(0, "A", [[1.0, 0, 0, 0]] * 2)], strands=("FWD",))
    q = fasta_stream.stream_hits(spark, str(tmp_path / "in"), scorer).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    put("in/b.fa", ">s3\nAA\n")
    q.processAllAvailable()
    q.stop()
    assert sorted((r.seq_id, r["loc"]) for r in spark.table("hits").collect()) == [("s1", -6), ("s1", -3), ("s1", -2), ("s3", -2)]


def test_commands(spark):
    with pytest.raises(ValueError):
        commands.strands_of("UP")
    assert commands.local(0).kind == "equal"
    cut = stats.thresholds(spark, [Pwm(0, "A", [[0.7, 0.1, 0.1, 0.1]] * 4)], Background("global", [0.25] * 4), samples=4000)
    value = cut.first().cutoff
    assert math.log(0.1 / 0.25) * 4 <= value <= math.log(0.7 / 0.25) * 4 + 1e-9
    with pytest.raises(ValueError):
        stats.thresholds(spark, [], Background(), kind="X")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_oracle(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "events", "nation", "part"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(queries.ORACLES[name]).df()
        text = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy()))
        assert sorted(got.columns) == sorted(want.columns) and text(got) == text(want)


@pytest.fixture
def whole_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small files stay several
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_fasta_records_are_not_cut_by_the_ends_of_files(spark, tmp_path, whole_partitions):
    seqs = spark.createDataFrame([(i, f"s{i}", "ACGT" * 500) for i in range(3)], "seq_idx long, seq_id string, seq string")
    sinks.fasta_lines(seqs.repartition(3), 10).select("line").write.text(f"{tmp_path}/f")
    assert sorted((r.seq_id, r.seq) for r in readers.read_fasta(spark, f"{tmp_path}/f").collect()) == [(f"s{i}", "ACGT" * 500) for i in range(3)]


def test_fasta_reverse_complements_of_records_in_several_files(spark, tmp_path, whole_partitions):
    seqs = spark.createDataFrame([(i, f"s{i}", "AACG" * 500) for i in range(3)], "seq_idx long, seq_id string, seq string")
    sinks.fasta_lines(seqs.repartition(3), 10).select("line").write.text(f"{tmp_path}/f")
    assert sorted((r.seq_id, r.seq) for r in readers.read_fasta_reverse_complement(spark, f"{tmp_path}/f").collect()) == [(f"s{i}", "CGTT" * 500) for i in range(3)]


@pytest.mark.parametrize("name", ["fasta_file", "fasta_reverse_file"])
def test_fasta_queries_under_a_limit_of_rows_per_file(spark, tmp_path, name):
    from motifspark import format_queries  # registers its queries

    texts = ["Some words " * 40, None, "", "12 34", "x" * 80, "Zyx" * 100, "Some words " * 40]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "2")
    try:
        got = sorted(map(tuple, getattr(format_queries, name)(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(queries.ORACLES[name]).fetchall())


def test_write_fasta_keeps_order_and_text(spark, tmp_path):
    seqs = spark.createDataFrame([(i, f"s{i}", "ACGTA" * (i % 4)) for i in reversed(range(9))], "seq_idx long, seq_id string, seq string")
    sinks.write_fasta(seqs.repartition(3), str(tmp_path / "f"), 5)
    text = "".join(p.read_text() for p in sorted((tmp_path / "f").glob("part-*")))
    assert text.splitlines() == [r.line for r in sinks.fasta_lines(seqs.coalesce(1), 5).collect()]
