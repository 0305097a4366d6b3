"""Hits added up or written inside the tasks against the plain forms, over sequences in several pieces and rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifspark import queries
from motifspark.operators import background, features, scan
from motifspark.operators.kernel import Background, Pwm, Scorer
from motifspark.plans import commands, corpus, sql
from motifspark.sources import sinks

LIB = corpus.library(0.25)
WIDE = [*LIB, Pwm(2, "WIDE", [[0.4, 0.3, 0.2, 0.1]] * 13)]
BACKGROUNDS = [Background(), Background("global", [0.3, 0.2, 0.2, 0.3]), Background("local", window=20)]


@pytest.fixture(scope="module")
def seqs(spark):
    draw = random.Random(5)
    rows = [(i, f"s{i}", "".join(draw.choices("ACGTN", [9, 9, 9, 9, 1], k=n))) for i, n in enumerate([0, 3, 40, 41, 42, 700, 300])]
    return spark.createDataFrame([*rows, (6, "s6", "GATCACGATG" * 9)], "seq_idx long, seq_id string, seq string").repartition(3)


@pytest.mark.parametrize("library", [LIB, WIDE], ids=["words", "hits"])
@pytest.mark.parametrize("bg", BACKGROUNDS, ids=lambda b: b.kind)
@pytest.mark.parametrize("compat", [False, True])
def test_totals(spark, seqs, library, bg, compat):
    scorer = Scorer(library, bg, compat=compat)
    assert (scorer.by_word() is not None) == (library is LIB and bg.kind != "local")
    hits = scan.score_sites(seqs, scorer, piece=100)
    infinite = F.count_if(F.abs("score") == float("inf"))
    plain = hits.groupBy("strand", "pwm_id").agg(F.count("*"), infinite, F.count_distinct("seq_idx"), F.round(F.sum("score"), 6), F.min("loc"), F.max("loc"))
    found = scan.totals(scan.pieces(seqs, *scan.reach(scorer), 100), scorer)
    assert sorted(map(tuple, found.drop("pwm_idx").withColumn("total", F.round("total", 6)).collect())) == sorted(map(tuple, plain.collect()))
    curve = scan.curve(scan.pieces(seqs, *scan.reach(scorer), 100), scorer)
    rounded = lambda df: sorted(map(tuple, df.select("strand", "pwm_id", "loc", F.round("cumscore", 6)).collect()))
    assert rounded(curve) == rounded(features.cumulative_by_strand(hits))


def test_many_matrices_count_a_sequence_once(spark, seqs):
    library = [Pwm(i, f"m{i}", LIB[i % 2].mat) for i in range(70)]
    scorer = Scorer(library)
    found = {(r.strand, r.pwm_id): r.n_seqs for r in scan.totals(scan.pieces(seqs, 6, 0, 100), scorer).collect()}
    plain = {(r.strand, r.pwm_id): r.n_seqs for r in scan.header_counts(scan.score_sites(seqs, scorer)).collect()}
    assert found == plain and len(found) == 140


def test_scan_lines_and_files(spark, seqs, tmp_path):
    scorer = Scorer(LIB, BACKGROUNDS[1])
    own = seqs.where("seq NOT LIKE 'GATCACGATG%'")  # each number once, so that a line has one order
    cut = scan.pieces(own, *scan.reach(scorer), 100)
    hits = scan.score_sites(own, scorer, 0)
    for what in ("locations", "scores"):
        assert [tuple(r) for r in sinks.scan_lines(cut, scorer, what).collect()] == [tuple(r) for r in sinks.hit_lines(hits, what).collect()]
    sinks.write_hits(hits, f"{tmp_path}/a")
    sinks.write_scan(cut, scorer, f"{tmp_path}/b", compression="gzip")
    for what in ("locations", "scores"):
        a, b = ([tuple(r) for r in spark.read.text(f"{tmp_path}/{k}.{what}").select("strand", "value").collect()] for k in "ab")
        assert sorted(a) == sorted(b)


def test_hits_do_not_cross_an_exchange(spark, tmp_path):
    """The plans take no list of hits apart."""
    spark.createDataFrame([(i, "gatcacgatgatgc") for i in range(3)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 5), (2, 7)], "p_partkey long, p_size long").write.parquet(f"{tmp_path}/part.parquet")
    for name in ("hit_lines", "scan_library", "scan_masked", "scan_local_bg", "cum_score_local_bg"):
        assert "posexplode" not in queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_sql_totals(spark, seqs):
    scorer = Scorer(LIB)
    sql.open_scan(spark, seqs, LIB, name="added")
    got = spark.sql("SELECT strand, pwm_id, sum(h.n_hits) AS n, round(sum(h.total), 6) AS t FROM added_pieces p, LATERAL added_totals(p.n, p.offset, p.skip, p.own, p.piece) h GROUP BY ALL")
    plain = scan.score_sites(seqs, scorer, 0).groupBy("strand", "pwm_id").agg(F.count("*"), F.round(F.sum("score"), 6))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_sql_back_end_with_and_without_all_words(spark, seqs, few, monkeypatch):
    monkeypatch.setattr(scan, "FEW", few)
    scorer = Scorer(LIB, Background("global", [0.3, 0.2, 0.2, 0.3]))
    rounded = lambda df: sorted(map(tuple, df.withColumn("score", F.round("score", 8)).collect()))
    found = scan.score_sites_sql(seqs, scorer, 0)
    assert rounded(found) == rounded(scan.score_sites(seqs, scorer, 0))
    assert ("SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()) <= (few == 0)


def test_local_totals(spark, seqs):
    rows = background.local_frequencies(seqs.where("seq_idx < 6"), 20).where(F.exists("b1", lambda x: x.isNotNull()))
    sums = [F.round(F.sum(F.col(c)[k]), 6) for c, n in (("b", 4), ("b1", 16)) for k in range(n)]
    plain = rows.groupBy("seq_idx").agg(F.count("*"), *sums)
    found = background.local_totals(seqs.where("seq_idx < 6"), 20, 64)
    got = found.select("seq_idx", "n_places", *[F.round(F.col(c)[k], 6) for c, n in (("b", 4), ("b1", 16)) for k in range(n)])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("width", [6, 9])
def test_different_words(spark, seqs, width):
    texts = [r.seq for r in seqs.collect()]
    assert sorted(r.motif for r in scan.different_words(seqs, width).collect()) == sorted({t[i : i + width] for t in texts for i in range(len(t) - width + 1)})


def test_open_regions_of_every_window(spark, seqs):
    own = seqs.where("seq_idx < 6")
    intervals = spark.createDataFrame([("s5", "LEAF", -30, 40), ("s5", "LEAF", 20, 60), ("s5", "ROOT", 0, 9), ("s4", "LEAF", -9, 9)], "seq_id string, tissue string, start int, end int")
    from motifspark.operators import windows

    each = intervals.crossJoin(windows.roe_windows(corpus.regions(spark)).select("feature_id"))
    rounded = lambda x: sorted((r.seq_id, r.feature_id, r.tissue, round(r.value, 6)) for r in commands.open_regions(own, LIB, corpus.regions(spark), x, 20).collect())
    assert rounded(intervals) == rounded(each) != []


def test_lines_are_dealt_without_scores(spark, seqs):
    """Bounds come from the sequences' numbers and the counts of hits: with sampled ones every start was scored again for each file."""
    scorer = Scorer(LIB, BACKGROUNDS[1])
    assert scorer.by_word() is not None
    for what in ("locations", "scores"):
        lines = sinks.scan_lines(scan.pieces(seqs, *scan.reach(scorer), 100), scorer, what)
        assert "rangepartitioning" not in lines._jdf.queryExecution().executedPlan().toString()


def test_places_and_scores_as_numbers():
    rng = np.random.default_rng(1)
    scores = np.concatenate([rng.normal(0, 3, 20_000), [0.0005, 0.0015, 0.0625, 0.1875, -0.0625, -0.0004, -0.0, 0.0, 2.0005, np.inf, 123456.0625, -9.9995]])
    assert sinks._score_texts(scan.thousandths(scores)).to_pylist() == [f"{x:.3f}".replace("inf", "∞") for x in scores.tolist()]
    for top in (1, 254, 255, 256, 700, 70_000, 1 << 40):
        for n in (1, 2, 1000):
            values = rng.integers(-3, top, n, np.int64)
            assert (scan.unpacked(scan.packed(values)) == values).all()
            rising, cut = np.cumsum(np.abs(values % 5000) + 1), np.array([0, n // 2, n])
            low, high = cut[:-1][np.diff(cut) > 0], cut[1:][np.diff(cut) > 0]
            for a, b, places, ranks in zip(low, high, scan.packed_places(rising, low, high), scan.packed_slices(values % 900, low, high), strict=True):
                assert (scan.unpacked(places) == rising[a:b] - rising[a]).all()
                assert (scan.unpacked(ranks) == values[a:b] % 900).all()


@pytest.mark.parametrize("kind", range(len(BACKGROUNDS)))
def test_scan_lines_of_every_background(spark, seqs, kind):
    own = seqs.where("seq NOT LIKE 'GATCACGATG%'")
    scorer = Scorer(LIB, BACKGROUNDS[kind], cutoffs=[-2.0, 0.5])
    cut, hits = scan.pieces(own, *scan.reach(scorer), 100), scan.score_sites(own, scorer, 0)
    for what in ("locations", "scores"):
        assert [tuple(r) for r in sinks.scan_lines(cut, scorer, what).collect()] == [tuple(r) for r in sinks.hit_lines(hits, what).collect()]
    plain = {(r.strand, r.pwm_id): r.n_hits for r in scan.totals(cut, scorer).collect()}
    assert {(r.strand, r.pwm_id): r.n_hits for r in scan.totals(cut, scorer, by_word=False).collect()} == plain


def test_scan_lines_without_hits(spark, seqs):
    scorer = Scorer(LIB, BACKGROUNDS[1], cutoffs=[99.0, 99.0])
    assert sinks.scan_lines(scan.pieces(seqs, *scan.reach(scorer), 100), scorer).collect() == []


def test_background_of_stored_pieces(spark, seqs, monkeypatch):
    monkeypatch.setattr(scan.pieces, "__defaults__", (50,))
    cut_up, scorer = commands.stored_scan(seqs, LIB)
    assert cut_up.count() > seqs.count()
    assert scorer == commands.scan_scorer(seqs, LIB)


def test_pieces_compute_their_sequences_once(spark, tmp_path):
    """No condition on the sequence is moved below the exchange that its text comes from."""
    spark.createDataFrame([(1, "gatc"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = scan.pieces(corpus.sequences(spark, str(tmp_path)), 4, 0)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    assert [r.seq_idx for r in found.collect()] == [1]
    empty = spark.createDataFrame([(1, "a", None), (2, "b", ""), (3, "c", "ACGT")], "seq_idx long, seq_id string, seq string")
    assert [r.seq_idx for r in scan.pieces(empty, 4, 0).collect()] == [3]
