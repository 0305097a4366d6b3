"""Exact thresholds, sums over intervals, look-ups by score, split sequence files and smoothed regions, against plain loops."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifspark.operators import features, intervals, peaks, scan, smoothing, stats, thresholds, windows
from motifspark.operators.kernel import Background, Pwm, Scorer
from motifspark.plans import commands
from motifspark.sources import readers, scratch, sinks, split_fasta

R = random.Random(23)
PWMS = [Pwm(0, "A", [[0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.7, 0.1], [0.2, 0.3, 0.1, 0.4], [0.1, 0.2, 0.3, 0.4]]), Pwm(1, "B", [[0.1, 0.2, 0.3, 0.4], [0.9, 0.1, 0.0, 0.0]])]


def dna(n, masked=0.0):
    return "".join("N" if R.random() < masked else R.choice("AACGTacgt") for _ in range(n))


def frame(spark, seqs):
    return spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(seqs)], "seq_idx long, seq_id string, seq string")


# ---- thresholds


def plain_distribution(mat, markov, grain):
    """{score in grains: [background's, matrix's probability]} by listing every site."""
    out = {}
    for site in itertools.product(range(4), repeat=len(mat)):
        score, bg, fg = 0, 1.0, 1.0
        for m, base in enumerate(site):
            k = min(m, markov.order)
            context = 0
            for c in site[m - k : m]:
                context = context * 4 + c
            prior, own = markov.probs[k][context, base], mat[m][base] / sum(mat[m])
            bg, fg = bg * prior, fg * own
            if score is not None and prior and mat[m][base]:
                score += math.floor((math.log(mat[m][base]) - math.log(prior)) / grain + 0.5)
            else:
                score = None
        if score is not None:
            both = out.setdefault(score, [0.0, 0.0])
            both[0] += bg
            both[1] += fg
    return out


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_markov_counts_and_distributions(spark, order):
    seqs = [dna(700, 0.03), dna(90), "AC", "", "NNN"]
    bg = thresholds.markov_background(frame(spark, seqs), order, 0.5)
    for j in range(order + 1):
        counts = np.full(4 ** (j + 1), 0.5)
        for s in seqs:
            for i in range(len(s) - j):
                word = s[i : i + j + 1].upper()
                if "N" not in word:
                    counts[int("".join(str("ACGT".index(c)) for c in word), 4)] += 1
        counts = counts.reshape(-1, 4)
        assert np.allclose(bg.probs[j], counts / counts.sum(1, keepdims=True))
    for p in PWMS:
        want = plain_distribution(p.mat, bg, 0.01)
        low, back, own = thresholds.distribution(p.mat, bg, 0.01)
        got = {low + i: [back[i], own[i]] for i in np.flatnonzero((back > 0) | (own > 0))}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)


def test_thresholds_are_those_of_all_sites(spark):
    bg = thresholds.markov_background(frame(spark, [dna(3000)]), 1)
    for criterion, kind in itertools.product((0.001, 0.05, 0.4), ("FP", "FN", "MAX")):
        got = {r.pwm_id: r for r in thresholds.exact_thresholds(spark, PWMS, bg, criterion, kind, 0.01).collect()}
        for p in PWMS:
            d = plain_distribution(p.mat, bg, 0.01)
            fp = min(s for s in d if sum(v[0] for x, v in d.items() if x > s) <= criterion)
            fn = max([s for s in d if sum(v[1] for x, v in d.items() if x <= s) <= criterion], default=min(d) - 1)
            at = {"FP": fp, "FN": fn, "MAX": max(fp, fn)}[kind]
            assert math.isclose(got[p.pwm_id].cutoff, at * 0.01, abs_tol=1e-9)
            assert math.isclose(got[p.pwm_id].fp, sum(v[0] for x, v in d.items() if x > at), abs_tol=1e-12)
            assert math.isclose(got[p.pwm_id].fn, sum(v[1] for x, v in d.items() if x <= at), abs_tol=1e-12)
    middle = {r.pwm_id: r.cutoff for r in thresholds.exact_thresholds(spark, PWMS, bg, 0.05, "FP", 0.01, midpoint=True).collect()}
    plain = {r.pwm_id: r.cutoff for r in thresholds.exact_thresholds(spark, PWMS, bg, 0.05, "FP", 0.01).collect()}
    assert all(middle[k] >= plain[k] for k in plain) and middle != plain
    with pytest.raises(ValueError):
        thresholds.exact_thresholds(spark, PWMS, bg, kind="X")
    with pytest.raises(ValueError):
        thresholds.markov_background(frame(spark, []), 9)


def test_histograms_of_distributions(spark):
    bg = thresholds.markov_background(frame(spark, [dna(500)]), 1)
    hist = thresholds.binned(thresholds.score_distributions(spark, PWMS[:1], bg, 0.01), 20).collect()
    for kind in ("BG", "FG"):
        assert math.isclose(sum(r.height for r in hist if r.kind == kind), 1.0)
    assert all(0 <= r.bin_idx < 20 and r.lb < r.ub for r in hist)
    lonely = thresholds.exact_thresholds(spark, [Pwm(0, "none", [[0.0, 0.0, 0.0, 0.0]])], bg).first()
    assert lonely.cutoff is None


# ---- look-ups by score


def test_error_rates_are_sums_of_lower_bins(spark):
    hist = [(p, k, R.uniform(-9, 9) if p == "A" else i * 0.5, R.random() / 30) for p in "AB" for k in ("BG", "FG") for i in range(30)] + [("C", "BG", 1.0, 0.5)]
    scored = [(i, R.choice("ABCD"), R.choice([R.uniform(-12, 20), 3.0, 1.0, -math.inf, math.inf, None])) for i in range(500)]
    got = stats.error_rates(spark.createDataFrame(scored, "site long, pwm_id string, score double"), spark.createDataFrame(hist, "pwm_id string, kind string, lb double, height double"), ["site"]).collect()
    assert len(got) == 500
    for r in got:
        _, p, s = scored[r.site]
        below = {k: sum(h for q, kind, lb, h in hist if q == p and kind == k and s is not None and lb < s) for k in ("BG", "FG")}
        assert math.isclose(r.fp, 1 - below["BG"], abs_tol=1e-12) and math.isclose(r.fn, below["FG"], abs_tol=1e-12)


def test_site_report(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    row = lambda name, strand, motif, flank: "\t".join(["x"] * 16 + [name, strand] + ["x"] * 8 + [motif, flank]) + "\t\n"
    header = "\t".join(f"h{i}" for i in range(28))
    sites = put("sites", header + "\n" + row("m", "REV", "AAC", "ttgg") + row("M", "FWD", "GTT", "ACGT") + row("M", "FWD", "GNT", "A") + row("other", "FWD", "GTT", "A"))
    matrices = put("m.txt", "> M\n" + "=\t0.1\t0.2\t0.3\t0.4\n" * 3 + "\n")
    (tmp_path / "H").mkdir()
    for name in "Mm":  # matrices are found in any case, histograms as they are spelled
        put(f"H/{name}.hbin", "0,-5,0\t0.6\n1,0,5\t0.4\n\n0,-5,0\t0.1\n1,0,5\t0.9\n")
    out = str(tmp_path / "report")
    got = sorted(commands.site_report(spark, sites, matrices, str(tmp_path / "H"), out).collect(), key=lambda r: r.site_id)
    b = stats.SITE_BACKGROUND
    want = math.log(0.3) + 2 * math.log(0.4) - 2 * math.log(b[2]) - math.log(b[3])
    assert [(r.motif_rc, r.flank_rc) for r in got] == [("AAC", "GGTT"), ("AAC", "ACGT"), ("ANC", "T"), ("AAC", "T")]
    assert all(math.isclose(r.score, want) and math.isclose(r.fp, 0, abs_tol=1e-12) and math.isclose(r.fn, 1) for r in got[:2])
    assert all((r.score, r.fp, r.fn) == (None, None, None) for r in got[2:])
    lines = [r.value for r in spark.read.text(out).collect()]
    assert lines[0] == header + "\tmotif_seq_revcom\tflanking_seq_revcom\tFP_rate_M0\tFN_rate_M0\tloglik_score_M0"
    assert len(lines) == 5 and lines[3].endswith("\tGNT\tA\tANC\tT\tNA\tNA\tNA")


# ---- intervals


def plain_sums(hits, given, tiles):
    out = {}
    for h in hits:
        for seq_id, tissue, feature, which, left, right in given:
            if h.seq_id != seq_id or (which is not None and which != (0 if h.strand == "FWD" else 2) + h.pwm_idx):
                continue
            for no in range(1, tiles.count + 1) if tiles else [None]:
                lo, hi = (-tiles.up + (no - 1) * tiles.width, -tiles.up + no * tiles.width) if tiles else (left, right)
                if max(lo, left) <= h["loc"] <= min(hi, right):
                    key = (seq_id, tissue, feature, no, h.strand, h.pwm_id)
                    value, n = out.get(key, (0.0, 0))
                    out[key] = value + h.score, n + 1
    return out


@pytest.mark.parametrize("size, most", [(1 << 18, 4096), (17, 3)])
@pytest.mark.parametrize("background", [Background("local", window=20), Background("equal")])
def test_interval_sums_equal_joined_hits(spark, size, most, background):
    seqs = frame(spark, [dna(260), dna(131, 0.05), dna(3), "", dna(45), "NNNNNN", dna(107)])
    scorer = Scorer(PWMS, background, cutoffs=[-0.5, 0.0])
    hits = scan.score_sites(seqs, scorer).collect()
    given = [(f"s{R.randrange(8)}", R.choice(["LEAF", "ROOT", None]), R.choice(["f", None]), R.choice([None, 0, 3]), a := R.randrange(-150, 150), a + R.randrange(-3, 60)) for _ in range(80)]
    given += given[:10] * 3 + [("s0", "LEAF", "f", None, -10_000, 10_000)]
    table = spark.createDataFrame(given, "seq_id string, tissue string, feature_id string, which int, left int, right int")
    for tiles in (None, intervals.Tiles(40, 45, 20)):
        found = intervals.interval_sums(seqs, scorer, table, None, tiles, size, most).collect()
        got = {(r.seq_id, r.tissue, r.feature_id, r.win_no, r.strand, r.pwm_id): (r.value, r.n_hits) for r in found}
        want = plain_sums(hits, given, tiles)
        assert len(found) == len(got) and got.keys() == want.keys()
        assert all(got[k][1] == want[k][1] and math.isclose(got[k][0], want[k][0], abs_tol=1e-9) for k in want)


def test_interval_sums_move_no_hits(spark):
    seqs = frame(spark, [dna(300)])
    tissue = spark.createDataFrame([("s0", "LEAF", -25, 15)], "seq_id string, tissue string, start int, end int")
    plan = commands.open_tiles(seqs, PWMS, tissue, 40, 40, 20, 20)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "score" not in below and "MapInArrow" in plan
    infinite = Scorer(PWMS, Background("local", window=300), compat=True)
    one = tissue.select("seq_id", "tissue", F.lit(None).cast("string").alias("feature_id"), F.lit(None).cast("int").alias("which"), F.col("start").alias("left"), F.col("end").alias("right"))
    values = [r.value for r in intervals.interval_sums(seqs, infinite, one).collect()]
    assert values and all(v == math.inf for v in values)


# ---- split files


def assembled(segments):
    out = {}
    for r in segments.collect():
        out.setdefault((r.seq_idx, r.seq_id, r.header, r.n), []).append((r.offset, r.bases))
    for key, parts in out.items():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([len(b) for _, b in parts])[:-1]]
    return {k: "".join(b for _, b in v) for k, v in out.items()}


def test_split_records_equal_the_plain_reader(spark, tmp_path):
    """Records longer and shorter than a split, empty ones, text before a header, several files."""
    rng = random.Random(3)
    texts = []
    for no, lengths in enumerate([[20_000, 10, 0, 700], [5, 0, 0, 3], [1, 30_000], [], [40_000]]):
        records = ["stray line\n"] if no == 2 else []
        for i, n in enumerate(lengths):
            s = "".join(rng.choice("ACGTN") for _ in range(n))
            records.append(f"> c{no}_{i} about it\n" + "".join(s[a : a + 61] + "\r\n" for a in range(0, n, 61)))
        texts.append("".join(records))
        (tmp_path / f"f{no}.fa").write_text(texts[-1])
    want, idx = {}, 0
    for text in texts:
        for record in text.split(">")[1:]:
            head, *lines = record.split("\n")
            s = "".join(x.strip() for x in lines)
            want[idx, head.split()[0], head.strip(), len(s)] = s
            idx += 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        for size in (500, 1 << 18):
            assert assembled(split_fasta.read_split_fasta(spark, str(tmp_path), size)) == want
        segments = split_fasta.read_split_fasta(spark, str(tmp_path), 500)
        longest = [r.p for r in segments.where("n = 40000").select(F.spark_partition_id().alias("p")).distinct().collect()]
        assert len(longest) >= 8
        bg = Background("local", window=20)
        whole = spark.createDataFrame([(k[0], k[1], s) for k, s in want.items()], "seq_idx long, seq_id string, seq string")
        hits = lambda rows: sorted((r.strand, r.pwm_id, r.seq_idx, r["loc"], round(r.score, 9)) for r in rows.collect())
        scorer = Scorer(PWMS, bg, cutoffs=[2.0, 1.0])
        pieces = split_fasta.segment_pieces(segments, *scan.reach(scorer), size=700)
        assert hits(scan.score_pieces(pieces, scorer)) == hits(scan.score_sites(whole, scorer))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fasta_records_and_ordered_tables(spark, tmp_path):
    seqs = frame(spark, ["ACGTACGTAC", "", "ACG", "ACGTA"])
    path = str(tmp_path / "r")
    sinks.fasta_records(seqs, 5).coalesce(1).write.text(path)
    assert [r.value for r in spark.read.text(path).collect()] == [">s0", "ACGTA", "CGTAC", ">s1", ">s2", "ACG", ">s3", "ACGTA"]
    rows = spark.range(5000).select(F.concat_ws(" ", F.concat(F.lit("r"), "id"), (F.col("id") / 2).cast("string")).alias("line"), "id")
    rows.repartitionByRange(6, "id").sortWithinPartitions("id").select("line").write.text(str(tmp_path / "many"))
    got = readers.read_double_column(spark, str(tmp_path / "many")).collect()
    assert len(got) == 5000 and all(r.label == f"r{r.row_idx}" and r.value == r.row_idx / 2 for r in got)


def test_spread_follows_the_size_of_tables(spark, monkeypatch):
    rows = scratch.stored(spark.range(1000).select(F.col("id").alias("seq_idx"), F.lit("ACGT").alias("seq")))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scan.spread(rows, "seq_idx").rdd.getNumPartitions() == least
    monkeypatch.setattr(scan, "TASK", 100)
    assert scan.spread(rows, "seq_idx").rdd.getNumPartitions() > least


# ---- smoothed regions


def plain_fit(x, y, span):
    n = len(x)
    cells, near = max(1, min(n - 1, math.ceil(5 / span))), min(n, max(3, math.ceil(span * n)))
    lines = []
    for v in range(cells + 1):
        r = v * (n - 1) // cells
        lo = max(0, min(n - near, r - near // 2))
        d = x[lo : lo + near] - x[r]
        w = (1 - np.minimum(1, np.abs(d) / max(np.abs(d).max(), 1e-12)) ** 3) ** 3 + 1e-12
        slope, value = np.polyfit(d, y[lo : lo + near], 1, w=np.sqrt(w)) if near > 2 else (0, y[r])
        lines.append((x[r], value, slope, r))
    out = []
    for i in range(n):
        v = min(cells - 1, max(k for k in range(cells + 1) if lines[k][3] <= i))
        (x0, a, b, _), (x1, a1, b1, _) = lines[v], lines[v + 1]
        t, h = (x[i] - x0) / (x1 - x0), x1 - x0
        out.append(a * (1 + 2 * t) * (1 - t) ** 2 + b * h * t * (1 - t) ** 2 + a1 * t * t * (3 - 2 * t) - b1 * h * t * t * (1 - t))
    return np.array(out)


def curve_frame(spark, curves):
    return spark.createDataFrame([("FWD", k, int(a), float(b)) for k, (x, y) in curves.items() for a, b in zip(x, y)], "strand string, pwm_id string, loc long, cumscore double")


@pytest.fixture(scope="module")
def curves():
    rng = np.random.default_rng(4)
    out = {}
    for k, n in (("bump", 900), ("short", 40), ("two", 650)):
        x = np.sort(rng.choice(np.arange(-n, n), n, replace=False)).astype(float)
        y = 5 * np.exp(-((x / 60) ** 2)) + (4 * np.exp(-(((x - 300) / 40) ** 2)) if k == "two" else 0) + rng.normal(size=n) * 0.2
        out[k] = (x, y)
    out["one"] = (np.array([7.0]), np.array([2.0]))
    return out


def test_fits_are_weighted_regressions(spark, curves, monkeypatch):
    monkeypatch.setattr(smoothing, "BUCKET", 64)
    got = {(r.pwm_id, r.loc): (r.i, r.n, r.fit) for r in smoothing.fitted(smoothing.numbered(curve_frame(spark, curves)), 0.1).collect()}
    assert got.pop(("one", 7)) == (0, 1, 2.0)
    for k in ("bump", "short", "two"):
        x, y = curves[k]
        fit = plain_fit(x, y, 0.1)
        assert [got[k, int(a)][0] for a in x] == list(range(len(x)))
        assert np.allclose([got[k, int(a)][2] for a in x], fit, atol=1e-6)
        near = math.ceil(0.1 * len(x))
        assert np.abs(fit - peaks.local_lines(x, y, near)).mean() < 0.1  # close to a fit at every place


def plain_region(x, fit, p, buffer, max_dist, one):
    if p is None or abs(x[p]) > max_dist:
        return None
    level = lambda part: (part.min() + part.max()) / 2
    ll, rl = (level(fit), level(fit)) if one else (level(fit[: p + 1]), level(fit[p:]))
    down = [i for i in range(p, -1, -1) if fit[i] < ll][buffer - 1 : buffer]
    up = [i for i in range(p, len(x)) if fit[i] < rl][buffer - 1 : buffer]
    if not down or not up or down[0] < 1 or up[0] + 1 >= len(x):
        return None
    left, right = x[down[0] - 1], x[up[0] + 1]
    half = (right - left) / 2
    if half > 250:
        return x[p], 250.0, x[p] - 250, x[p] + 250
    return x[p], float(round(half) if half >= 10 else round(half, 1)), left, right


def regions_of(df):
    return {r.pwm_id: None if r.max_peak_loc is None else (r.max_peak_loc, r.half_width, r.left, r.right) for r in df.collect()}


def test_smoothed_regions(spark, curves):
    got = regions_of(smoothing.smoothed_regions(curve_frame(spark, curves), 0.1, 60))
    want = {}
    for k, (x, y) in curves.items():
        n = len(x)
        fit = plain_fit(x, y, 0.1) if n > 1 else y
        tops = [i for i in range(60, n - 60) if fit[i] >= fit[i - 60 : i + 61].max()]
        p = min(tops, key=lambda i: (abs(i - int(fit.argmax())), i), default=None)
        want[k] = plain_region(x, fit, p, 2, n / 2, False)
    assert got == want and got["bump"] is not None and got["short"] is None


def test_midrange_regions(spark, curves):
    got = regions_of(smoothing.midrange_regions(curve_frame(spark, curves), 200))
    assert got == {k: plain_region(x, y, int(y.argmax()), 5, 200, True) for k, (x, y) in curves.items()} and got["bump"] is not None


def test_open_tiles_equal_the_relational_form(spark):
    seqs = frame(spark, [dna(300), dna(200)])
    tissue = spark.createDataFrame([(f"s{R.randrange(2)}", R.choice(["LEAF", "ROOT"]), a := R.randrange(-90, 90), a + R.randrange(50)) for _ in range(40)], "seq_id string, tissue string, start int, end int")
    hits = scan.score_sites(seqs, Scorer(PWMS, commands.local(20)))
    clipped = windows.clipped_to_open(windows.tiles(spark, 60, 60, 30), tissue)
    as_rows = lambda df: {(r.seq_id, r.pwm_id, r.strand, r.tissue, r.win_no): round(r.value, 8) for r in df.collect()}
    assert as_rows(commands.open_tiles(seqs, PWMS, tissue, 60, 60, 30, 20)) == as_rows(features.open_tile_features(hits, clipped))


def test_scratch_files_are_dropped(spark):
    kept = scratch.stored(spark.range(3))
    path = kept.inputFiles()[0]
    assert kept.count() == 3
    scratch.drop_files(spark)
    with pytest.raises(Exception, match="(?i)not exist|no such|not found"):
        spark.read.parquet(path).count()
