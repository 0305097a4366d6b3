"""Kernel, backgrounds, scans and features against plain loops and their relational forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifspark.functions import alphabet
from motifspark.operators import background, features, peaks, scan, windows
from motifspark.operators.kernel import Background, Pwm, Scorer
from motifspark.plans import commands, corpus

R = random.Random(11)
PWMS = [
    Pwm(0, "A", [[0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.7, 0.1], [0.2, 0.3, 0.1, 0.4]]),
    Pwm(1, "B", [[0.1, 0.2, 0.3, 0.4], [0.9, 0.1, 0.0, 0.0]]),
]


def dna(n, masked=0.0):
    return "".join("N" if R.random() < masked else R.choice("ACGTacgt") for _ in range(n))


SEQS = [dna(260), dna(131, 0.05), dna(3), "", dna(45), "NNNNNN", dna(107)]


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(SEQS)], "seq_idx long, seq_id string, seq string")


def loop_scores(seq, mat, bg, j):
    """The score of one site by the definition, None if it is dropped."""
    x = ["ACGT".find(c) for c in seq.upper()]
    w, n = len(mat), len(seq)
    if min(x[j : j + w]) < 0:
        return None
    if bg.kind == "local":
        if n < 2 * bg.window + 2:
            return None
        near = [c for c in x[max(0, j - bg.window) : j + bg.window + 1] if c >= 0]
        b = [near.count(c) / len(near) for c in range(4)]
        pairs = [(x[k], x[k + 1]) for k in range(max(0, j - bg.window), min(j + bg.window, n - 2) + 1) if x[k] >= 0 and x[k + 1] >= 0]
    total = 0.0
    for m in range(w):
        p = mat[m][x[j + m]]
        total += math.log(p) if p else -math.inf
        if bg.kind == "equal":
            q = 0.25
        elif bg.kind == "global":
            q = bg.m0[x[j]] if m == 0 or bg.m1 is None else bg.m1[x[j + m - 1]][x[j + m]]
            q = bg.m0[x[j + m]] if bg.m1 is None else q
        else:
            row = [t for s, t in pairs if s == x[j + m - 1]]
            q = b[x[j]] if m == 0 else row.count(x[j + m]) / len(row) if row else math.nan
        total -= math.log(q) if q else -math.inf
    return total


def loop_hits(bg, cutoffs=(0.0, 0.0), after=None):
    out = {}
    for i, s in enumerate(SEQS):
        n = len(s)
        tss = n - (n // 2 if after is None else after)
        for p in PWMS:
            for strand in ("FWD", "REV"):
                mat = p.mat if strand == "FWD" else [r[::-1] for r in p.mat[::-1]]
                for j in range(n - len(mat) + 1):
                    v = loop_scores(s, mat, bg, j)
                    if v is not None and v > cutoffs[p.pwm_idx]:
                        out[strand, p.pwm_id, i, j - tss] = v
    return out


def as_dict(hits):
    return {(r.strand, r.pwm_id, r.seq_idx, r["loc"]): r.score for r in hits.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    assert all(math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-9) for k in a)


# uneven numbers, so that no score is zero but for rounding
M0, M1 = [0.31, 0.19, 0.23, 0.27], [[0.41, 0.19, 0.23, 0.17], [0.13, 0.29, 0.31, 0.27], [0.26, 0.24, 0.21, 0.29], [0.22, 0.18, 0.23, 0.37]]


@pytest.mark.parametrize("bg", [Background(), Background("global", M0), Background("global", M0, M1), Background("local", window=20)], ids=lambda b: f"{b.kind}{bool(b.m1)}")
def test_hits_match_the_definition(seqs, bg):
    same(as_dict(scan.score_sites(seqs, Scorer(PWMS, bg))), loop_hits(bg))


def test_pieces_give_the_same_hits(seqs):
    for bg in (Background(), Background("local", window=20)):
        scorer = Scorer(PWMS, bg)
        same(as_dict(scan.score_sites(seqs, scorer, piece=16)), as_dict(scan.score_sites(seqs, scorer)))


def test_sql_form_agrees(seqs):
    for bg in (Background(), Background("global", M0), Background("global", M0, M1)):
        scorer = Scorer(PWMS, bg, cutoffs=[0.5, 0.1])
        same(as_dict(scan.score_sites_sql(seqs, scorer, 0)), as_dict(scan.score_sites(seqs, scorer, 0)))
    with pytest.raises(ValueError):
        scan.score_sites_sql(seqs, Scorer(PWMS, Background("local")))


def test_reverse_scan_mirrors_the_forward_one(spark):
    s = dna(80)
    rc = s[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))
    score = lambda x, strand: next(v for p, t, v in Scorer(PWMS[:1], strands=(strand,)).scores(x))
    assert np.allclose(score(s, "REV"), score(rc, "FWD")[::-1])


def test_micro_fixtures(spark):
    one = [Pwm(0, "A", [[1.0, 0, 0, 0], [1.0, 0, 0, 0]])]
    s = spark.createDataFrame([(0, "x", "AAC"), (1, "y", "AANAA")], "seq_idx long, seq_id string, seq string")
    got = as_dict(scan.score_sites(s, Scorer(one, strands=("FWD",)), 0))
    same(got, {("FWD", "A", 0, -3): 2 * math.log(4), ("FWD", "A", 1, -5): 2 * math.log(4), ("FWD", "A", 1, -2): 2 * math.log(4)})
    with pytest.raises(ValueError):
        Scorer(one, strands=("BOTH",))
    with pytest.raises(ValueError):
        Scorer(one, cutoffs=[1, 2])


def test_backgrounds(spark, seqs):
    got = {r.base: r.freq for r in background.base_frequencies(seqs).collect()}
    text = "".join(SEQS).upper().replace("N", "")
    assert all(math.isclose(got[b], text.count(b) / len(text)) for b in "ACGT")
    m1 = {(r.prev, r.base): r.freq for r in background.pair_frequencies(spark.createDataFrame([("AACA",)], "seq string")).collect()}
    assert m1["A", "A"] == m1["A", "C"] == 0.5 and m1["C", "A"] == 1.0 and m1["G", "A"] is None
    rows = background.local_frequencies(spark.createDataFrame([(0, "AACGT"), (1, "AC")], "seq_idx long, seq string"), 1).collect()
    at = {(r.seq_idx, r.pos): r.b for r in rows}
    assert at[0, 0] == [1, 0, 0, 0] and np.allclose(at[0, 1], [2 / 3, 1 / 3, 0, 0]) and np.allclose(at[0, 4], [0, 0, 0.5, 0.5])
    assert at[1, 0] == [None] * 4
    sql = {(r.seq_idx, r.pos, r.base): r.freq for r in background.local_base_frequencies_sql(seqs, 20).collect()}
    for r in background.local_frequencies(seqs, 20).collect():
        for k, b in enumerate("ACGT"):
            x = sql.get((r.seq_idx, r.pos, b))
            assert (x is None and r.b[k] is None) or math.isclose(x, r.b[k], abs_tol=1e-12)


def test_window_features_match_the_relational_form(seqs):
    scorer = Scorer(PWMS, Background("local", window=20))
    specs = commands.tile_specs(PWMS, 60, 40, 20)
    got = {(r.sample_id, r.feature_id): r.value for r in features.long_features(features.window_features(seqs, scorer, specs), specs).collect()}
    assert len(got) == len(SEQS) * len(specs)
    spark = seqs.sparkSession
    table = spark.createDataFrame([(s.pwm_idx, s.strand, s.feature_id, s.left, s.right) for s in specs], "pwm_idx int, strand string, feature_id string, left long, right long")
    sums = {(f"s{r.seq_idx}_0", r.feature_id): r.value for r in features.window_sums(scan.score_sites(seqs, scorer), table).collect()}
    assert all(math.isclose(v, sums.get(k, 0.0), abs_tol=1e-9) for k, v in got.items()) and sums.keys() <= got.keys()
    long = features.long_features(features.window_features(seqs, scorer, specs), specs)
    wide = features.pivoted(long, [s.feature_id for s in specs]).collect()
    assert len(wide) == len(SEQS) and all(math.isclose(r[s.feature_id], got[r.sample_id, s.feature_id]) for r in wide for s in specs)


def test_region_commands(spark, seqs):
    roe = spark.createDataFrame([(0, "A", "FWD", -3.0, 8.5), (1, "B", "REV", None, None)], "row_idx int, pwm_id string, strand string, max_peak_loc double, half_width double")
    at = windows.fixed_positions(seqs, [-10, 0])
    table, specs = commands.region_features(at, PWMS, roe, 20)
    assert [(s.left, s.right) for s in specs] == [(-31, -9), (-9, -5), (-7, -3), (-5, -1), (-3, 1), (-1, 3), (3, 25)]
    plain = {(r.seq_idx, r.pos): r["values"] for r in table.collect()}
    assert len(plain) == 2 * len(SEQS)
    scaled, norm = commands.region_features(at, PWMS, roe, 20, max_scores=[5.0, 5.0])
    for r in scaled.collect():
        assert np.allclose(r["values"], [v / ((s.right - s.left) * 5) * 10 for v, s in zip(plain[r.seq_idx, r.pos], norm, strict=True)])
    flanked, many = commands.region_features(at, PWMS, roe, 20, flank=(10, 2))
    assert len(many) == 35 and flanked.count() == 2 * len(SEQS)
    by_place, _ = commands.region_features(seqs, PWMS, roe, 20, by_place=True)
    sums = {(r.sample_id, r.feature_id): r.v for r in by_place.groupBy("sample_id", "feature_id").agg(F.sum("value").alias("v")).collect()}
    assert all(math.isclose(sums[f"s{i}_0", s.feature_id], plain[i, 0][k], abs_tol=1e-9) for i in range(len(SEQS)) for k, s in enumerate(specs))


def test_window_generators(spark):
    got = [(r.win_no, r.left, r.right) for r in windows.tiles(spark, 500, 120, 100).orderBy("win_no").collect()]
    assert got[0] == (1, -500, -400) and got[-1] == (6, 0, 100) and len(got) == 6
    s = spark.createDataFrame([(0, "idx_Chr1_674_-", "A" * 6001), (1, "idy_Chr1_5", "A" * 6001)], "seq_idx long, seq_id string, seq string")
    a = windows.fixed_positions(windows.anchors(s), [0])
    wins = spark.createDataFrame([(0, "f", -500, -400)], "pwm_idx int, feature_id string, left int, right int")
    width = spark.createDataFrame([(0, 9)], "pwm_idx int, w int")
    rows = {r.seq_id: r for r in windows.genomic_map(a, wins, width).collect()}
    plus = rows["idy_Chr1_5_0"]
    assert (plus.tss_start, plus.absolute_start, plus.absolute_end, plus.genomic_start) == (3001, 2501, 2601, 2506)
    minus = rows["idx_Chr1_674_-_0"]
    assert (minus.tss_start, minus.absolute_start, minus.absolute_end) == (3001, 3401, 3501)
    assert [r.pos for r in windows.range_positions(s.where("seq_idx = 0"), 45, -90, 90).collect()] == [-90, -45, 0, 45, 90]
    assert [r.pos for r in windows.range_positions(s.where("seq_idx = 0"), 2, 0, 7, compat=True).collect()] == [0, 0, 2, 0]
    drawn = [r.pos for r in windows.random_positions(s, 5, 1, 9).where("seq_idx = 0").collect()]
    assert len(set(drawn)) == 5 and set(drawn) <= set(range(1, 10))
    for bad in (lambda: windows.random_positions(s, 5, 1, 4), lambda: windows.flanks(wins, 10, 0), lambda: windows.flanks(wins, 10, 3), lambda: windows.tiles(spark, 1, 1, 0)):
        with pytest.raises(ValueError):
            bad()


def loop_peak(curve, up, down):
    loc, cum = [x for x, _ in curve], [y for _, y in curve]
    out = [y for x, y in curve if x < up or x > down]
    bg = round(sum(out) / len(out), 2) if out else None
    p = max(range(len(cum)), key=lambda i: (cum[i], i))
    if not up <= loc[p] <= down:
        return None
    ends = []
    for step in (-1, 1):
        i, low = p, 0
        while low < 5 and 0 <= i < len(cum):
            low += bg is not None and cum[i] < bg
            i += step
        ends.append(min(max(i, 0), len(cum) - 1))
    if p in ends:
        return None
    left, right = loc[ends[0]], loc[ends[1]]
    half = (right - left) / 2
    if half > 250:
        half, left, right = 250, loc[p] - 250, loc[p] + 250
    return loc[p], half, left, right


def test_peaks(spark):
    curves = {}
    for k in range(12):
        size = R.choice((3, 9, 60, 400))
        curve = [(x * R.choice((1, 2)) - size, float(R.randint(0, 9)) + (8 if abs(x - size) < 3 + 4 * k else 0)) for x in range(2 * size)]
        curves[f"m{k}"] = sorted(dict(curve).items())
    rows = [("FWD", k, x, y) for k, c in curves.items() for x, y in c]
    df = spark.createDataFrame(rows, "strand string, pwm_id string, loc long, cumscore double")
    for r in peaks.peaks(df, -300, 300).collect():
        want = loop_peak(curves[r.pwm_id], -300, 300)
        if want is None:
            assert r.max_peak_loc is None and r.left is None
        else:
            assert (r.max_peak_loc, r.left, r.right) == (want[0], want[2], want[3])
            assert math.isclose(r.half_width, float(f"{want[1]:.2g}"), rel_tol=0.06)
    digits = spark.createDataFrame([(8.5,), (10.5,), (125.0,), (250.0,)], "x double").select(peaks.two_digits(F.col("x")).alias("y"))
    assert [r.y for r in digits.collect()] == [8.5, 11.0, 130.0, 250.0]
    table = peaks.roe_table(peaks.peaks(df, -300, 300), spark.createDataFrame([(0, "m0"), (1, "none")], "pwm_idx int, pwm_id string"))
    assert table.count() == 4 and table.where("pwm_id = 'none' AND max_peak_loc IS NULL").count() == 2
    smooth = peaks.smoothed_peaks(df)
    assert smooth.count() == len(curves)


def test_open_intervals(spark, seqs):
    tissue = spark.createDataFrame([("s0", "LEAF", -25, 15), ("s0", "LEAF", -5, 5), ("s1", "ROOT", 0, 500), ("s4", "ROOT", -900, -800)], "seq_id string, tissue string, start int, end int")
    rows = commands.open_tiles(seqs, PWMS, tissue, 40, 40, 20, 20).collect()
    hits = [(k[2], k[0], k[1], k[3], v) for k, v in loop_hits(Background("local", window=20)).items()]
    tiles = [(k, -40 + (k - 1) * 20, -40 + k * 20) for k in range(1, 5)]
    want = {}
    for s, t, a, b in (("s0", "LEAF", -25, 15), ("s0", "LEAF", -5, 5), ("s1", "ROOT", 0, 500)):
        for k, lo, hi in tiles:
            for i, strand, pwm, loc, v in hits:
                if f"s{i}" == s and max(lo, a) <= loc <= min(hi, b):
                    for key in (k, None):
                        want[s, pwm, strand, t, key] = want.get((s, pwm, strand, t, key), 0.0) + v
    same({(r.seq_id, r.pwm_id, r.strand, r.tissue, r.win_no): r.value for r in rows}, want)


def test_alphabet(spark):
    df = spark.createDataFrame([("ACGTN", "acgTn", [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]])], "a string, b string, m array<array<double>>")
    r = df.select(alphabet.reverse_complement(F.col("a")).alias("rc"), alphabet.upper_reverse_complement(F.col("b")).alias("urc"), alphabet.matrix_reverse_complement(F.col("m")).alias("m"), alphabet.base_code(F.lit("g")).alias("g"), alphabet.base_code(F.lit("N")).alias("n"), alphabet.share_of(F.col("a"), "GC").alias("gc"), alphabet.check_code(F.lit(2)).alias("c")).first()
    assert (r.rc, r.urc, r.g, r.n, r.gc, r.c) == ("NACGT", "NAGCA", 2, -1, 0.4, "G")
    assert r.m == [[8, 7, 6, 5], [4, 3, 2, 1]]
    with pytest.raises(Exception, match="not a base"):
        df.select(alphabet.check_base(F.lit("N"))).collect()


# ---- pieces


def long_sequence(n):
    rng = np.random.default_rng(4)
    return "".join(np.array(list("ACGTN"))[rng.choice(5, n, p=[0.3, 0.2, 0.2, 0.299, 0.001])])


def test_scans_are_spread(spark):
    """Pieces go to many tasks, whatever the number of splits: the plan has an exchange between the cut and the kernel."""
    seqs = spark.createDataFrame([(0, "s", long_sequence(100_000))], "seq_idx long, seq_id string, seq string").coalesce(1)
    cut = scan.pieces(seqs, 6, 50, 5000)
    assert cut.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    scorer = Scorer(corpus.library(0.25), Background("local", window=50))
    spec = [features.WindowSpec("f", 0, "FWD", -10, 10)]
    for df in (scan.score_sites(seqs, scorer), features.window_features(seqs, scorer, spec), background.local_frequencies(seqs, 50)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.index("MapInArrow") < plan.index("Exchange")


def test_ten_megabases_in_pieces(spark):
    """Features, places and backgrounds of a long sequence are those of the sequence in one piece."""
    n = 10_000_000
    seqs = spark.createDataFrame([(0, "s", long_sequence(n)), (1, "t", "ACGT" * 40), (2, "u", None), (3, "v", "")], "seq_idx long, seq_id string, seq string")
    scorer = Scorer(corpus.library(0.25), Background("local", window=50))
    half = n // 2
    specs = [features.WindowSpec("all", 0, "FWD", -half, half), features.WindowSpec("far", 1, "REV", -half + 3, -half + 900_000), features.WindowSpec("near", 1, "FWD", -20, 60, 2.0), features.WindowSpec("none", 0, "REV", n, n + 5)]
    whole, cut = ({r.seq_id: r["values"] for r in features.window_features(seqs, scorer, specs, piece=size).collect()} for size in (1 << 30, 1 << 19))
    assert whole.keys() == cut.keys() == {"s", "t", "u", "v"} and whole["s"][0] > 1000
    assert all(np.allclose(whole[k], cut[k], rtol=1e-9) for k in whole) and cut["u"] == cut["v"] == [0.0] * 4
    short = spark.createDataFrame([(0, "s", long_sequence(30_000))], "seq_idx long, seq_id string, seq string")
    specs = [features.WindowSpec("a", 0, "FWD", -700, 900), features.WindowSpec("b", 1, "REV", -40, 25), features.WindowSpec("c", 1, "FWD", 14_900, 15_100)]
    places = lambda size: {(r.feature_id, r.place): r.value for r in features.scores_by_place(short, scorer, specs, piece=size).collect()}
    one, many = places(1 << 30), places(97)
    assert one.keys() == many.keys() and len(one) == 1601 + 66 + 201 and all(abs(one[k] - many[k]) < 1e-9 for k in one) and sum(map(bool, one.values())) > 100
    rows = lambda size: {(r.seq_idx, r.pos): (r.b, r.b1) for r in background.local_frequencies(short, 50, piece=size).collect()}
    one, many = rows(1 << 30), rows(1001)
    assert one.keys() == many.keys() and len(one) == 30_000 and all(one[k] == many[k] for k in one)


def test_infinite_scores(spark):
    """A background without a base that the matrix allows gives infinite scores, which are counted."""
    seqs = spark.createDataFrame([(0, "s", "AACA")], "seq_idx long, seq_id string, seq string")
    hits = scan.score_sites(seqs, Scorer([Pwm(0, "m", [[0.5, 0.5, 0.0, 0.0]])], Background("global", [1.0, 0.0, 0.0, 0.0]), ("FWD",), [-1.0]), 0)
    assert [(r.strand, r.pwm_id, r.n_infinite) for r in scan.infinite_scores(hits).collect()] == [("FWD", "m", 1)]


def test_smoothing_is_that_of_plain_loops():
    rng = np.random.default_rng(2)
    x = np.sort(rng.choice(3000, 700, replace=False)).astype(float)
    y = rng.normal(size=700).cumsum()
    k, fit = 41, []
    for i in range(700):
        a = min(max(0, i - k // 2), 700 - k)
        d = np.abs(x[a : a + k] - x[i])
        w = (1 - np.minimum(1, d / d.max()) ** 3) ** 3 + 1e-12
        c = np.polyfit(x[a : a + k] - x[i], y[a : a + k], 1, w=np.sqrt(w))
        fit.append(c[1])
    assert np.allclose(peaks.local_lines(x, y, k), fit, atol=1e-6)
    want = [max(y[(x >= v - 100) & (x <= v + 100)]) for v in x]
    assert list(peaks.highest_near(x, y, 100)) == want
