"""Motif statistics: plain string scores, error rates from histograms, and score thresholds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifspark.functions.alphabet import upper_reverse_complement
from motifspark.operators.kernel import Background, Pwm

SITE_BACKGROUND = (0.3486, 0.1599, 0.1498, 0.3417)  # fixed values: A, C, G, T


def lagged_score(motif: Column, theta: Column, background: tuple[float, ...] = SITE_BACKGROUND) -> Column:
    """Sum of ln theta less ln background, where the background of a place is that of the base before it (the first: its own).

    motif: upper-case bases; theta: the matrix row by row. Null for a masked character or another length.
    """
    codes = F.transform(F.split(motif, ""), lambda c: F.instr(F.lit("ACGT"), c) - 1)
    b = F.array(*[F.lit(float(np.log(x))) for x in background])
    ln = lambda p: F.when(p > 0, F.ln(p)).otherwise(F.lit(float("-inf")))
    width = (F.size(theta) / 4).cast("int")

    def term(i: Column) -> Column:
        return ln(F.element_at(theta, (i - 1) * 4 + F.element_at(codes, i) + 1)) - F.element_at(b, F.element_at(codes, F.greatest(i - 1, F.lit(1))) + 1)

    total = F.aggregate(F.sequence(F.lit(1), width), F.lit(0.0), lambda a, i: a + term(i))
    return F.when(motif.rlike("^[ACGT]+$") & (F.length(motif) == width), total)


def small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """table, to be broadcast if it has at most `most` rows; else Spark joins it as any other."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def bin_index(hist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cumulative heights for look-ups by score: (pwm_id, low, step, n_buckets) and (pwm_id, bucket, bg, fg, bins).

    The range of a matrix's lower bounds is cut into as many equal buckets as it has bins. A bucket's row has the heights of
    all bins in buckets before it and its own bins, so that a score meets one row, whatever the number of bins.
    """
    ranges = hist.groupBy("pwm_id").agg(F.min("lb").alias("low"), F.max("lb").alias("high"), F.count("*").alias("n_buckets"))
    step = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / F.col("n_buckets")).otherwise(F.lit(1.0))
    ranges = ranges.select("pwm_id", "low", step.alias("step"), "n_buckets")
    rows = hist.join(ranges, "pwm_id").withColumn("bucket", bucket(F.col("lb")))
    own = rows.groupBy("pwm_id", "bucket").agg(*[F.sum(F.when(F.col("kind") == k, F.col("height")).otherwise(0.0)).alias(k) for k in ("BG", "FG")], F.collect_list(F.struct("lb", "kind", "height")).alias("bins"))
    every = ranges.select("pwm_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_buckets") - 1)).alias("bucket"))
    before = Window.partitionBy("pwm_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(k).over(before), F.lit(0.0)).alias(k.lower()) for k in ("BG", "FG")]
    return ranges, every.join(own, ["pwm_id", "bucket"], "left").select("pwm_id", "bucket", *sums, "bins")


def bucket(score: Column) -> Column:
    """The bucket of a score by the columns low, step and n_buckets; never later than that of a higher score."""
    at = F.floor(F.greatest(F.lit(0.0), F.least(F.col("n_buckets").cast("double"), (score - F.col("low")) / F.col("step"))))
    return F.least(F.col("n_buckets") - 1, at.cast("long"))


def error_rates(scored: DataFrame, hist: DataFrame, key: list[str]) -> DataFrame:
    """(key, fp, fn) of scored (key, pwm_id, score) by histograms (pwm_id, kind BG or FG, lb, height), a row for each row of scored.

    fp is one less the background's height in bins that start below the score; fn the foreground's height in such bins. A
    matrix without a histogram has fp 1 and fn 0, and so has a null score. An as-of look-up: a score is joined with the one bucket of bins that it lies in.
    """
    ranges, table = bin_index(hist)
    placed = scored.join(small(ranges), "pwm_id", "left").withColumn("bucket", F.when(F.col("score").isNotNull(), bucket(F.col("score"))))
    met = placed.join(small(table), ["pwm_id", "bucket"], "left")
    within = lambda kind: F.aggregate(F.filter("bins", lambda x: (x["kind"] == kind) & (x["lb"] < F.col("score"))), F.lit(0.0), lambda a, x: a + x["height"])
    below = lambda kind, before: F.coalesce(F.col(before), F.lit(0.0)) + F.coalesce(within(kind), F.lit(0.0))
    return met.select(*key, (1 - below("BG", "bg")).alias("fp"), below("FG", "fg").alias("fn"))


def site_scores(sites: DataFrame, pwms: DataFrame) -> DataFrame:
    """sites (site_id, pwm_id, strand, motif, flank, ...) with scored (the motif, reverse-complemented on REV) and score.

    Labels bind in any case, as the matrices of a library are looked up by name; a library (pwm_id, mat) is broadcast if small.
    """
    names = pwms.select(F.lower("pwm_id").alias("name"), F.flatten("mat").alias("theta")).dropDuplicates(["name"])
    rows = sites.withColumn("name", F.lower("pwm_id")).join(small(names), "name", "left")
    rows = rows.withColumn("scored", F.when(F.upper("strand") == "REV", upper_reverse_complement(F.col("motif"))).otherwise(F.col("motif")))
    return rows.withColumn("score", lagged_score(F.col("scored"), F.col("theta"))).drop("theta", "name")


def site_statistics(sites: DataFrame, pwms: DataFrame, hist: DataFrame) -> DataFrame:
    """sites (site_id, pwm_id, strand, motif, flank) with motif_rc, flank_rc, score, fp and fn; on REV both are reverse-complemented."""
    rows = site_scores(sites, pwms).withColumnRenamed("scored", "motif_rc")
    rows = rows.withColumn("flank_rc", F.when(F.upper("strand") == "REV", upper_reverse_complement(F.col("flank"))).otherwise(F.col("flank")))
    return error_rates(rows, hist, rows.columns)


def site_report(sites: DataFrame, pwms: DataFrame, hist: DataFrame, compat: bool = False) -> DataFrame:
    """(site_id, line, motif_rc, flank_rc, fp, fn, score) of a table of sites with its lines (sources.readers.read_sites).

    The reverse complements are those of the scored motif and of the flank, upper case. fp and fn are null where the motif cannot be
    scored. Of the line one tab or line end goes, as tables end their rows so; compat drops its last character, whatever it is.
    """
    rows = site_scores(sites, pwms)
    found = error_rates(rows, hist, rows.columns)
    line = F.substring("line", F.lit(1), F.greatest(F.lit(0), F.length("line") - 1)) if compat else F.regexp_replace("line", r"[\t\r]$", "")
    known = lambda c: F.when(F.col("score").isNotNull(), F.col(c)).alias(c)
    return found.select("site_id", line.alias("line"), upper_reverse_complement(F.col("scored")).alias("motif_rc"), upper_reverse_complement(F.col("flank")).alias("flank_rc"), known("fp"), known("fn"), "score")


def score_histogram(hits: DataFrame, low: float, high: float, bins: int = 500) -> DataFrame:
    """(pwm_id, bin_idx, lb, ub, height): shares of the scores in equal bins of [low, high); others are left out of the bins."""
    width = (high - low) / bins
    inside = (F.col("score") >= low) & (F.col("score") < high)
    counted = hits.groupBy("pwm_id", F.when(inside, F.floor((F.col("score") - low) / width).cast("int")).alias("bin_idx")).agg(F.count("*").alias("c"))
    counted = counted.withColumn("n", F.sum("c").over(Window.partitionBy("pwm_id"))).where("bin_idx IS NOT NULL")
    return counted.select("pwm_id", "bin_idx", (low + F.col("bin_idx") * width).alias("lb"), (low + (F.col("bin_idx") + 1) * width).alias("ub"), (F.col("c") / F.col("n")).alias("height"))


def thresholds(spark: SparkSession, pwms: list[Pwm], background: Background, criterion: float = 0.01, kind: str = "FP", samples: int = 50_000, seed: int = 1) -> DataFrame:
    """(pwm_idx, pwm_id, cutoff) by this library's own definition, as the tool that others call for it is not public.

    Sites are drawn from the background (in blocks that Spark spreads over tasks) and from the matrix. FP: the score that a
    share `criterion` of background sites exceeds; FN: that such a share of the matrix's own sites stays below; MAX: the larger.
    """
    if kind not in ("FP", "FN", "MAX"):
        raise ValueError("kind is FP, FN or MAX")
    library = {p.pwm_idx: p for p in pwms}
    m0 = np.array(background.m0 or [0.25] * 4, float)
    m1 = np.array(background.m1, float) if background.m1 is not None else None
    block = 5_000

    def draw(batches):
        for pdf in batches:
            for idx, part in zip(pdf["pwm_idx"], pdf["part"], strict=True):
                p, rng = library[idx], np.random.default_rng([seed, int(idx), int(part)])
                m, theta = np.maximum(np.array(p.mat, float), 0), p.log("FWD")
                k = min(block, samples - part * block)
                for which in ("BG", "FG"):
                    x = np.empty((k, len(m)), int)
                    for j in range(len(m)):
                        rows = np.tile(m[j] / m[j].sum(), (k, 1)) if which == "FG" else np.tile(m0, (k, 1)) if m1 is None or j == 0 else m1[x[:, j - 1]]
                        x[:, j] = np.minimum((rng.random((k, 1)) > np.cumsum(rows, 1)).sum(1), 3)
                    with np.errstate(divide="ignore"):
                        below = np.log(m0)[x[:, 0]] + sum((np.log(m1)[x[:, j - 1], x[:, j]] if m1 is not None else np.log(m0)[x[:, j]]) for j in range(1, len(m)))
                    score = sum(theta[j][x[:, j]] for j in range(len(m))) - below
                    yield type(pdf)({"pwm_idx": idx, "which": which, "score": score})

    parts = spark.createDataFrame([(p.pwm_idx, k) for p in pwms for k in range(-(-samples // block))], "pwm_idx int, part int")
    drawn = parts.repartition("pwm_idx", "part").mapInPandas(draw, "pwm_idx int, which string, score double")
    rate = lambda which, q: F.percentile_approx(F.when((F.col("which") == which) & ~F.isnan("score"), F.col("score")), F.lit(q), F.lit(100_000))
    cut = drawn.groupBy("pwm_idx").agg(rate("BG", 1 - criterion).alias("fp"), rate("FG", criterion).alias("fn"))
    names = spark.createDataFrame([(p.pwm_idx, p.pwm_id) for p in pwms], "pwm_idx int, pwm_id string")
    value = {"FP": F.col("fp"), "FN": F.col("fn"), "MAX": F.greatest("fp", "fn")}[kind]
    return cut.join(names, "pwm_idx").select("pwm_idx", "pwm_id", value.alias("cutoff"))
