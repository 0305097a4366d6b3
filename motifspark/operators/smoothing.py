"""Regions of enrichment on locally regressed curves, and on raw ones by their mid-range.

A curve is numbered, fitted and searched in pieces, by joins and aggregates: no task holds a whole curve. As local regression is
usually computed, lines are fitted at vertices only, some five to a neighbourhood, and blended between by cubics that meet their
values and slopes: a place takes part in the few fits whose neighbourhood it lies in, so the work grows with the places.
Sliding maxima are those of two runs: from a window's start to the end of its block, and from the next block's start to its end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifspark.operators.stats import small
from motifspark.sources.scratch import stored

CURVE = ["strand", "pwm_id"]
BUCKET = 1 << 16  # places
CELLS = 5  # of a neighbourhood's width
CAP = 250


def numbered(curves: DataFrame) -> DataFrame:
    """(strand, pwm_id, loc, cumscore, i, n): places in order from 0, and their number, counted in buckets of places; stored."""
    rows = curves.select(*CURVE, "loc", "cumscore", F.floor(F.col("loc") / BUCKET).alias("bucket"))
    rows = stored(rows.withColumn("within", F.row_number().over(Window.partitionBy(*CURVE, "bucket").orderBy("loc")) - 1))
    sizes = rows.groupBy(*CURVE, "bucket").agg(F.count("*").alias("size"))
    every = Window.partitionBy(*CURVE)
    before = F.coalesce(F.sum("size").over(every.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*CURVE, "bucket", before.alias("before"), F.sum("size").over(every).alias("n"))
    return rows.join(small(sizes), [*CURVE, "bucket"]).select(*CURVE, "loc", "cumscore", (F.col("before") + F.col("within")).alias("i"), "n")


def vertices(rows: DataFrame, span: float) -> DataFrame:
    """(strand, pwm_id, v, n_cells, r, lo, hi, x, reach): vertices at equal steps of places, with the first and last place of the
    neighbourhood, the vertex's place and the distance of the farther end."""
    curves = rows.where("i = 0").select(*CURVE, "n")
    cells = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.lit(math.ceil(CELLS / span))))
    near = F.least(F.col("n"), F.greatest(F.lit(3), F.ceil(F.col("n") * F.lit(span))))
    out = curves.withColumns({"n_cells": cells.cast("long"), "near": near.cast("long")}).withColumn("v", F.explode(F.expr("sequence(0L, n_cells)")))
    out = out.withColumn("r", F.expr("v * (n - 1) div n_cells"))
    out = out.withColumn("lo", F.greatest(F.lit(0), F.least(F.col("n") - F.col("near"), F.expr("r - near div 2"))).cast("long")).withColumn("hi", F.col("lo") + F.col("near") - 1)
    wanted = out.select(*CURVE, F.explode(F.array("r", "lo", "hi")).alias("i")).distinct()
    places = rows.join(small(wanted), [*CURVE, "i"]).select(*CURVE, "i", "loc")
    for c in ("r", "lo", "hi"):
        out = out.join(small(places.select(*CURVE, F.col("i").alias(c), F.col("loc").alias(f"x_{c}"))), [*CURVE, c])
    reach = F.greatest(F.col("x_r") - F.col("x_lo"), F.col("x_hi") - F.col("x_r"))
    return out.select(*CURVE, "v", "n", "n_cells", "r", "lo", "hi", F.col("x_r").cast("double").alias("x"), F.greatest(reach.cast("double"), F.lit(1e-12)).alias("reach"))


def fitted(rows: DataFrame, span: float = 0.05) -> DataFrame:
    """numbered rows with fit: lines with tricube weights over the nearest share of the places, fitted at vertices and blended between."""
    at = stored(vertices(rows, span))
    bucket = F.expr("greatest(1, (n - 1) div n_cells)")
    listed = at.withColumn("g", bucket).withColumn("bucket", F.explode(F.expr("sequence(lo div g, hi div g)"))).drop("n", "n_cells", "r")
    sizes = at.where("v = 0").select(*CURVE, bucket.alias("width"), "n_cells")
    placed = rows.join(small(sizes), CURVE).withColumn("bucket", F.expr("i div width"))
    near = placed.select(*CURVE, "bucket", "i", "loc", "cumscore").join(small(listed), [*CURVE, "bucket"]).where("i BETWEEN lo AND hi")
    d, y = F.col("loc") - F.col("x"), F.col("cumscore")
    w = F.pow(1 - F.pow(F.least(F.lit(1.0), F.abs(d) / F.col("reach")), 3), 3) + 1e-12
    sums = near.groupBy(*CURVE, "v").agg(*[F.sum(x).alias(c) for c, x in {"w": w, "wx": w * d, "wxx": w * d * d, "wy": w * y, "wxy": w * d * y}.items()])
    spread = F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w")
    slope = F.when(spread > 1e-9, (F.col("wxy") - F.col("wx") * F.col("wy") / F.col("w")) / spread).otherwise(0.0)
    lines = sums.withColumn("b", slope).select(*CURVE, "v", "b", ((F.col("wy") - F.col("b") * F.col("wx")) / F.col("w")).alias("a"))
    lines = lines.join(at.select(*CURVE, "v", "x"), [*CURVE, "v"])
    ahead = lines.select(*CURVE, (F.col("v") - 1).alias("v"), *[F.col(c).alias(f"{c}1") for c in ("a", "b", "x")])
    cells = lines.join(ahead, [*CURVE, "v"])
    cell = F.least(F.col("n_cells") - 1, F.expr("((i + 1) * n_cells - 1) div greatest(1, n - 1)"))
    met = placed.withColumn("v", cell).join(small(cells), [*CURVE, "v"])
    return met.select(*CURVE, "loc", "cumscore", "i", "n", blended().alias("fit"))


def blended() -> Column:
    """The cubic with values a, a1 and slopes b, b1 at x, x1."""
    width = F.col("x1") - F.col("x")
    t = F.when(width > 0, (F.col("loc") - F.col("x")) / width).otherwise(0.0)
    return F.col("a") * (1 + 2 * t) * (1 - t) * (1 - t) + F.col("b") * width * t * (1 - t) * (1 - t) + F.col("a1") * t * t * (3 - 2 * t) - F.col("b1") * width * t * t * (1 - t)


def local_maxima(rows: DataFrame, reach: int) -> DataFrame:
    """The rows (with fit) that no place within `reach` places exceeds, of those with so many on either side."""
    block = [*CURVE, F.expr(f"i div {2 * reach + 1}")]
    runs = rows.select(*CURVE, "i", "n", "loc", "fit", F.max("fit").over(Window.partitionBy(*block).orderBy("i")).alias("so_far"), F.max("fit").over(Window.partitionBy(*block).orderBy(F.desc("i"))).alias("from_here"))
    runs = stored(runs)
    first = runs.select(*CURVE, (F.col("i") + reach).alias("i"), "from_here")
    last = runs.select(*CURVE, (F.col("i") - reach).alias("i"), "so_far")
    met = runs.select(*CURVE, "i", "n", "loc", "fit").join(first, [*CURVE, "i"]).join(last, [*CURVE, "i"])
    return met.where(F.col("fit") >= F.greatest("from_here", "so_far")).select(*CURVE, "i", "loc", "fit")


def regions(rows: DataFrame, tops: DataFrame, max_dist: float | None, buffer: int, one_level: bool) -> DataFrame:
    """(strand, pwm_id, max_peak_loc, half_width, left, right) around the peaks (strand, pwm_id, p: place, or null) of rows with fit.

    From the peak, itself included, a region reaches on either side one place beyond the buffer-th that lies below a level, the
    mid-range of the fit on that side (one_level: of all of it), and at most 250. Without a peak, with one farther than max_dist
    (None: half the number of places), or where a side has too few places, there are nulls. Half widths have two digits at least.
    """
    met = rows.join(small(tops), CURVE)
    side = lambda c: F.lit(True) if one_level else c
    left, right = F.col("i") <= F.col("p"), F.col("i") >= F.col("p")
    mid = lambda c: (F.min(F.when(c, F.col("fit"))) + F.max(F.when(c, F.col("fit")))) / 2
    levels = met.groupBy(*CURVE, "p").agg(mid(side(left)).alias("left_level"), mid(side(right)).alias("right_level"), F.max(F.when(F.col("i") == F.col("p"), F.col("loc"))).alias("peak"), F.max("n").alias("n"))
    levels = stored(levels)
    met = rows.join(small(levels.drop("n")), CURVE)

    def nth(where: Column, order: Column) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*CURVE).orderBy(order))
        return met.where(where).select(*CURVE, "i").withColumn("rank", rank).where(F.col("rank") == buffer).select(*CURVE, "i")

    l_end = nth(left & (F.col("fit") < F.col("left_level")), F.desc("i")).select(*CURVE, (F.col("i") - 1).alias("li"))
    r_end = nth(right & (F.col("fit") < F.col("right_level")), F.asc("i")).select(*CURVE, (F.col("i") + 1).alias("ri"))
    ends = levels.join(l_end, CURVE, "left").join(r_end, CURVE, "left")
    places = rows.join(small(ends.select(*CURVE, "li", "ri")), CURVE).where("i = li OR i = ri")
    places = places.groupBy(*CURVE).agg(*[F.max(F.when(F.col("i") == F.col(c), F.col("loc"))).alias(c[0]) for c in ("li", "ri")])
    found = ends.join(places, CURVE, "left")
    half = (F.col("r") - F.col("l")) / 2
    far = F.col("n") / 2 if max_dist is None else F.lit(float(max_dist))
    ok = F.col("peak").isNotNull() & (F.abs("peak") <= far) & F.col("l").isNotNull() & F.col("r").isNotNull()
    wide = half > CAP
    plain = F.when(half >= 10, F.bround(half)).otherwise(F.bround(half, 1))
    shown = {"max_peak_loc": F.col("peak"), "half_width": F.when(wide, F.lit(float(CAP))).otherwise(plain), "left": F.when(wide, F.col("peak") - CAP).otherwise(F.col("l")), "right": F.when(wide, F.col("peak") + CAP).otherwise(F.col("r"))}
    return found.select(*CURVE, *[F.when(ok, x).cast("double").alias(c) for c, x in shown.items()])


def smoothed_regions(curves: DataFrame, span: float = 0.05, reach: int = 1000, buffer: int = 2, max_dist: float | None = None) -> DataFrame:
    """Regions of curves (strand, pwm_id, loc, cumscore) on their regression over a share of the places.

    The peak is the local maximum within `reach` places that has the fewest places to the highest one, of equal ones the first.
    """
    rows = stored(fitted(numbered(curves), span))
    highest = rows.groupBy(*CURVE).agg((-F.max(F.struct("fit", (-F.col("i")).alias("m")))["m"]).alias("m"))
    tops = local_maxima(rows, reach).join(small(highest), CURVE)
    tops = tops.groupBy(*CURVE).agg(F.min(F.struct(F.abs(F.col("i") - F.col("m")).alias("far"), "i"))["i"].alias("p"))
    return regions(rows, stored(highest.join(tops, CURVE, "left").select(*CURVE, "p")), max_dist, buffer, False)


def midrange_regions(curves: DataFrame, max_dist: float | None = 4000, buffer: int = 5) -> DataFrame:
    """Regions of raw curves: the first highest place, and the level half-way between the lowest and the highest score."""
    rows = stored(numbered(curves).withColumn("fit", F.col("cumscore")))
    tops = rows.groupBy(*CURVE).agg((-F.max(F.struct("fit", (-F.col("i")).alias("m")))["m"]).alias("p"))
    return regions(rows, stored(tops), max_dist, buffer, True)
