"""Regions of enrichment: peak calling on cumulative score curves."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUFFER, CAP = 5, 250


def two_digits(x: Column) -> Column:
    """Rounded half up to two significant digits, for positive numbers."""
    power = F.pow(F.lit(10.0), 1 - F.floor(F.log10(x)))
    return F.when(x > 0, F.floor(x * power + 0.5) / power).otherwise(x)


def peaks(curves: DataFrame, max_up: int, max_down: int, first_tie: bool = False) -> DataFrame:
    """(strand, pwm_id, max_peak_loc, half_width, left, right, background) of curves (strand, pwm_id, loc, cumscore).

    The background is the mean outside [max_up, max_down], to two places (half even). From the highest place (of ties the
    last) the region reaches, on either side, one place beyond the fifth that lies below the background, or to the curve's end.
    A peak outside the range or at an end of its region gives nulls; regions wider than 500 are cut to 250 on either side.
    Without places outside the range there is no background and the region is the whole curve.
    """
    keys = ["strand", "pwm_id"]
    by = Window.partitionBy(*keys)
    order = by.orderBy("loc")
    outside = (F.col("loc") < max_up) | (F.col("loc") > max_down)
    best = F.struct("cumscore", (-F.col("loc") if first_tie else F.col("loc")).alias("at"))
    rows = curves.select(*keys, "loc", "cumscore", (F.row_number().over(order) - 1).alias("k"), F.bround(F.avg(F.when(outside, F.col("cumscore"))).over(by), 2).alias("background"), F.max(best).over(by)["at"].alias("at"), F.max("loc").over(by).alias("end"))
    peak = (-F.col("at") if first_tie else F.col("at")).alias("peak")
    rows = rows.select(*keys, "loc", "k", "background", peak, "end", F.coalesce(F.col("cumscore") < F.col("background"), F.lit(False)).cast("int").alias("below"))
    rows = rows.withColumn("pk", F.max(F.when(F.col("loc") == F.col("peak"), F.col("k"))).over(by))
    down = F.sum(F.when(F.col("k") <= F.col("pk"), F.col("below")).otherwise(0)).over(by.orderBy(F.desc("k")))
    up = F.sum(F.when(F.col("k") >= F.col("pk"), F.col("below")).otherwise(0)).over(by.orderBy("k"))
    rows = rows.withColumns({"down": down, "up": up})
    fifth = F.col("below") == 1
    l5 = F.max(F.when(fifth & (F.col("down") == BUFFER) & (F.col("k") <= F.col("pk")), F.col("k"))).over(by)
    r5 = F.min(F.when(fifth & (F.col("up") == BUFFER) & (F.col("k") >= F.col("pk")), F.col("k"))).over(by)
    rows = rows.withColumns({"l5": l5, "r5": r5, "last": F.max("k").over(by)})
    rows = rows.withColumns({"li": F.greatest(F.lit(0), F.coalesce(F.col("l5") - 1, F.lit(0))), "ri": F.least("last", F.coalesce(F.col("r5") + 1, F.col("last")))})
    found = rows.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("peak", "pk", "background", "li", "ri")],
        F.max(F.when(F.col("k") == F.col("li"), F.col("loc"))).alias("l"),
        F.max(F.when(F.col("k") == F.col("ri"), F.col("loc"))).alias("r"),
    )
    half = (F.col("r") - F.col("l")) / 2
    ok = F.col("peak").between(max_up, max_down) & (F.col("li") != F.col("pk")) & (F.col("ri") != F.col("pk"))
    wide = half > CAP
    return found.select(*keys, F.when(ok, F.col("peak")).alias("max_peak_loc"), F.when(ok, two_digits(F.least(half, F.lit(float(CAP))))).alias("half_width"), F.when(ok, F.when(wide, F.col("peak") - CAP).otherwise(F.col("l"))).alias("left"), F.when(ok, F.when(wide, F.col("peak") + CAP).otherwise(F.col("r"))).alias("right"), "background")


def roe_table(found: DataFrame, pwms: DataFrame, strands: tuple[str, ...] = ("FWD", "REV")) -> DataFrame:
    """One row for each matrix and strand, in the library's order; matrices without hits have nulls, so rows stay aligned."""
    every = pwms.select(F.col("pwm_idx").alias("row_idx"), "pwm_id").withColumn("strand", F.explode(F.array(*map(F.lit, strands))))
    return every.join(found, ["strand", "pwm_id"], "left").select("row_idx", "pwm_id", "strand", "max_peak_loc", "half_width", "left", "right")


def search_range(n: int, nucs_after_tss: int, flank: int = 1000) -> tuple[int, int]:
    """Range of places that a peak may lie in: the sequence without `flank` places at either end."""
    return -(n - (nucs_after_tss + 1) - flank), nucs_after_tss + 1 - flank


def local_lines(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """At each place the value of a line fitted to the k nearest places by index, with tricube weights of their distance."""
    n = len(x)
    fit = np.empty(n)
    step = max(1, (1 << 21) // k)
    for at in range(0, n, step):  # so many places at once that a matrix holds 2 M numbers
        i = np.arange(at, min(n, at + step))
        near = np.clip(i - k // 2, 0, n - k)[:, None] + np.arange(k)
        xs, ys = x[near], y[near]
        d = np.abs(xs - x[i, None])
        w = (1 - np.minimum(1, d / np.maximum(d.max(1, keepdims=True), 1e-12)) ** 3) ** 3 + 1e-12
        total = w.sum(1)
        mx, my = (w * xs).sum(1) / total, (w * ys).sum(1) / total
        dx = xs - mx[:, None]
        slope = (w * dx * (ys - my[:, None])).sum(1) / np.maximum((w * dx * dx).sum(1), 1e-12)
        fit[i] = my + slope * (x[i] - mx)
    return fit


def highest_near(x: np.ndarray, y: np.ndarray, reach: float) -> np.ndarray:
    """The largest y within reach of each x (sorted), from maxima over runs of 1, 2, 4, ... places."""
    lo, hi = np.searchsorted(x, x - reach, "left"), np.searchsorted(x, x + reach, "right")
    runs = [y]
    while 2 ** len(runs) <= len(y):
        half = 2 ** (len(runs) - 1)
        runs.append(np.maximum(runs[-1][:-half], runs[-1][half:]))
    level = np.floor(np.log2(hi - lo)).astype(int)
    out = np.empty(len(y))
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.maximum(runs[k][lo[at]], runs[k][hi[at] - 2**k])
    return out


def smoothed_peaks(curves: DataFrame, span: float = 0.05, max_dist: int = 4000, buffer: int = 2) -> DataFrame:
    """Regions on locally regressed curves: tricube-weighted lines over a share of the places, threshold at mid-range.

    The local maximum (within 1000 places) nearest the global one is the peak; it reaches past `buffer` places below the
    threshold and at most 250 on either side. One curve per matrix and strand is a task's group: as long as a sequence.
    """

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("loc")
        x, y = pdf["loc"].to_numpy(float), pdf["cumscore"].to_numpy(float)
        n = len(x)
        fit = local_lines(x, y, min(n, max(3, math.ceil(span * n))))
        level = (fit.min() + fit.max()) / 2
        tops = np.flatnonzero(fit >= highest_near(x, fit, 1000))
        p = int(tops[np.abs(x[tops] - x[int(y.argmax())]).argmin()])
        below = np.flatnonzero(fit < level)
        down, up = below[below <= p][::-1], below[below >= p]
        reach = (down[buffer - 1] - 1 if len(down) >= buffer else 0, up[buffer - 1] + 1 if len(up) >= buffer else n - 1)
        left, right = max(x[max(0, reach[0])], x[p] - CAP), min(x[min(n - 1, reach[1])], x[p] + CAP)
        good = abs(x[p]) <= max_dist and left < x[p] < right
        return pd.DataFrame({"strand": [pdf["strand"].iloc[0]], "pwm_id": [pdf["pwm_id"].iloc[0]], "max_peak_loc": [x[p] if good else None], "half_width": [(right - left) / 2 if good else None], "left": [left if good else None], "right": [right if good else None]})

    return curves.groupBy("strand", "pwm_id").applyInPandas(call, "strand string, pwm_id string, max_peak_loc double, half_width double, left double, right double")
