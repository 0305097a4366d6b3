"""Sums of site scores over intervals that differ by sequence, inside the scoring kernel.

Sequences are cut at fixed places relative to the TSS, intervals are listed by the pieces they touch, and each piece meets
lists of its own intervals: the kernel answers them by prefix sums and gives one row for each label, tile, matrix and strand
that has a hit. So the exchanges hold pieces and intervals only, and no hit. Equal intervals are counted first and answered once;
a piece with very many is scored once for each list of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifspark.operators import scan
from motifspark.operators.kernel import Scorer

LIST = 4096  # intervals that a piece meets at once, about
LABEL = ("tissue", "feature_id")


class Tiles:
    """Tiles of a width from -up on, as windows.tiles makes them, numbered from 1."""

    def __init__(self, up: int, down: int, width: int) -> None:
        if width <= 0 or up + down < 0:
            raise ValueError("tiles need a positive width and a range")
        self.up, self.width, self.count = up, width, (up + down) // width

    def clip(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, number, left, right) of every overlap of an inclusive interval with a tile, whose ends are inclusive, too."""
        first = np.maximum(1, -((-left - self.up) // self.width))
        last = np.minimum(self.count, (right + self.up) // self.width + 1)
        n = np.where(left <= right, np.maximum(0, last - first + 1), 0)
        row = np.repeat(np.arange(len(left)), n)
        number = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        low = -self.up + (number - 1) * self.width
        return row, number, np.maximum(left[row], low), np.minimum(right[row], low + self.width)


def _listed(intervals: DataFrame, size: int, most: int) -> DataFrame:
    """(seq_id, piece_no, met: lists of intervals): for each piece that intervals touch, lists of about `most` different ones."""
    rows = intervals.where("left <= right").groupBy("seq_id", *LABEL, "which", "left", "right").agg(F.count("*").alias("times"))
    rows = rows.withColumn("piece_no", F.explode(F.expr(f"sequence(cast(floor(left / {size}) as bigint), cast(floor(right / {size}) as bigint))")))
    sizes = rows.groupBy("seq_id", "piece_no").agg(F.ceil(F.count("*") / most).alias("lists")).where("lists > 1")
    cut = rows.join(F.broadcast(sizes) if sizes.limit(1001).count() <= 1000 else sizes, ["seq_id", "piece_no"], "left")
    cut = cut.withColumn("list", F.when(F.col("lists") > 1, F.pmod(F.xxhash64(*LABEL, "which", "left", "right"), F.col("lists"))).otherwise(0))
    met = F.struct(*LABEL, "which", F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"), "times")
    return cut.groupBy("seq_id", "piece_no", "list").agg(F.collect_list(met).alias("met")).drop("list")


def interval_sums(seqs: DataFrame, scorer: Scorer, intervals: DataFrame, nucs_after_tss: int | None = None, tiles: Tiles | None = None, size: int = scan.PIECE, most: int = LIST) -> DataFrame:
    """(seq_idx, seq_id, tissue, feature_id, win_no, strand, pwm_idx, pwm_id, value, n_hits): sums of the scores above the cutoffs over intervals.

    intervals: seq_id, tissue, feature_id (texts, may be null), which (a place in the scorer's strands by matrices, or null for
    all), left and right (inclusive, relative to the TSS). With tiles, they are cut to the tiles they overlap, and win_no is the
    tile; else it is null. Overlapping intervals of a label add up. Labels without a hit have no row.
    """
    kinds = [(s, p) for s in scorer.strands for p in scorer.pwms]
    window = scorer.background.window if scorer.background.kind == "local" else 0
    width = max((len(p.mat) for p in scorer.pwms), default=1)
    if tiles:
        low, high = -tiles.up, -tiles.up + tiles.count * tiles.width
        intervals = intervals.where(F.col("left").between(low, high) | F.col("right").between(low, high) | ((F.col("left") < low) & (F.col("right") > high)))
        intervals = intervals.withColumns({"left": F.greatest("left", F.lit(low)), "right": F.least("right", F.lit(high))})
    lists = _listed(intervals, size, most)
    n = F.length("seq")
    rows = seqs.select("seq_idx", "seq_id", "seq").where(n > 0).withColumn("tss", n - (F.floor(n / 2) if nucs_after_tss is None else F.lit(nucs_after_tss)))
    first, last = -F.col("tss"), n - 1 - F.col("tss")
    if tiles:
        first, last = F.greatest(first, F.lit(low)), F.least(last, F.lit(high))
    rows = rows.withColumns({"first": first, "last": last}).where("`first` <= `last`")
    rows = rows.withColumn("piece_no", F.explode(F.expr(f"sequence(cast(floor(`first` / {size}) as bigint), cast(floor(`last` / {size}) as bigint))")))
    start = F.greatest(F.col("first"), F.col("piece_no") * size) + F.col("tss")
    end = F.least(F.col("last"), (F.col("piece_no") + 1) * size - 1) + F.col("tss") + 1
    pieces = scan.cut(rows.withColumns({"a": start, "b": end}).drop("first", "last"), F.col("a"), F.col("b"), width, window, size)
    pieces = pieces.select("seq_idx", "seq_id", "piece_no", "n", (F.col("start") - F.col("tss")).alias("from"), "skip", "own", "piece")
    pieces = scan.spread(pieces, "seq_id", "piece_no")  # scoring is the work, so small pieces are not to be put together
    met = pieces.join(lists, ["seq_id", "piece_no"]).select("seq_idx", "seq_id", "n", "from", "skip", "own", "piece", "met")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            lists = batch.column(7)
            for i, (idx, seq_id, n, start, skip, own, seq) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:7]), strict=True)):
                names, code, which, left, right, times = _columns(lists[i].values)
                number = np.zeros(len(left), np.int64)
                if tiles:
                    row, number, left, right = tiles.clip(left, right)
                    code, which, times = code[row], which[row], times[row]
                lo, hi = np.clip(left - start, 0, own), np.clip(right - start + 1, 0, own)
                label, at = np.unique(np.stack((code, number)), axis=1, return_inverse=True)
                at = at.reshape(-1)
                for k, (p, _, score) in enumerate(scorer.scores(seq, n)):
                    mine = score[skip : skip + own]
                    sums, counts = _sums(mine, scorer.cutoff(p), lo, hi)
                    weight = np.where((which < 0) | (which == k), times, 0)
                    hits = np.bincount(at, counts * weight, minlength=label.shape[1])
                    some = (counts > 0) & (weight > 0)
                    values = np.bincount(at[some], sums[some] * weight[some], minlength=label.shape[1])
                    for j in np.flatnonzero(hits):
                        out.append((idx, seq_id, *names[label[0, j]], int(label[1, j]) if tiles else None, k, float(values[j]), int(hits[j])))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["seq_idx", "seq_id", *LABEL, "win_no", "kind", "value", "n_hits"])

    found = met.mapInArrow(work, "seq_idx bigint, seq_id string, tissue string, feature_id string, win_no bigint, kind int, value double, n_hits bigint")
    keys = ["seq_idx", "seq_id", *LABEL, "win_no", "kind"]
    added = found.groupBy(*keys).agg(F.sum("value").alias("value"), F.sum("n_hits").alias("n_hits"))
    named = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("kind") + 1)
    return added.select(*keys[:-1], named([s for s, _ in kinds]).alias("strand"), named([p.pwm_idx for _, p in kinds]).alias("pwm_idx"), named([p.pwm_id for _, p in kinds]).alias("pwm_id"), "value", "n_hits")


def _columns(met: pa.StructArray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different labels, and for each interval the number of its label, its kind (-1: all), ends and times."""
    tissue, feature, which, left, right, times = met.flatten()
    a, b = tissue.dictionary_encode(), feature.dictionary_encode()
    one, other = (x.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    pair, code = np.unique(np.stack((one, other)), axis=1, return_inverse=True)
    word = lambda x, i: x.dictionary[int(i)].as_py() if i >= 0 else None
    names = [(word(a, i), word(b, j)) for i, j in pair.T]
    return (names, code.reshape(-1), which.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), *(x.to_numpy(zero_copy_only=False) for x in (left, right, times)))


def _sums(score: np.ndarray, cutoff: float, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the scores above the cutoff in each [lo, hi); infinite scores are counted apart, as they have no differences."""
    lo, hi = np.minimum(lo, len(score)), np.minimum(hi, len(score))
    hit = score > cutoff  # false for NaN
    count = lambda marks: (s := np.concatenate(([0], np.cumsum(marks))))[np.maximum(hi, lo)] - s[lo]
    sums = count(np.where(hit & np.isfinite(score), score, 0.0))
    above, below = hit & np.isposinf(score), hit & np.isneginf(score)
    if above.any() or below.any():
        with np.errstate(invalid="ignore"):
            sums = sums + np.where(count(above) > 0, np.inf, 0.0) + np.where(count(below) > 0, -np.inf, 0.0)
    return sums, count(hit)
