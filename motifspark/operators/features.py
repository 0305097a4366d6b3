"""Aggregations of site scores over places and windows, and the feature tables made of them.

window_features scores and sums inside one Arrow kernel, by prefix sums: no hit leaves the task. Only what the windows need of
each sequence is moved and scored.
hits_in_windows is the relational form, for intervals that differ by sequence and as the plain form to test against.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifspark.functions.alphabet import content
from motifspark.operators import scan
from motifspark.operators.kernel import Scorer, window_values

BUCKET = 64  # places of a bucket of the range join
CONTENT = (("GCcontent", "GC"), ("CAcontent", "CA"), ("GAcontent", "GA"))
AROUND = 100  # of the TSS, for content features


@dataclass(frozen=True)
class WindowSpec:
    """A feature: sums of one matrix and strand over the inclusive window [left, right], divided by scale."""

    feature_id: str
    pwm_idx: int
    strand: str
    left: int
    right: int
    scale: float = 1.0


def cumulative(hits: DataFrame, strand: str = "BOTH") -> DataFrame:
    """(pwm_id, loc, cumscore) summed over sequences; over both strands or one."""
    if strand not in ("BOTH", "FWD", "REV"):
        raise ValueError("strand is BOTH, FWD or REV")
    kept = hits if strand == "BOTH" else hits.where(F.col("strand") == strand)
    return kept.groupBy("pwm_id", "loc").agg(F.sum("score").alias("cumscore"))


def cumulative_by_strand(hits: DataFrame) -> DataFrame:
    return hits.groupBy("strand", "pwm_id", "loc").agg(F.sum("score").alias("cumscore"))


def hits_in_windows(hits: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Hits joined with windows (keys, left, right) that hold their loc: an equi-join on keys and a bucket of places.

    A window is listed in each bucket it touches and a hit in one, so no pair comes twice; Spark broadcasts the windows only
    if they are small.
    """
    spread = windows.withColumn("bucket", F.explode(F.expr(f"sequence(cast(floor(left / {BUCKET}) as bigint), cast(floor(right / {BUCKET}) as bigint))")))
    placed = hits.withColumn("bucket", F.floor(F.col("loc") / BUCKET).cast("long"))
    return placed.join(spread.where("left <= right"), [*keys, "bucket"]).where(F.col("loc").between(F.col("left"), F.col("right")))


def window_sums(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """(seq_idx, feature_id, value) of windows (pwm_idx, strand, feature_id, left, right) that hold a hit."""
    return hits_in_windows(hits, windows.select("pwm_idx", "strand", "feature_id", "left", "right"), ["pwm_idx", "strand"]).groupBy("seq_idx", "feature_id").agg(F.sum("score").alias("value"))


def _sums(scored: dict, sides: dict, size: int, shift: int) -> np.ndarray:
    """Values of the windows over scored starts; shift: from a window's place to that of a start."""
    row = np.zeros(size)
    for key, (at, left, right, scale) in sides.items():
        if key in scored:
            with np.errstate(divide="ignore", invalid="ignore"):
                row[at] = window_values(*scored[key], left + shift, right + shift) / scale
    return row


def _places(scored: dict, specs: list[WindowSpec], size: int, shift: int) -> np.ndarray:
    """Scores of the places of every window, one window after the other."""
    row, at = np.zeros(size), 0
    for s in specs:
        w = s.right - s.left + 1
        if (s.pwm_idx, s.strand) in scored:
            score, cutoff = scored[s.pwm_idx, s.strand]
            lo, hi = max(0, s.left + shift), min(len(score), s.right + shift + 1)
            if lo < hi:
                part = score[lo:hi]
                row[at + lo - s.left - shift : at + hi - s.left - shift] = np.where(part > cutoff, part, 0.0) / s.scale
        at += w
    return row


def _values(seqs: DataFrame, scorer: Scorer, specs: list[WindowSpec], nucs_after_tss: int | None, by_place: bool, piece: int) -> DataFrame:
    """(seq_idx, seq_id, pos, values) of each row of seqs.

    Only the starts that some window holds are scored. Rows are spread over the tasks; where the windows reach over more
    than a piece, the pieces' values are added up by row, and rows that agree in everything are counted.
    """
    if "pos" not in seqs.columns:
        seqs = seqs.withColumn("pos", F.lit(0))
    seqs = seqs.select("seq_idx", "seq_id", F.col("pos").cast("int").alias("pos"), F.coalesce("seq", F.lit("")).alias("seq"))
    low, high = min((s.left for s in specs), default=0), max((s.right for s in specs), default=-1)
    size = sum(s.right - s.left + 1 for s in specs) if by_place else len(specs)
    by: dict[tuple[int, str], list[int]] = {}
    for i, s in enumerate(specs):
        by.setdefault((s.pwm_idx, s.strand), []).append(i)
    sides = {k: (np.array(v), np.array([specs[i].left for i in v], int), np.array([specs[i].right for i in v], int), np.array([specs[i].scale for i in v], float)) for k, v in by.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pos, n, start, skip, own, seq in zip(*(c.to_pylist() for c in batch.columns[4:]), strict=True):
                tss = n - (n // 2 if nucs_after_tss is None else nucs_after_tss)
                scored = {(p.pwm_idx, strand): (score[skip : skip + own], scorer.cutoff(p)) for p, strand, score in scorer.scores(seq, n)} if own else {}
                out.append(_places(scored, specs, size, pos + tss - start) if by_place else _sums(scored, sides, size, pos + tss - start))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * size, pa.int32()), pa.array(np.concatenate(out) if out else np.empty(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], values], ["seq_idx", "seq_id", "mark", "k", "pos", "values"])

    n = F.length("seq")
    tss = F.col("pos") + n - (F.floor(n / 2) if nucs_after_tss is None else F.lit(nucs_after_tss))
    width = max((len(p.mat) for p in scorer.pwms), default=1)
    window = scorer.background.window if scorer.background.kind == "local" else 0
    wide = high - low + 1 > piece
    seqs = seqs.withColumn("mark", F.sha2("seq", 256) if wide else F.lit(""))  # tells apart rows that repeat a sequence's number and position
    rows = scan.cut(seqs, F.greatest(F.lit(0), F.least(n, tss + low)), F.greatest(F.lit(0), F.least(n, tss + high + 1)), width, window, piece)
    rows = scan.spread(rows.select("seq_idx", "seq_id", "mark", "k", "pos", "n", "start", "skip", "own", "piece"), "seq_idx", "pos", "k")
    found = rows.mapInArrow(work, "seq_idx bigint, seq_id string, mark string, k bigint, pos int, values array<double>")
    if wide:
        each = found.groupBy("seq_idx", "seq_id", "mark", "pos", "k").agg(F.first("values").alias("values"), F.count("*").alias("times"))
        parts = each.groupBy("seq_idx", "seq_id", "mark", "pos").agg(F.array_sort(F.collect_list(F.struct("k", "values"))).alias("parts"), F.max("times").alias("times"))
        added = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.col("parts")[0]["values"], lambda a, x: F.zip_with(a, x["values"], lambda y, z: y + z))
        found = parts.withColumn("values", added).withColumn("copy", F.explode(F.expr("sequence(1L, times)")))
    return found.select("seq_idx", "seq_id", "pos", "values")


def window_features(seqs: DataFrame, scorer: Scorer, specs: list[WindowSpec], nucs_after_tss: int | None = None, piece: int = scan.PIECE) -> DataFrame:
    """(seq_idx, seq_id, pos, values): the features of each sequence and position (column pos, 0 if absent), in order of specs.

    Every row has its own result, also one that repeats another.
    """
    return _values(seqs, scorer, specs, nucs_after_tss, False, piece)


def long_features(table: DataFrame, specs: list[WindowSpec]) -> DataFrame:
    """(sample_id, feature_id, feat_ord, value) of window_features."""
    names = F.array(*[F.lit(s.feature_id) for s in specs])
    rows = table.select(_sample().alias("sample_id"), F.posexplode("values").alias("feat_ord", "value"))
    return rows.select("sample_id", F.element_at(names, F.col("feat_ord") + 1).alias("feature_id"), "feat_ord", "value")


def wide_features(table: DataFrame, specs: list[WindowSpec], *more: Column) -> DataFrame:
    """One row per sample and one column per feature, in order, then more columns."""
    return table.select(_sample().alias("sample"), *[F.col("values")[i].alias(s.feature_id) for i, s in enumerate(specs)], *more)


def pivoted(features: DataFrame, names: list[str]) -> DataFrame:
    """Long features as a wide table, with the columns given, so that Spark looks for none; missing values are 0."""
    return features.groupBy("sample_id").pivot("feature_id", names).agg(F.first("value")).na.fill(0.0, names)


def _sample() -> Column:
    return F.concat_ws("_", "seq_id", F.col("pos").cast("string"))


def content_features(seqs: DataFrame, nucs_after_tss: int | None = None, suffix: str = "", shift: int = 0) -> DataFrame:
    """(sample_id, GC, CA and GA content) within 100 of each position, shifted."""
    if "pos" not in seqs.columns:
        seqs = seqs.withColumn("pos", F.lit(0))
    after = F.floor(F.length("seq") / 2) if nucs_after_tss is None else F.lit(nucs_after_tss)
    left, right = F.col("pos") + shift - AROUND, F.col("pos") + shift + AROUND
    return seqs.select(_sample().alias("sample_id"), *[content(F.col("seq"), bases, left, right, after).alias(name + suffix) for name, bases in CONTENT])


def scores_by_place(seqs: DataFrame, scorer: Scorer, specs: list[WindowSpec], nucs_after_tss: int | None = None, piece: int = scan.PIECE) -> DataFrame:
    """(sample_id, feature_id, place, value): the score of every start in each window as given, 0 where there is no hit.

    Places count from the window's left end; those outside the sequence have value 0, so every sample has the same columns.
    """
    table = _values(seqs, scorer, specs, nucs_after_tss, True, piece)
    ends = np.cumsum([0, *(s.right - s.left + 1 for s in specs)]).tolist()
    own = F.array(*[F.struct(F.lit(s.feature_id).alias("feature_id"), F.lit(a + 1).alias("at"), F.lit(b - a).alias("width")) for s, a, b in zip(specs, ends, ends[1:], strict=False)])
    rows = table.select(_sample().alias("sample_id"), "values", F.explode(own).alias("w"))
    return rows.select("sample_id", "w.feature_id", F.posexplode(F.slice("values", F.col("w.at"), F.col("w.width"))).alias("place", "value"))


def open_tile_features(hits: DataFrame, clipped: DataFrame) -> DataFrame:
    """(seq_id, pwm_id, strand, tissue, win_no, value): hits over open parts of tiles; win_no null is the sum over all tiles."""
    met = hits_in_windows(hits, clipped, ["seq_id"])
    return met.groupingSets([["seq_id", "pwm_id", "strand", "tissue", "win_no"], ["seq_id", "pwm_id", "strand", "tissue"]], "seq_id", "pwm_id", "strand", "tissue", "win_no").agg(F.sum("score").alias("value"))


def open_window_features(hits: DataFrame, intervals: DataFrame) -> DataFrame:
    """(seq_id, feature_id, tissue, value): hits over a feature's own intervals (seq_id, feature_id, pwm_idx, strand, tissue, left, right)."""
    met = hits_in_windows(hits, intervals, ["seq_id", "pwm_idx", "strand"])
    return met.groupBy("seq_id", "feature_id", "tissue").agg(F.sum("score").alias("value"))
