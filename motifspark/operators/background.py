"""Background models: global and local base and pair frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifspark.functions.alphabet import BASES
from motifspark.operators.kernel import Background, encode, local_background, local_counts
from motifspark.operators.scan import PIECE, pieces


def base_frequencies(seqs: DataFrame) -> DataFrame:
    """(base, freq) over all recognised characters, counted per batch before Spark sums them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(5, np.int64)
            for seq in batch.column(0).to_pylist():
                total += np.bincount(encode(seq or "") + 1, minlength=5)
            yield pa.RecordBatch.from_arrays([pa.array(total[i : i + 1]) for i in range(1, 5)], list(BASES))

    counts = seqs.select("seq").mapInArrow(work, ", ".join(f"{b} bigint" for b in BASES))
    sums = counts.agg(*[F.sum(b).alias(b) for b in BASES])
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    return sums.select(F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.try_divide(F.col(b), total).alias("freq")) for b in BASES])).alias("x")).select("x.*")


def pair_counts(seqs: DataFrame) -> DataFrame:
    """(prev, base, n) of adjacent recognised characters, counted per batch before Spark sums them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(16, np.int64)
            for seq in batch.column(0).to_pylist():
                code = encode(seq or "").astype(np.int64)
                both = (code[:-1] >= 0) & (code[1:] >= 0)
                total += np.bincount((code[:-1] * 4 + code[1:])[both], minlength=16)
            yield pa.RecordBatch.from_arrays([pa.array([BASES[i // 4] for i in range(16)]), pa.array([BASES[i % 4] for i in range(16)]), pa.array(total)], ["prev", "base", "n"])

    return seqs.select("seq").mapInArrow(work, "prev string, base string, n bigint").groupBy("prev", "base").agg(F.sum("n").alias("n"))


def pair_frequencies(seqs: DataFrame) -> DataFrame:
    """(prev, base, freq), normalised within prev; null where prev never occurs."""
    total = F.sum("n").over(Window.partitionBy("prev"))
    return pair_counts(seqs).select("prev", "base", F.try_divide(F.col("n"), total).alias("freq"))


def global_background(seqs: DataFrame, first_order: bool = False) -> Background:
    """A Background of all sequences: 4 or 20 numbers reach the driver."""
    m0 = {r.base: r.freq for r in base_frequencies(seqs).collect()}
    m1 = None
    if first_order:
        pairs = {(r.prev, r.base): r.freq for r in pair_frequencies(seqs).collect()}
        m1 = [[np.nan if (x := pairs.get((a, b))) is None else x for b in BASES] for a in BASES]
    return Background("global", [np.nan if (x := m0[b]) is None else x for b in BASES], m1)


def slice_background(seqs: DataFrame, start: int, end: int, first_order: bool = False) -> DataFrame:
    """Frequencies over [start, end) of every sequence, each clipped by its own length."""
    cut = seqs.withColumn("seq", F.substr("seq", F.lit(start + 1), F.lit(max(0, end - start))))
    return pair_frequencies(cut) if first_order else base_frequencies(cut)


def _lists(x: np.ndarray) -> pa.Array:
    """Rows as lists, NaN as null."""
    if not x.shape[1]:
        return pa.array([[]] * len(x), pa.list_(pa.float64()))
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), from_pandas=True), x.shape[1]).cast(pa.list_(pa.float64()))


def local_frequencies(seqs: DataFrame, window: int = 250, first_order: bool = True, piece: int = PIECE) -> DataFrame:
    """(seq_idx, pos, b, b1): arrays of 4 base and 16 pair frequencies around every place, null where undefined."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for idx, n, offset, skip, own, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b, b1 = local_background(encode(seq), window, first_order)
                if n < 2 * window + 1:
                    b[:] = np.nan
                if b1 is not None and n < 2 * window + 2:
                    b1[:] = np.nan
                b1 = np.full((len(b), 0), np.nan) if b1 is None else b1
                mine = slice(skip, skip + own)
                places = pa.array(np.arange(offset + skip, offset + skip + own), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(idx, pa.int64()), own), places, _lists(b[mine]), _lists(b1[mine])], ["seq_idx", "pos", "b", "b1"])

    cut = pieces(seqs.withColumn("seq_id", F.lit("")), 1, window, piece).drop("seq_id")
    return cut.mapInArrow(work, "seq_idx bigint, pos bigint, b array<double>, b1 array<double>")


def local_totals(seqs: DataFrame, window: int = 250, piece: int = PIECE) -> DataFrame:
    """(seq_idx, n_places, b, b1): sums of local_frequencies over the places of each sequence that have a pair frequency, null where there is
    none; added up in the kernel. Sequences without such a place have no row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for idx, n, _, skip, own, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n < 2 * window + 2:
                    continue
                mine = slice(skip, skip + own)
                base, pair = (x[:, mine] for x in local_counts(encode(seq), window))
                held = pair.any(0)
                base, pair = base[:, held], pair[:, held].reshape(4, 4, -1)
                if not base.shape[1]:
                    continue
                each, total = base.sum(0), pair.sum(1)
                b = (base / np.maximum(each, 1)).sum(1)
                b1 = (pair / np.maximum(total, 1)[:, None]).sum(2).ravel()
                b1[np.repeat(~total.any(1), 4)] = np.nan
                rows.append((idx, base.shape[1], b, b1))
            idx, count, b, b1 = zip(*rows, strict=True) if rows else ((), (), (), ())
            lists = [_lists(np.array(x, float).reshape(len(rows), k)) for x, k in ((b, 4), (b1, 16))]
            yield pa.RecordBatch.from_arrays([pa.array(idx, pa.int64()), pa.array(count, pa.int64()), *lists], ["seq_idx", "n_places", "b", "b1"])

    cut = pieces(seqs.withColumn("seq_id", F.lit("")), 1, window, piece).drop("seq_id")
    found = cut.mapInArrow(work, "seq_idx bigint, n_places bigint, b array<double>, b1 array<double>")
    added = lambda name, size: F.array(*[F.sum(F.col(name)[k]) for k in range(size)]).alias(name)
    return found.groupBy("seq_idx").agg(F.sum("n_places").alias("n_places"), added("b", 4), added("b1", 16))


def local_base_frequencies_sql(seqs: DataFrame, window: int = 250) -> DataFrame:
    """(seq_idx, pos, base, freq) by sliding frames: the plain form that local_frequencies is tested against."""
    places = seqs.where(F.length("seq") >= 2 * window + 1).select("seq_idx", F.posexplode(F.split(F.upper("seq"), "")).alias("pos", "c"))
    frame = Window.partitionBy("seq_idx").orderBy("pos").rowsBetween(-window, window)
    counts = [F.sum((F.col("c") == b).cast("int")).over(frame).alias(b) for b in BASES]
    counted = places.select("seq_idx", "pos", *counts)
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    return counted.select("seq_idx", "pos", F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.try_divide(F.col(b), total).alias("freq")) for b in BASES])).alias("x")).select("seq_idx", "pos", "x.*")
