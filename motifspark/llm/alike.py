"""Links between texts that share most of their word shingles, for near-duplicate stages.

A 64-bit SimHash of a whole text tells copies within a few bits, but texts at a Jaccard similarity of 0.8 differ in ten
bits or so, beyond any grid. So each text also has TABLES fingerprints, each the SimHash of a min-wise sample of SAMPLE
of its shingles; texts at similarity s share a table's sample with probability near s^SAMPLE (at 0.8: 0.41 for a table, 0.99997 for some table).
Texts that share a fingerprint are compared on their shingle hashes, and links are returned as a spanning forest of each
group, so components are those of all pairs. Groups of the same texts in several tables are compared once, and full ones
are dealt out in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bins_for, block_pairs, in_bins, stored

SEED = 42
TABLES = 20
SAMPLE = 4  # shingles of a sample
SKETCH = 1024  # hashes of a text that are compared: all of them up to so many shingles, the smallest of longer texts
BLOCK = 512  # texts of a block
MASKS = np.random.default_rng(SEED).integers(1, 1 << 63, (2, TABLES), dtype=np.uint64) | np.uint64(1)
TOP = np.uint64(0xFFFFFFFF)


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """Sorted different hashes of the shingles of a text in UTF-8; of the whole sequence where words are fewer."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) > width else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), np.uint64))


def sample_prints(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of each table's sample, as signed 64-bit integers."""
    n, out = len(hashes), []
    step = max(1, (1 << 20) // max(n, 1))  # tables at once, so that a very long text stays within a few MB
    for at in range(0, TABLES if n else 0, step):
        mixed = (hashes[None, :] ^ MASKS[0, at : at + step, None]) * MASKS[1, at : at + step, None]
        least = np.partition(mixed, SAMPLE - 1, axis=1)[:, :SAMPLE] if n > SAMPLE else mixed
        bits = np.unpackbits(np.ascontiguousarray(least).astype(">u8").view(np.uint8).reshape(len(least), -1, 8), axis=2).sum(1, dtype=np.int32)
        out.append(np.packbits(2 * bits > least.shape[1], axis=1).view(">i8").reshape(-1).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:SKETCH]


def prints_and_samples(docs: DataFrame, id_col: str, text_col: str, width: int, whole: Callable[[bytes], int]) -> DataFrame:
    """(id, mark, fp) as simhash.fingerprints gives them, fp by `whole`, with samples (array), sketch (binary) and body, a hash of the sketch."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("data"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, samples, sketches, body = [], [], [], []
            for value in batch.column(2):
                data = value.as_py()
                hashes = shingle_hashes(data, width)
                sketches.append(sketch(hashes).tobytes())
                body.append(xxhash.xxh64_intdigest(sketches[-1]) - (1 << 63))
                samples.append(sample_prints(hashes))
                fp.append(whole(data))
            columns = [batch.column(0), batch.column(1), pa.array(fp, pa.int64()), pa.array(samples, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(body, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "fp", "samples", "sketch", "body"])

    return rows.mapInArrow(work, f"id {docs.schema[id_col].dataType.simpleString()}, mark bigint, fp bigint, samples array<bigint>, sketch binary, body bigint")


def similar_links(group: pd.DataFrame, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) of a spanning forest of all pairs of the group's sketches that are at least so similar.

    Breadth first: each text reached is compared with all that are not yet reached, so a group of copies takes one pass.
    Of texts of more than SKETCH shingles the hashes below the lower cut of the two are compared, a min-wise sample.
    """
    sets = [np.frombuffer(x, np.uint32) for x in group["sketch"]]
    sizes = np.array([len(s) for s in sets])
    cuts = np.array([s[-1] if len(s) == SKETCH else TOP for s in sets], np.uint64)
    left, flat, owner = np.arange(len(sets)), np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    waiting, found_a, found_b = [], [], []
    while len(left):
        if not waiting:
            waiting, left = [left[0]], left[1:]
        at = waiting.pop()
        open_ = np.zeros(len(sets), bool)
        open_[left] = True
        if 2 * open_[owner].sum() < len(flat):  # drop the hashes of texts that are reached
            flat, owner = flat[open_[owner]], owner[open_[owner]]
        mine = sets[at]
        place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        both = np.bincount(owner[mine[place] == flat], minlength=len(sets))[left]
        theirs = np.bincount(owner[flat <= cuts[at]], minlength=len(sets))[left]
        ours = np.searchsorted(mine, np.minimum(cuts[left], cuts[at]), "right")
        hit = both >= similarity * (ours + theirs - both) - 1e-9
        found_a += [at] * int(hit.sum())
        found_b += left[hit].tolist()
        waiting += left[hit].tolist()
        left = left[~hit]
    return np.array(found_a, np.int64), np.array(found_b, np.int64)


def links(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b) fingerprints, with the components of all pairs of rows (see prints_and_samples) that share a sample and are this similar."""
    points = rows.select("fp", "body", F.explode("samples").alias("key")).distinct()
    groups = points.groupBy("key").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(fp, body))").alias("x"), F.min("fp").alias("least"), F.max("fp").alias("most"))
    groups = groups.where("n > 1 and least <> most").groupBy("n", "x", "least", "most").agg(F.min("key").alias("key"))
    groups = stored(groups.select("key", "n"))
    met = stored(block_pairs(points, groups, ["key"], ["fp", "body"], BLOCK))
    sketches = rows.select("body", "sketch").join(met.select("body").distinct(), "body", "left_semi").dropDuplicates(["body"])

    def work(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        a, b = similar_links(group, similarity)
        fp = group["fp"].to_numpy()
        yield pd.DataFrame({"a": fp[a], "b": fp[b]})

    return in_bins(met.join(sketches, "body"), ["key", "lo", "hi"], bins_for(groups, BLOCK, 8192), work, "a bigint, b bigint").where("a <> b").distinct()
