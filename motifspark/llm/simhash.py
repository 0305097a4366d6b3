"""Operator 8: SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 16 four-bit segments. The Manhattan distance of two count
vectors never exceeds the Hamming distance of the fingerprints, so all links lie among vectors at distance 2 or less.
Such vectors have a grid point within distance 1 of both: every distinct fingerprint is put on the at most 33 points of
its unit ball, and fingerprints that meet on a point are verified exactly. Points with two fingerprints give their pair
as a minimum and maximum; fuller ones are dealt out in pairs of blocks, which return a spanning forest of their links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import alike
from .common import bins_for, block_pairs, components, forest, in_bins, only_kept, stored

SEED = alike.SEED
BLOCK = 1024  # fingerprints of a block
MAX_BITS = 2  # of difference; the unit ball covers just this
LOW = 0xFFFFFFFF


def simhash(data: bytes, width: int = 3) -> int:
    """Fingerprint of a text in UTF-8, as a signed 64-bit integer; zero without a word."""
    words = data.lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    if not n:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if n > 1 or len(words) == width else [b" ".join(words)]
    total = np.zeros(64, np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), np.uint64, n).astype(">u8")
    for at in range(0, n, 1 << 14):
        total += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """(id, mark, fp) of each row; mark is a hash of the text as it is."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("data"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(x, width) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())], ["id", "mark", "fp"])

    return rows.mapInArrow(work, f"id {docs.schema[id_col].dataType.simpleString()}, mark bigint, fp bigint")


def _nibble_counts(half: Column) -> Column:
    """Bit counts of the eight nibbles of a 32-bit value, each in its nibble."""
    pairs = half.bitwiseAND(F.lit(0x55555555)) + F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555))
    return pairs.bitwiseAND(F.lit(0x33333333)) + F.shiftright(pairs, 2).bitwiseAND(F.lit(0x33333333))


def cell(fp: Column) -> Column:
    """The vector of the 16 segment counts, as one long with a nibble for each."""
    return F.shiftleft(_nibble_counts(F.shiftrightunsigned(fp, 32)), 32).bitwiseOR(_nibble_counts(fp.bitwiseAND(F.lit(LOW))))


def unit_ball(point: Column) -> Column:
    """The point and its neighbours at Manhattan distance 1, among vectors of counts 0 to 4."""
    near = [point]
    for i in range(16):
        count = F.shiftright(point, 4 * i).bitwiseAND(F.lit(15))
        near += [F.when(count < 4, point + F.lit(1 << 4 * i)), F.when(count > 0, point - F.lit(1 << 4 * i))]
    return F.array_compact(F.array(*near))


def _linked(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A spanning forest of the exact links within one pair of blocks."""
    fp = np.unique(group["fp"].to_numpy())
    root = forest(np.bitwise_count(fp.view(np.uint64)[:, None] ^ fp.view(np.uint64)[None, :]) <= MAX_BITS)
    at = np.flatnonzero(root != np.arange(len(fp)))
    yield pd.DataFrame({"a": fp[at], "b": fp[root[at]]})


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) whose components are those of all pairs of distinct fingerprints (column fp) at 2 or fewer differing bits."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    balls = distinct.select("fp").repartition(parts, "fp")  # the few files of the table would make few tasks
    points = balls.select("fp", F.explode(unit_ball(cell(F.col("fp")))).alias("point"))  # made twice: 33 times as large as stored
    met = stored(points.groupBy("point").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = met.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b").distinct()
    full = met.where("n > 2")
    dealt = block_pairs(points, full, ["point"], ["fp"], BLOCK)
    return pairs.unionByName(in_bins(dealt, ["point", "lo", "hi"], bins_for(full, BLOCK, 20_000), _linked, "a bigint, b bigint").distinct())


def _components(prints: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(id, mark, fp, root, component_id) of each row of prints; more: further links (a, b) of fingerprints."""
    prints = prints.select("id", "mark", "fp")
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("least")))
    near = links(distinct)
    roots = components(near if more is None else near.unionByName(more)).withColumnRenamed("node", "fp")
    rooted = stored(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = stored(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id"))
    # the fingerprint of empty texts may be that of a third of all rows: it is looked up without a shuffle of those
    hot = prints.where("fp = 0").join(F.broadcast(named.where("fp = 0")), "fp")
    return prints.where("fp <> 0").join(named, "fp").unionByName(hot)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hexadecimal digits), component_id.

    Words are cut at ASCII white space and lower-cased in A-Z; shingles of `width` words count with repeats; a shorter
    text is one shingle; a null or blank one has fingerprint zero and links like any other. component_id is the
    smallest id reachable over links of 2 or fewer differing bits; null ids are passed over, and a component of null
    ids alone has null. Rows that repeat an id are fingerprinted one by one. Other columns are not looked at.
    """
    rows = _components(stored(fingerprints(docs, id_col, text_col, width)))
    return rows.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each component, with all its columns: the one of the smallest id.

    Texts are linked by fingerprints as in simhash_groups, and if the Jaccard similarity of their sets of shingles of
    `width` words is at least `similarity` (see alike: all such pairs are found with the probability given there, and all
    links hold exactly for texts of up to 1024 different shingles). Fewer words are one shingle; texts without a word are
    linked with one another only. Null ids come last, so one of them stays only where a component has no other. Of rows of a
    component that repeat its smallest id the one with the smallest fingerprint stays, then the smallest hash of the text,
    then of the row. Rows of other components that repeat an id are not touched. An empty table gives an empty one.
    """
    prints = stored(alike.prints_and_samples(docs, id_col, text_col, width, simhash))
    rows = stored(_components(prints, alike.links(prints, similarity)))
    first = rows.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root", "id", "fp", "mark").agg(F.count("*").alias("n"))
    first = first.groupBy("root").agg(F.min(F.struct("fp", "mark", "id", "n")).alias("x"))
    return only_kept(docs, [F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))], stored(first.select("x.id", "x.mark", "x.n")))
