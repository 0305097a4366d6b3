"""Helpers shared by the corpus operators: tables, scratch tables, pair blocks and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; only a local session without one gets a temporary folder."""
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="motifspark-")
        spark.conf.set(SETTING, base)
    return base.rstrip("/")


_folder: ContextVar[str] = ContextVar("folder", default="")  # of the scratch tables of a step, see own_scratch


def _path(spark: SparkSession, *parts: str) -> str:
    return "/".join([scratch_dir(spark), f"motifspark-{spark.sparkContext.applicationId}", *filter(None, parts)])


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    keep: the table outlives the step that own_scratch cleans up after.
    """
    spark = df.sparkSession
    path = _path(spark, "" if keep else _folder.get(), uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def own_scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within, but for kept ones, are deleted at the end, also after an error."""
    folder = uuid.uuid4().hex
    before = _folder.set(folder)
    try:
        yield
    finally:
        _folder.reset(before)
        _delete(spark, _path(spark, folder))


def drop_scratch(spark: SparkSession) -> None:
    """Delete every table that stored() wrote in this session; results that still read them become invalid."""
    _delete(spark, _path(spark))


def power_of_two(n: float, least: int, most: int) -> int:
    """The smallest power of two that is at least n, kept within [least, most]."""
    p = least
    while p < n and p < most:
        p *= 2
    return p


def bitmap(df: DataFrame, column: str, bits: int) -> bytes:
    """A bitmap of fixed size with bit x mod bits set for every x of a long column; at most bits / 8 bytes reach the driver."""
    at = F.pmod(F.col(column), F.lit(bits)) + 1  # Spark puts 1 to 32768 into bucket 1, and so on
    rows = df.select(at.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("map"))
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for k, part in rows.collect():
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(part, np.uint8)
    return out.tobytes()


def in_bitmap(marked: bytes, values: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bits of integer values are set."""
    at = (values & values.dtype.type(bits - 1)).astype(np.int64)  # bits is a power of two
    return (np.frombuffer(marked, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph of long nodes: (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014) as joins and partial aggregates over
    stored edge tables until nothing changes. Nodes without an edge are not returned; null ends and loops are ignored.
    """
    graph = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = _mark(graph)
    while mark[0]:
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").select("u", "v").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        top = least.where("m < u").select("u", F.col("m").alias("v"))
        large = large.unionByName(top).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        was, mark = mark, _mark(after)
        graph = after
        if mark == was:
            break
    roots = graph.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free digest of the edges, to see whether a step changed them."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first())


def only_kept(docs: DataFrame, keys: list[Column], kept: DataFrame) -> DataFrame:
    """The rows of docs whose keys are those of a row of kept, one for each of its rows.

    kept: (the keys' columns, in order; n), one row per key with the number of rows of docs that have it. Keys compare null-safely.
    Of several rows with the same keys the one with the smallest hash stays, found by partial aggregation. All columns of
    docs stay; names used here cannot clash with them.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[k.alias(f"key{i}") for i, k in enumerate(keys)])
    names = [c for c in kept.columns if c != "n"]
    same = [F.col(f"key{i}").eqNullSafe(F.col(f"kept{i}")) for i in range(len(keys))]
    held = kept.select(*[F.col(c).alias(f"kept{i}") for i, c in enumerate(names)], F.col("n").alias("times"))
    out = rows.join(held, same)
    if not kept.where("n > 1").isEmpty():
        again = out.where("times > 1").groupBy(*[f"key{i}" for i in range(len(keys))]).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        out = out.where("times = 1").select("row").unionByName(again.select("row"))
    return out.select("row.*")


def block_pairs(rows: DataFrame, sizes: DataFrame, keys: list[str], spread: list[str], block: int) -> DataFrame:
    """Cut every group of rows into blocks of about `block` rows and deal out each pair of blocks.

    sizes: (keys, n) with the rows of each group that is to be worked on. Adds lo, hi (the pair of blocks) and own
    (the row's block). Each row is repeated once for each block of its group, so no task gets an unbounded group.
    """
    n_blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(17), *spread), F.col("nb")).cast("int")
    out = rows.join(sizes.select(*keys, n_blocks.alias("nb")), keys).withColumn("own", own)
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return out.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", "nb")


def bins_for(sizes: DataFrame, block: int, rows: int) -> int:
    """Bins that hold about so many rows each, of the rows that block_pairs makes of groups of these sizes."""
    dealt = sizes.agg(F.sum(F.col("n") * F.ceil(F.col("n") / F.lit(block)))).first()[0]
    return 16 + int(dealt or 0) // rows


def in_bins(rows: DataFrame, keys: list[str], n_bins: int, work: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Apply work to every group of rows that agree in keys; many groups share one call, chosen by hash.

    There are as many partitions as bins allow, so that a task's share does not grow with the table.
    """

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [out for _, group in pdf.groupby(keys, sort=False) for out in work(group)]
        return pd.concat(parts) if parts else pd.DataFrame({c.split()[0]: [] for c in schema.split(",")})

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bins // 8)
    binned = rows.withColumn("bin", F.pmod(F.xxhash64(F.lit(29), *keys), F.lit(n_bins)))
    return binned.repartition(parts, "bin").groupBy("bin").applyInPandas(apply, schema)


def forest(linked: np.ndarray) -> np.ndarray:
    """Root (smallest index reachable) of each row of a symmetric boolean matrix."""
    root, n = np.arange(len(linked)), len(linked)
    while True:
        near = np.where(linked, root[None, :], n).min(1, initial=n)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new
