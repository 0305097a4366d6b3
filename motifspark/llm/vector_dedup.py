"""Operator 1: near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A bounded sample teaches rotations of the principal axes (Gong and Lazebnik 2011); thresholds at the sample's medians make
every bit of the codes balanced. The bits are cut into substrings, one for each table, and there are more tables the wider
the substrings, so that the chance to miss a pair at the threshold stays the same; vectors of a label that agree on a
substring are candidates, and their cosine is computed from the original vectors in double precision. Equal vectors are
one class. Buckets are dealt out in pairs of blocks; a task returns link counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bins_for, block_pairs, components, forest, in_bins, stored

COSINE = 0.93
SAMPLE = 10_000  # vectors that the rotations are learned from
TABLES = 16  # at least
RECALL = 0.98  # least chance that a pair at the threshold agrees in some table
BLOCK = 1024
BUCKET = 32  # vectors of a bucket that substrings are made for
LEAST_BITS, MOST_BITS = 8, 20  # of a substring


def rotations(sample: np.ndarray, n_bits: int, rounds: int = 30, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(projection, thresholds): codes are sample @ projection > thresholds. One rotation for as many bits as axes."""
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    centred = sample - sample.mean(0)
    _, _, axes = np.linalg.svd(centred.T @ centred)
    parts, bits = [], 0
    while bits < n_bits:
        v = centred @ axes.T
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(axes.T @ r)
        bits += dim
    projection = np.concatenate(parts, 1)[:, :n_bits]
    return projection, np.median(sample @ projection, 0)


def n_tables(width: int, cosine: float) -> int:
    """Tables of `width` bits in which vectors at this cosine agree on a substring with a chance of RECALL; a bit agrees by their angle."""
    agree = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** width
    return max(TABLES, math.ceil(math.log(1 - RECALL) / math.log1p(-agree))) if 0 < agree < 1 else TABLES


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _stack(column: pd.Series, dim: int) -> np.ndarray:
    """Vectors as rows, those of another length cut or filled with zeros."""
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        v = np.asarray(v, float)[:dim]
        out[i, : len(v)] = v
    return out


def substrings(classes: DataFrame, sample: np.ndarray, width: int, tables: int) -> DataFrame:
    """classes with codes, an array of one substring of `width` bits for each table."""
    dim = sample.shape[1]
    projection, thresholds = rotations(_unit(sample), tables * width)
    model = classes.sparkSession.sparkContext.broadcast((projection, thresholds))
    weights = 1 << np.arange(width)

    @F.pandas_udf("array<int>")
    def codes(vectors: pd.Series) -> pd.Series:
        p, t = model.value
        rows = _stack(vectors, dim)
        bits = _unit(np.where(rows.any(1, keepdims=True), rows, 1.0)) @ p > t
        return pd.Series(list(bits.reshape(len(bits), tables, width) @ weights))

    return classes.withColumn("codes", codes("vector"))


def _linked(group: pd.DataFrame, cosine: float) -> Iterator[pd.DataFrame]:
    """Link counts (a, n) and a spanning forest (a, b) of the links within one pair of blocks.

    A pair counts in the first table whose bucket it shares; a pair of one block counts only where the block meets itself.
    """
    lo, hi, t = int(group["lo"].iloc[0]), int(group["hi"].iloc[0]), int(group["t"].iloc[0])
    x, ids, own = _unit(np.stack(group["vector"].to_numpy()).astype(float)), group["rep"].to_numpy(), group["own"].to_numpy()
    near = x @ x.T >= cosine
    near &= (own[:, None] != own[None, :]) | (lo == hi)
    np.fill_diagonal(near, False)
    if not near.any():
        return
    root = forest(near)
    at = np.flatnonzero(root != np.arange(len(ids)))
    yield pd.DataFrame({"a": ids[at], "b": ids[root[at]], "n": 0})
    codes = np.stack(group["codes"].to_numpy())
    for k in range(t):
        near &= codes[:, None, k] != codes[None, :, k]
    n = near @ group["copies"].to_numpy()
    at = np.flatnonzero(n)
    yield pd.DataFrame({"a": ids[at], "b": ids[at], "n": n[at]})


def vector_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, sample_rows: int = SAMPLE, width: int | None = None) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their lengths equal, and their cosine, in double precision, is at
    least `cosine`. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows
    without an id; they are components of their own. Rows that repeat an id are vectors of their own in n_links, and one node of
    the components. Without `width`, substrings get so many bits that a bucket holds about `BUCKET` classes of a label. The number of tables follows from the width, see `n_tables`.
    """
    vector = F.col("vector")
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & F.exists(vector, lambda x: x != 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = stored(rows.where("good").groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("size", F.size("vector")))
    sample = classes.orderBy(F.xxhash64(F.lit(1), "rep"), "rep").limit(sample_rows).select("vector").toPandas()["vector"]
    plain = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if len(sample):
        sizes = pd.Series([len(v) for v in sample]).value_counts()
        dim = int(sizes.index[0])
        if width is None:
            busiest = classes.groupBy("label").count().agg(F.max("count")).first()[0]
            width = max(LEAST_BITS, min(MOST_BITS, math.ceil(math.log2(busiest / BUCKET + 1))))
        coded = stored(substrings(classes, _stack(sample, dim), width, n_tables(width, cosine)))
        keys = ["label", "size", "t", "code"]
        dealt = coded.select("*", F.posexplode("codes").alias("t", "code"))
        counts = stored(dealt.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"))
        met = block_pairs(dealt, counts, keys, ["rep", "vector"], BLOCK)
        found = stored(in_bins(met, [*keys, "lo", "hi"], bins_for(counts, BLOCK, 8192), lambda g: _linked(g, cosine), "a bigint, b bigint, n bigint"))
        roots = components(found.where("a <> b"))
        links = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
        named = classes.join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        named = stored(named.select(F.col("label").alias("c_label"), F.col("vector").alias("c_vector"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
        linked = rows.where("good").join(named, (F.col("label") == F.col("c_label")) & (F.col("vector") == F.col("c_vector")))
        plain = plain.unionByName(linked.select("id", "n_links", "component_id"))
    return plain.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
