"""Operator 11: the k highest integer inner products of each query, by columnar branch and bound.

Vectors are packed into blocks in vertical layout (a dimension's values lie together). A task holds a block of queries and
streams candidate blocks past it. Inner products are accumulated dimension block by dimension block, those of most mass first;
by Cauchy-Schwarz the dimensions still open can add at most the product of both sides' remaining norms, so a candidate whose
sum and remaining mass stay below a query's k-th best score so far is dropped. Few survivors are compacted into pairs, and only
their open dimensions are read. Bounds only drop what cannot be among the k, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

QUERIES, CANDIDATES = 4096, 4096  # vectors of a block
RUN = 16  # candidate blocks that a task compares with a block of queries, at most
STEP = 16  # dimensions of a block
CHUNK = 256  # queries whose sums a task holds at once
EXACT = 2.0**53  # whole numbers below are exact doubles
LONG = 2**63 - 1


def usable(vector: Column, scale: float) -> Column:
    """Whether a vector and its scaled components are finite and not null."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double") * scale) < float("inf")) & ~F.isnan(x), F.lit(False)))


def top_products(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERIES, candidate_block: int = CANDIDATES) -> DataFrame:
    """(query_id, rank, id, score): each query's k highest inner products of components floor(scale * x), ties to smaller ids.

    is_query: a condition over the column id. Candidates are all rows of another id. Rows with a null id, and vectors that are null, hold a null or
    non-finite component or one beyond the doubles when scaled, take no part. A query whose id comes more than once is asked
    once, with the smallest of its vectors; rows that repeat a candidate are candidates each. Of vectors of different lengths
    the shorter one counts as filled up with zeros; the empty one scores 0. Scores beyond a long are its ends, and tie there. Fewer than k
    candidates: all of them; no queries or an empty table: no rows. Other columns, whatever their names, have no influence.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"), scale))
    asked = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    candidates, n_candidates = _blocks(rows, candidate_block, scale)
    queries, n_queries = _blocks(asked, query_block, scale)
    slots = -(-spark.sparkContext.defaultParallelism * 2 // n_queries)
    runs = min(n_candidates, max(slots, -(-n_candidates // RUN)))  # runs of candidate blocks for each block of queries
    one = queries.select(F.lit(0).alias("kind"), F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "ids", "kept", "cells")
    other = candidates.select(F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("q"), F.pmod("block", F.lit(runs)).alias("run"), "ids", "kept", "cells")
    dealt = one.unionByName(other).repartition(n_queries * runs, "q", "run").sortWithinPartitions("q", "run", "kind")
    found = dealt.mapInArrow(lambda batches: _search(batches, k), "query_id bigint, id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id", "at")
    # equal rows of a candidate differ by at alone; the limit by rank is applied before the exchange, too
    ranked = found.withColumn("at", F.monotonically_increasing_id()).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _blocks(rows: DataFrame, size: int, scale: float) -> tuple[DataFrame, int]:
    """(block, ids, kept, cells) of (id, v), a row for each of n blocks of about `size` vectors; and n.

    kept: type of the cells; cells: floor(scale * v), dimension after dimension. Rows are dealt in turn, so that no id makes a block larger.
    """
    n = max(1, -(-rows.count() // size))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, cells = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for batch in batches:
            v = batch.column(1)
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            lengths.append(np.diff(v.offsets.to_numpy()))
            cells.append(np.floor(scale * v.flatten().to_numpy(zero_copy_only=False)))
        ids, lengths, cells = map(np.concatenate, (ids, lengths, cells))
        if not len(ids):
            return
        table = np.zeros((int(lengths.max()), len(ids)))
        row = np.repeat(np.arange(len(ids)), lengths)
        table[np.arange(len(cells)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = cells
        kind = "<i2" if np.abs(cells).max(initial=0) < 2**15 else "<i4" if np.abs(cells).max(initial=0) < 2**31 else "<f8"
        columns = [[TaskContext.get().partitionId()], [ids.astype("<i8").tobytes()], [kind], [table.astype(kind).tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.string(), pa.binary()), strict=True)], ["block", "ids", "kept", "cells"])

    return stored(rows.repartition(n).mapInArrow(pack, "block int, ids binary, kept string, cells binary")), n


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query of a block among the candidate blocks that follow it."""
    best = None
    for batch in batches:
        for kind, _, _, ids, kept, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = np.frombuffer(ids, "<i8")
            table = np.frombuffer(cells, kept).reshape(-1, len(ids)).astype(float)
            if kind == 0:
                if best is not None:
                    yield best.rows()
                best = Best(ids, table, k)
            elif best is not None:
                best.add(ids, table)
    if best is not None:
        yield best.rows()


class Best:
    """The k best candidates seen so far of each of a block's queries (ids; table: dimensions by queries)."""

    def __init__(self, ids: np.ndarray, table: np.ndarray, k: int) -> None:
        self.ids, self.table, self.k = ids, table, k
        self.found = [(np.empty(0, np.int64), np.empty(0)) for _ in ids]  # ids and scores, best first

    def floor(self, i: int) -> float:
        """What a candidate's score must reach to be among the k of query i."""
        score = self.found[i][1]
        return score[-1] if len(score) == self.k else -np.inf

    def put(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.found[i][0], ids)), np.concatenate((self.found[i][1], scores))
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[i] = ids[order], scores[order]

    def add(self, ids: np.ndarray, table: np.ndarray) -> None:
        d = min(len(table), len(self.table))  # what one side lacks is zero
        table, mine = table[:d], self.table[:d]
        if np.abs(table).max(initial=0) * np.abs(mine).max(initial=0) * d >= EXACT:
            whole = [np.array([[int(x) for x in row] for row in t.T.tolist()], object).reshape(-1, d) for t in (mine, table)]
            for i, q in enumerate(whole[0]):
                scores = whole[1] @ q if d else np.zeros(len(ids), object)
                scores = np.array([max(-LONG - 1, min(LONG, x)) for x in scores], object)
                self.put(i, ids[ids != self.ids[i]], scores[ids != self.ids[i]])
            return
        order = np.argsort(-(np.square(table).sum(1) * np.square(mine).sum(1)), kind="stable")
        table, mine = np.ascontiguousarray(table[order]), np.ascontiguousarray(mine[order])
        ends = list(range(0, d, STEP)) + [d] if d else [0, 0]
        # norms of the dimensions from each end on
        rest = [np.stack([np.sqrt(np.square(t[e:]).sum(0)) for e in ends[1:]]) for t in (mine, table)]
        for at in range(0, len(self.ids), CHUNK):
            self._chunk(slice(at, min(at + CHUNK, len(self.ids))), ids, table, mine, ends, rest)

    def _chunk(self, part: slice, ids: np.ndarray, table: np.ndarray, mine: np.ndarray, ends: list[int], rest: list[np.ndarray]) -> None:
        floors = np.array([self.floor(i) for i in range(part.start, part.stop)], float)
        q = mine[:, part]
        if not np.isfinite(floors).all():  # the first candidates are scored in full, for a bound
            some = min(len(ids), 8 * self.k)
            self._keep(part, ids[:some], q.T @ table[:, :some], floors)
            ids, table, rest = ids[some:], table[:, some:], [rest[0], rest[1][:, some:]]
            floors = np.array([self.floor(i) for i in range(part.start, part.stop)], float)
        sums = np.zeros((part.stop - part.start, len(ids)))
        for step, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            sums += q[a:b].T @ table[a:b]
            reach = sums + rest[0][step][part, None] * rest[1][step] * (1 + 1e-9) + 1e-3
            alive = reach >= floors[:, None]
            if b < len(q) and alive.mean() > 0.2:
                continue
            who, which = np.nonzero(alive)
            return self._pairs(part, ids, table, q, ends[step + 1 :], rest, step, who, which, sums[who, which], floors)
        return None

    def _pairs(self, part: slice, ids: np.ndarray, table: np.ndarray, q: np.ndarray, ends: list[int], rest: list[np.ndarray], step: int, who: np.ndarray, which: np.ndarray, sums: np.ndarray, floors: np.ndarray) -> None:
        """Survivors as pairs (query, candidate): only they go on, and fewer after each dimension block."""
        for a, b in zip(ends, ends[1:], strict=False):
            step += 1
            sums = sums + np.einsum("ij,ij->j", q[a:b, who], table[a:b, which])
            alive = sums + rest[0][step][part][who] * rest[1][step][which] * (1 + 1e-9) + 1e-3 >= floors[who]
            who, which, sums = who[alive], which[alive], sums[alive]
        bounds = np.searchsorted(who, np.arange(part.stop - part.start + 1))
        for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            own = ids[which[a:b]] != self.ids[part.start + i]
            if own.any():
                self.put(part.start + i, ids[which[a:b]][own], sums[a:b][own])

    def _keep(self, part: slice, ids: np.ndarray, scores: np.ndarray, floors: np.ndarray) -> None:
        for i, row in enumerate(scores):
            own = (ids != self.ids[part.start + i]) & (row >= floors[i])
            self.put(part.start + i, ids[own], row[own])

    def rows(self) -> pa.RecordBatch:
        sizes = [len(x) for x, _ in self.found]
        scores = [int(x) for _, s in self.found for x in s]
        columns = [np.repeat(self.ids, sizes), np.concatenate([x for x, _ in self.found]) if self.found else np.empty(0, np.int64), scores]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "id", "score"])
