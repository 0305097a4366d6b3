"""Operator 5: exact duplicates by composable polynomial fingerprints.

A text's fingerprint is its polynomial hash in two bases modulo a prime. Hashes of adjacent pieces combine,
H(ab) = H(a) * B^len(b) + H(b), so texts above `parallel_bytes` are cut into pieces that are hashed in parallel
and summed by Spark, each piece shifted by the bytes behind it. Texts of equal length and fingerprint form a class;
its members are then compared piece by piece, as minimum and maximum of each piece over the class, which Spark
combines on the map side. A class that holds different texts (a collision) is split by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, only_kept, power_of_two, stored

MODULUS = 2**31 - 1
BASES = (1_103_515_245, 1_664_525)
CHUNK = 1 << 16  # bytes hashed by one dot product: sums stay below 2^63
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS = ["n_bytes", "h1", "h2"]
MOST_BITS = 1 << 29  # of the broadcast bitmap: 64 MB


@lru_cache(8)
def _powers(base: int, modulus: int) -> np.ndarray:
    """base^(CHUNK-1) ... base^0 modulo modulus."""
    out, x = np.empty(CHUNK, np.int64), 1
    for i in range(CHUNK - 1, -1, -1):
        out[i] = x
        x = x * base % modulus
    return out


def fingerprint(data: bytes, modulus: int = MODULUS) -> tuple[int, int]:
    """Both polynomial hashes of data, combined from the hashes of its chunks."""
    out = [0, 0]
    for at in range(0, len(data), CHUNK):
        piece = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - at), at).astype(np.int64) + 1
        for k, base in enumerate(BASES):
            h = int(np.dot(piece, _powers(base, modulus)[-len(piece) :]) % modulus)
            out[k] = combine(out[k], h, len(piece), k, modulus)
    return out[0], out[1]


def combine(left: int, right: int, right_len: int, k: int, modulus: int = MODULUS) -> int:
    """Hash of a concatenation from the hashes of its two parts and the length of the second."""
    return (left * pow(BASES[k], right_len, modulus) + right) % modulus


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in names]


def _sign(docs: DataFrame, parallel_bytes: int, modulus: int) -> DataFrame:
    """(id, n_bytes, h1, h2, sha256) of each row of (id, data)."""
    kind = docs.schema["id"].dataType
    schema = f"id {kind.simpleString()}, n_bytes bigint, h1 bigint, h2 bigint, sha256 string"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = batch.column(0), [x.lower() for x in batch.column(1).to_pylist()]
            prints = [fingerprint(x, modulus) for x in data]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(x) for x in data], pa.int64()), pa.array([x[0] for x in prints], pa.int64()), pa.array([x[1] for x in prints], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string())],
                ["id", "n_bytes", "h1", "h2", "sha256"],
            )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, behind = _columns(batch, "piece", "behind")
            terms = [[h * pow(BASES[k], n, modulus) % modulus for k, h in enumerate(fingerprint(x.lower(), modulus))] for x, n in zip(data, behind, strict=True)]
            kept = [batch.column(batch.schema.get_field_index(x)) for x in ("id", "n_bytes", "sha256", "part")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([t[0] for t in terms], pa.int64()), pa.array([t[1] for t in terms], pa.int64())], ["id", "n_bytes", "sha256", "part", "t1", "t2"])

    size, step = F.octet_length("data"), F.lit(parallel_bytes)
    usual = docs.where(size <= step).mapInArrow(whole, schema)
    text = F.translate(F.col("data").cast("string"), UPPER, LOWER)
    cut = docs.where(size > step).select("id", "data", size.cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha256"))
    cut = cut.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n_bytes - 1) div {parallel_bytes} as int)"))))
    cut = cut.withColumn("piece", F.expr(f"substring(data, part * {parallel_bytes} + 1, {parallel_bytes})"))
    cut = cut.select("id", "n_bytes", "sha256", "part", "piece", F.greatest(F.lit(0), F.expr(f"n_bytes - (part + 1L) * {parallel_bytes}")).alias("behind"))
    shape = f"id {kind.simpleString()}, n_bytes bigint, sha256 string, part int, t1 bigint, t2 bigint"
    terms = cut.repartition("id", "part").mapInArrow(pieces, shape)
    once = terms.groupBy("id", "n_bytes", "sha256", "part").agg(F.max("t1").alias("t1"), F.max("t2").alias("t2"), F.count("*").alias("copies"))
    huge = once.groupBy("id", "n_bytes", "sha256").agg((F.sum("t1") % modulus).alias("h1"), (F.sum("t2") % modulus).alias("h2"), F.max("copies").alias("copies"))
    huge = huge.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return usual.unionByName(huge.select("id", *KEYS, "sha256"))


def _marked(classes: DataFrame, bits: int) -> bytes:
    """A bitmap of fixed size of the fingerprints that more than one row has."""
    return bitmap(classes.where("n > 1").select((F.col("h1") + F.col("h2") * 7919).alias("at")), "at", bits)


def _collided(docs: DataFrame, marked: bytes, bits: int, piece_bytes: int, modulus: int) -> DataFrame:
    """Keys of the classes whose members are not all alike, by comparing them piece by piece."""
    shared = docs.sparkSession.sparkContext.broadcast(marked)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                data = data.lower()
                h1, h2 = fingerprint(data, modulus)
                at = (h1 + h2 * 7919) % bits
                if seen[at >> 3] >> (at & 7) & 1:
                    cut = [data[i : i + piece_bytes] for i in range(0, max(1, len(data)), piece_bytes)]
                    yield pa.RecordBatch.from_arrays([pa.array([len(data)] * len(cut), pa.int64()), pa.array([h1] * len(cut), pa.int64()), pa.array([h2] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary())], [*KEYS, "part", "piece"])

    rows = docs.select("data").mapInArrow(pieces, "n_bytes bigint, h1 bigint, h2 bigint, part int, piece binary")
    return rows.groupBy(*KEYS, "part").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi")).where("lo <> hi").select(*KEYS).distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parallel_bytes: int = 4 << 20, piece_bytes: int = 1 << 20, most_bits: int = MOST_BITS, modulus: int = MODULUS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after lower-casing A-Z; null counts as empty. The row with the largest id of
    a group stays. Rows that repeat an id count as rows of their group and are marked alike; a null id ranks below
    all others, and a group of null ids alone has keep_id null and is kept. Other columns are not looked at.
    A broadcast bitmap of 16 bits for each fingerprint that several rows have, at most `most_bits`, spares unique texts the
    comparison; beyond it more of them are compared. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    signed = stored(_sign(rows, parallel_bytes, modulus))
    counted = stored(signed.groupBy(*KEYS).agg(F.count("*").alias("n")))
    bits = power_of_two(16 * counted.where("n > 1").count(), 1 << 20, most_bits)
    collided = stored(_collided(rows, _marked(counted, bits), bits, piece_bytes, modulus))
    if not collided.isEmpty():
        bad = collided.withColumn("bad", F.lit(True))
        signed = stored(signed.join(bad, KEYS, "left").select("id", *KEYS, "sha256", F.when(F.col("bad"), F.col("sha256")).otherwise("").alias("sub")))
    else:
        signed = signed.withColumn("sub", F.lit(""))
    keys = [*KEYS, "sub"]
    classes = stored(signed.groupBy(*keys).agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")))
    out = signed.join(classes, keys)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha256").alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of equal texts, with all its columns: the one of the largest id.

    A null id stays only where a group has no other. Of rows that repeat id and text (but for the case of A-Z) one stays, the
    one with the smallest hash of the whole row. Rows of other texts that repeat an id are not touched. An empty table gives
    an empty one.
    """
    kept = exact_groups(docs, id_col, text_col).where(F.col("kept")).groupBy(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")).agg(F.count("*").alias("n"))
    sha = F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER).cast("binary"), 256)
    return only_kept(docs, [F.col(id_col), sha], stored(kept))
