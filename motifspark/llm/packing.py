"""Operator 2: best-fit packing by large-item matching.

Texts become token ids plus a closing id 0; only texts above the capacity are cut. All that packing needs of the pieces
is how many there are of each length, a table of at most `capacity` rows. From it `plan` pairs the lengths above a third
of the capacity (a sequence holds at most two of those): the longest left with the longest that fits. Shorter lengths then
go, longest first, into the smallest gap that holds them. Equal pieces and equal sequences are treated as one run, so the
plan is a few thousand runs whatever the corpus; Spark ranks the pieces of each length and looks their places up.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import power_of_two, stored

CAPACITY = 2048
CLOSE = b"\0\0\0\0"
KEEP_WORDS = 1_200_000  # encoded words that a worker remembers, some 250 MB
_TAIL = re.compile(rb"[.,](?<=[a-z].)(?!\S)")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, pieces of the run per sequence, offset)."""
    left, ranked = dict(counts), dict.fromkeys(counts, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    spans: dict[int, list[tuple[int, int]]] = {}  # of sequences, by gap
    gaps: list[int] = []  # sorted keys of spans
    opened = 0

    def place(length: int, n: int, at: int, each: int, offset: int) -> None:
        runs.append((length, ranked[length], ranked[length] + n, at, each, offset))
        ranked[length] += n
        left[length] -= n

    def leave(gap: int, start: int, end: int) -> None:
        if gap and start < end:
            if gap not in spans:
                insort(gaps, gap)
                spans[gap] = []
            spans[gap].append((start, end))

    third = capacity // 3
    for length in sorted((x for x in counts if x > third), reverse=True):
        while left[length]:
            room = capacity - length
            mate = next((x for x in range(min(room, length), third, -1) if left.get(x, 0) > (x == length)), None)
            if mate is None:
                n = left[length]
                place(length, n, opened, 1, 0)
                leave(room, opened, opened + n)
            elif mate == length:
                n = left[length] // 2
                place(length, 2 * n, opened, 2, 0)
                leave(room - length, opened, opened + n)
            else:
                n = min(left[length], left[mate])
                place(length, n, opened, 1, 0)
                place(mate, n, opened, 1, length)
                leave(room - mate, opened, opened + n)
            opened += n
    for length in sorted((x for x in counts if x <= third), reverse=True):
        while left[length]:
            k = bisect_left(gaps, length)
            if k == len(gaps):
                each = min(capacity // length, left[length])
                n = left[length] // each
                place(length, n * each, opened, each, 0)
                leave(capacity - each * length, opened, opened + n)
                opened += n
                continue
            gap = gaps[k]
            start, end = spans[gap].pop()
            if not spans[gap]:
                del spans[gap], gaps[k]
            each = min(gap // length, left[length])
            n = min(end - start, left[length] // each)
            place(length, n * each, start, each, capacity - gap)
            leave(gap - each * length, start, start + n)
            leave(gap, start + n, end)
    return runs


@lru_cache(1)
class Encoder:
    """Encodes words with a tokenizer file and remembers them, from task to task; the tokenizer never looks past white space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers.

        A file whose tokenizer lower-cases and drops white space is asked for; words are cut at ASCII white space, and a
        full stop or comma after a letter is a word of its own, as it is for the tokenizer. Texts with a marker keep their case.
        """
        cut = [_TAIL.sub(rb" \g<0>", x if b"<|" in x else x.lower()).split() for x in texts]
        if len(self.known) > KEEP_WORDS:
            self.known.clear()
        self._learn(list(set().union(*cut).difference(self.known)))
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]

    def _learn(self, words: list[bytes]) -> None:
        """Encode new words: those of letters alone many at once, cut again at the tokens that end words; the others one by one."""
        rest = []
        for at in range(0, len(words), 1000):
            texts = {w: w.decode("utf-8", "replace") for w in words[at : at + 1000]}
            plain = [w for w, s in texts.items() if s.isalpha()]
            ids = np.array(self.tokenizer.encode(" ".join(texts[w] for w in plain), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(plain):  # some word is cut otherwise
                plain, ends = [], ends[:0]
            data = ids.tobytes()
            self.known.update((w, data[a:b]) for w, a, b in zip(plain, [0, *ends[:-1].tolist()], ends.tolist()))
            rest += texts.keys() - set(plain)
        for at in range(0, len(rest), 20_000):
            some = rest[at : at + 20_000]
            for word, e in zip(some, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False), strict=True):
                self.known[word] = struct.pack(f"<{len(e.ids)}I", *e.ids)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of each row; ids: array of the piece's token ids.

    Null text counts as empty and gives the closing id alone. Rows that repeat an id are texts of their own.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    step = 4 * capacity

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                who, number, start, length, crc, ids = [], [], [], [], [], []
                for i, data in enumerate(encoder.encode(batch.column(1).to_pylist())):
                    data += CLOSE
                    for k, b in enumerate(range(0, len(data), step)):
                        part = data[b : b + step]
                        who.append(i)
                        number.append(k)
                        start.append(b // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                out = [batch.column(0).take(pa.array(who, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:  # the lists are made of the bytes as they are
                    ends = pa.array(np.cumsum([0, *length]), pa.int32())
                    out.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                yield pa.RecordBatch.from_arrays(out, ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return rows.mapInArrow(work, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def pack(rows: DataFrame, capacity: int = CAPACITY, length_col: str = "length", order: tuple[str, ...] = ("id", "piece", "ids_crc32")) -> DataFrame:
    """rows with sequence_id and offset; lengths are 1 to capacity. Rows must be stored, as they are read twice.

    Ranks within a length come in two levels, over hash buckets, so that no length meets in one task. The plan is made of
    the numbers of rows by length, so its size does not grow with the rows.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy(length_col).count().collect()  # at most `capacity` rows
    counts = {int(x[0]): int(x[1]) for x in sizes}
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must be 1 to {capacity}")
    runs = plan(counts, capacity)
    table = spark.createDataFrame(runs or [(0, 0, 0, 0, 1, 0)], "p_length bigint, p_from bigint, p_to bigint, p_first bigint, p_each bigint, p_offset bigint")
    buckets = power_of_two(sum(counts.values()) / 20_000, 32, 1 << 16)
    dealt = rows.withColumn("p_bucket", F.pmod(F.xxhash64(F.lit(3), *order), F.lit(buckets)))
    per = dealt.groupBy(F.col(length_col).alias("b_length"), F.col("p_bucket").alias("b_bucket")).count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("b_length").orderBy("b_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("b_length", "b_bucket", before.alias("b_before"))
    within = F.row_number().over(Window.partitionBy(length_col, "p_bucket").orderBy(*order)) - 1
    ranked = dealt.withColumn("p_within", within).join(per, (F.col(length_col) == F.col("b_length")) & (F.col("p_bucket") == F.col("b_bucket")))
    ranked = ranked.withColumn("p_rank", F.col("b_before") + F.col("p_within"))
    # plans of realistic lengths have a few thousand runs; a longer one is joined as any other table
    placed = ranked.join(F.broadcast(table) if len(runs) <= 8 * capacity else table, (F.col(length_col) == F.col("p_length")) & (F.col("p_rank") >= F.col("p_from")) & (F.col("p_rank") < F.col("p_to")))
    nth = F.col("p_rank") - F.col("p_from")
    return placed.select(*rows.columns, (F.col("p_first") + F.expr("(p_rank - p_from) div p_each")).alias("sequence_id"), (F.col("p_offset") + nth % F.col("p_each") * F.col(length_col)).alias("offset"))


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """pieces() of docs, packed; an empty table gives an empty one."""
    return pack(stored(pieces(docs, tokenizer, id_col, text_col, capacity, with_ids)), capacity)
