"""Operator 13: importance resampling towards a target's distribution of hashed n-grams.

Counts of hashed features of both corpora give each bucket a gain; a text's weight is the sum over its features, by array
lookups. Scores with doc_id form a composite key; a distributed radix selection finds the exact k-th key digit by digit, from
counts of at most 2^16 digit values a round. Only what it selects is sorted (by ranges) and ranked.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BUCKETS = 10_000
SEED = 42
LEAST_WORDS, PERCENT = 20, 5
DIGIT = 16  # bits of a digit of the selection
SHORT = 64  # bytes of words whose shifts are tables
RUN = 1 << 20  # bytes
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # before A-Z are lower-cased
GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_CLASS = np.array([bool(WORD.match(bytes([i]).lower())) for i in range(256)])
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.int64)


@lru_cache(1)
def _shifts() -> np.ndarray:
    """[n, k, b]: CRC-32 state b << 8k after n zero bytes, n up to SHORT; a state is the exclusive or of its four bytes' entries."""
    byte = np.arange(256, dtype=np.uint32)
    table = byte.copy()
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)  # fixed value: the reversed polynomial
    out = np.empty((SHORT + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = byte << np.uint32(8 * k)
    for n in range(SHORT):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ table[out[n] & 255]
    return out


@lru_cache(1)
def _moved() -> np.ndarray:
    """[256 d + b]: the state that byte b adds with d bytes behind it."""
    return np.ascontiguousarray(_shifts()[1:, 0]).reshape(-1)


def _zeros(state: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 states after so many zero bytes, at most SHORT: with the CRC-32 of a second part, that of both parts together."""
    flat, at = _shifts().reshape(-1), lengths << 10
    out = flat[at + (state & 255)]
    for k in (1, 2, 3):
        out ^= flat[at + (k << 8) + (state >> np.uint32(8 * k) & 255)]
    return out


def _parts(texts: list[str | None]) -> Iterator[tuple[int, bytes, int]]:
    """(number of the text, bytes, words at their start that count as context only) of texts, of longer ones in parts of about RUN bytes."""
    for i, text in enumerate(texts):
        raw, at, old = (text or "").encode("utf-8", "surrogatepass"), 0, 0
        while len(raw) - at > RUN:
            gap = GAP.search(raw, at + RUN)  # a word is never cut
            if gap is None:
                break
            part = raw[at : gap.start()]
            yield i, part, old
            last = [m.start() for m in WORD.finditer(part, max(0, len(part) - 1024))][1:][-2:]
            if len(last) < 2:  # very long words
                last = [m.start() for m in WORD.finditer(part)][-2:]
            old = len(last)
            at = at + last[0] if last else gap.start()
            if at + RUN <= gap.start():  # the last words are longer than a part: take the rest as one
                break
        yield i, raw[at:], old


def batch_buckets(texts: list[str | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: (text of each word, bucket of each feature, text of each feature), as numbers of texts in the list.

    Features are the runs of 1 to 3 words. Arrays are made of about RUN bytes at a time, whatever the texts' lengths.
    """
    held, size = [], 0
    for part in _parts(texts):
        held.append(part)
        size += len(part[1])
        if size >= RUN:
            yield _buckets(held, buckets)
            held, size = [], 0
    if held:
        yield _buckets(held, buckets)


def _buckets(parts: list[tuple[int, bytes, int]], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = b"\0".join([*(x for _, x, _ in parts), b""])
    octets = np.frombuffer(raw, np.uint8)
    inside = _CLASS[octets]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))  # the text ends with a zero, so edges come in pairs
    start, end = edge[::2], edge[1::2]
    size = end - start
    if not len(size):
        return tuple(np.empty(0, np.int64) for _ in range(3))
    # CRC-32 is linear: each byte adds its own state, moved over the bytes behind it
    behind = np.repeat(end - 1, size) - np.flatnonzero(inside)
    state = np.bitwise_xor.reduceat(_moved()[np.minimum(behind, SHORT - 1) << 8 | _LOWER[octets[inside]]], np.cumsum(size) - size)
    short = np.minimum(size, SHORT)
    one_more = _shifts()[1, 0]
    ones = np.uint32(0xFFFFFFFF)
    state ^= _zeros(np.full(len(size), ones), short)
    crc, spaced = state ^ ones, (state >> np.uint32(8)) ^ one_more[(state ^ np.uint32(32)) & np.uint32(255)] ^ ones
    text = lambda i: raw[start[i] : end[i]].lower()
    long = np.flatnonzero(size >= SHORT)
    for i in long:
        crc[i] = zlib.crc32(text(i))
        spaced[i] = zlib.crc32(b" ", int(crc[i]))
    ahead = _zeros(spaced[:-1], short[1:])  # of a pair's first word and the space, moved over the second word
    two = ahead ^ crc[1:]
    ahead = (ahead >> np.uint32(8)) ^ one_more[ahead & np.uint32(255)] ^ spaced[1:]  # the pair and a space
    three = _zeros(ahead[:-1], short[2:]) ^ crc[2:]
    for i in long:  # too long for the tables
        for n, out in ((2, two), (3, three)):
            for a in range(max(0, i - n + 1), min(i, len(size) - n) + 1):
                out[a] = zlib.crc32(b" ".join(text(j) for j in range(a, a + n)))
    firsts = np.cumsum([0, *(len(x) + 1 for _, x, _ in parts)])
    part = np.searchsorted(firsts, start, "right") - 1
    place = np.arange(len(size)) - np.searchsorted(part, part)  # of a word in its part
    new = place >= np.array([x for _, _, x in parts])[part]
    number = np.array([x for x, _, _ in parts])[part]
    both, all_three = (part[:-1] == part[1:]) & new[1:], (part[:-2] == part[2:]) & new[2:]
    return number[new], np.concatenate((crc[new], two[both], three[all_three])) % np.uint32(buckets), np.concatenate((number[new], number[1:][both], number[2:][all_three]))


def feature_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket, counted in the tasks first; `buckets` numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found, _ in batch_buckets(batch.column(0).to_pylist(), buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counted = texts.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) of each bucket, each count with one added."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of each row of docs (id and the text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            facts = np.zeros((3, n), np.int64)
            for words, found, owner in batch_buckets(batch.column(1).to_pylist(), len(gain)):
                # sums of whole numbers below 2^53 are exact as doubles
                facts += np.stack((np.bincount(words, minlength=n), np.bincount(owner, minlength=n), np.bincount(owner, gain[found], n).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, facts)], ["id", "n_words", "n_features", "weight"])

    return docs.select("id", F.col(f"`{text_col}`").alias("text")).mapInArrow(work, "id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel draw in thousandths, floored, from the first 32 bits of SHA-256 of `seed:id`."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def _smallest(rows: DataFrame, keys: list[str], k: int) -> list[int]:
    """The k-th smallest composite key of unsigned longs, 1 <= k <= rows, or a key between it and the next one.

    A round counts the next digit of the keys that agree with the digits known so far: at most 2^16 numbers reach the driver.
    """
    bounds: list[int] = []
    left = k
    for i, key in enumerate(keys):
        value = 0
        for shift in range(64 - DIGIT, -1, -DIGIT):
            digit = F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("digit")
            same = rows
            for other, bound in zip(keys, bounds, strict=False):
                same = same.where(F.col(other) == F.lit(_signed(bound)))
            if shift < 64 - DIGIT:
                same = same.where(F.shiftrightunsigned(key, shift + DIGIT) == F.lit(value))
            counts = dict(same.groupBy(digit).count().collect())
            for x in sorted(counts):
                if counts[x] >= left:
                    break
                left -= counts[x]
            value = value << DIGIT | x
            if counts[x] == left:  # all keys that begin so are among the k
                rest = (1 << shift) - 1
                return [*bounds, value << shift | rest, *[(1 << 64) - 1] * (len(keys) - i - 1)]
        bounds.append(value)
    return bounds


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of each row of docs: its log importance towards the texts of target, and its draw.

    Of the N rows with least_words words, the floor(percent * N / 100) highest scores are drawn and ranked from 1, ties to
    the smaller id; others have rank null. A null text has no words; a null id counts as an empty text in the draw and as the
    largest id; rows that repeat an id and score follow each other in any order. Empty tables: no rows, or gains against a
    target without a feature. Other columns, whatever their names, have no influence.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    gain = gains(feature_counts(rows, "text", buckets), feature_counts(target, target_col, buckets))
    facts = weighted(rows, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    high = F.lit(-(1 << 63))
    # keys that order as unsigned longs: score from high to low, id, row
    keys = {"k0": F.bitwise_not(F.col("score").bitwiseXOR(high)), "k1": F.coalesce(F.col("id"), F.lit((1 << 63) - 1)).bitwiseXOR(high), "k2": F.monotonically_increasing_id()}
    facts = stored(facts.withColumns(keys))
    able = facts.where(F.col("n_words") >= least_words)
    k = percent * able.count() // 100
    out = ["id", "n_features", "weight", "score"]
    if not k:
        return facts.select(*out, F.lit(None).cast("long").alias("rank"))
    bounds = _smallest(able, list(keys), k)
    within, equal = F.lit(False), F.lit(True)
    for key, bound in zip(keys, bounds, strict=True):
        limit = F.lit(_signed(bound)).bitwiseXOR(high)
        within = within | (equal & (F.col(key).bitwiseXOR(high) < limit))
        equal = equal & (F.col(key).bitwiseXOR(high) == limit)
    drawn = (F.col("n_words") >= least_words) & (within | equal)
    return _ranked(facts.where(drawn)).select(*out, "rank").unionByName(facts.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))


def _ranked(rows: DataFrame) -> DataFrame:
    """rows with rank from 1 by k0, k1, k2: sorted by ranges, then numbered by each range's place and the ranges before."""
    order = [F.col("score").desc(), F.coalesce(F.col("id"), F.lit((1 << 63) - 1)), F.col("k2")]
    ranges = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("place", 33).cast("int")
    sizes = ranges.groupBy(part.alias("part")).count().orderBy("part").collect()
    before = np.cumsum([0, *(r["count"] for r in sizes)]).tolist()
    starts = F.create_map(*[F.lit(x) for r, b in zip(sizes, before, strict=False) for x in (r["part"], b)])
    return ranges.withColumn("rank", F.element_at(starts, part) + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
