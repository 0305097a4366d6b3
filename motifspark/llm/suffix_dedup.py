"""Operator 10: exact repeated strings by suffix arrays.

Every 100-byte window has a key that only its content decides: the smallest hash of its 40-byte strings. Runs of windows
with one key are regions of some 130 bytes, and all copies of a window lie in regions of its key. Regions whose key occurs
once in the corpus hold no repeat and go, unless the gram of the key recurs in the text: a periodic region may repeat
windows of its own, so it counts twice. The others are dealt to shards by key. A shard sorts the suffixes of its regions
by Larsson-Sadakane refinement, takes common prefixes with Kasai's algorithm (regions are its lanes), and of every set of
equal windows keeps the earliest. Keys with very many regions are cut into several shards; the windows that each of those
keeps are sorted runs in suffix order, merged by binary search. Whole copies of a document are found first and enter only once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, in_bitmap, power_of_two, stored

WINDOW = 100  # bytes of a string that counts as repeated
GRAM = 40  # bytes whose hash is a candidate for a window's key
SPAN = 1 << 18  # windows looked at together
LONGEST = 64  # windows of a region; only periodic texts have longer runs of a key
SPLIT = 4096  # regions of a key that one shard takes
SHARD_BYTES = 1 << 19  # of one suffix array: small enough for a processor's cache
TASK_BYTES = 4 << 20
MOST_BITS = 1 << 29  # of a broadcast bitmap: 64 MB
REMEMBER = 100_000  # regions that a task compares new ones with
NO_ID = -(2**63)  # stands for a null id, before all others
SEPARATOR = b"\xff"  # not a byte of UTF-8


def window_keys(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of every window of data, the minimum over its 61 grams of a mixed polynomial hash; and the hash of every gram."""
    step, power, n = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x9E3779B97F4A7C15), 1
    hashes = {1: data.astype(np.uint64) + np.uint64(1)}
    with np.errstate(over="ignore"):
        while n < 32:
            h = hashes[n]
            hashes[2 * n] = h[:-n] * power + h[n:]
            power, n = power * power, 2 * n
        tail = step
        for _ in range(3):
            tail = tail * tail  # step^8
        count = len(data) - GRAM + 1
        h = hashes[32][:count] * tail + hashes[8][32 : 32 + count]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    grams = h
    for k in (1, 2, 4, 8, 16):
        h = np.minimum(h[:-k], h[k:])
    return np.minimum(h[:-29], h[29:]), grams


def regions(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, first and last windows of the regions of data, and its gram hashes, a span of it at a time."""
    for at in range(0, len(data) - WINDOW + 1, SPAN):
        part = np.frombuffer(data, np.uint8, min(SPAN + WINDOW - 1, len(data) - at), at)
        keys, grams = window_keys(part)
        cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        end = np.append(cut[1:], len(keys))
        if (end - cut).max() > LONGEST:
            cut = np.concatenate([np.arange(a, b, LONGEST) for a, b in zip(cut, end, strict=True)])
            end = np.append(cut[1:], len(keys))
        yield keys[cut].view(np.int64), cut + at, end + at - 1, grams.view(np.int64)


def _counted(data: bytes) -> Iterator[np.ndarray]:
    """Keys of the regions of data; those whose gram recurs in their span twice, as equal windows of one region share it."""
    for keys, _, _, grams in regions(data):
        yield keys
        grams = np.sort(grams)
        again = grams[1:][grams[1:] == grams[:-1]]
        if len(again):
            yield keys[np.isin(keys, again)]


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each, whether a place ties with the one before) by Larsson-Sadakane refinement.

    Suffixes start in groups of equal 8-byte prefixes; each round sorts the groups that are not yet single by the ranks h
    bytes on and doubles h. Suffixes that agree in 128 bytes tie and keep any order: only their first 100 bytes are asked
    for, so a further round, and the order of such suffixes, could not change a result.
    """
    n = len(text)
    eight = _eight(text)
    order = np.argsort(eight)
    key = eight[order]
    slots, tied = np.arange(n), np.zeros(n, bool)
    rank = np.empty(n + 128, np.int64)
    rank[n:] = -1
    h = 8
    while True:
        head = np.concatenate(([True], key[1:] != key[:-1]))
        tied[slots] = ~head
        some = order[slots]
        rank[some] = slots[np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))]
        more = ~(head & np.append(head[1:], True))
        if h >= 128 or not more.any():
            break
        slots = slots[more]
        some = some[more]
        key = (rank[some] << 31) + rank[some + h] + 1
        sort = np.argsort(key)
        order[slots] = some[sort]
        key = key[sort]
        h *= 2
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return order, rank, tied


def _eight(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, first byte highest; zeros follow the end."""
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    out = padded
    for k in (1, 2, 4):
        out = (out[:-k] << np.uint64(8 * k)) | out[k:]
    return out[: len(text)]


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, tied: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For the windows of each region, bytes (100 at most) shared with the suffix before it; by place in text.

    Kasai's algorithm, with a lane for each region: a suffix shares with its neighbour at least what its predecessor in the
    text did, less one byte. That needs their order, so it does not hold after a share of 100 bytes or more, where ties may be.
    """
    eight = np.concatenate((_eight(text), np.zeros(WINDOW + 8, np.uint64)))
    steps = np.array([1 << 8 * k for k in range(8)], np.uint64)
    shared = np.zeros(len(text), np.int64)
    lanes = np.argsort(-counts, kind="stable")
    starts, counts = starts[lanes], counts[lanes]
    length = np.zeros(len(starts), np.int64)
    for k in range(int(counts[0]) if len(counts) else 0):
        active = int(np.searchsorted(-counts, -k, "left"))  # lanes with more than k windows
        here = starts[:active] + k
        place = rank[here]
        before = order[np.maximum(place - 1, 0)]
        got = np.where(length[:active] < WINDOW, np.maximum(length[:active] - 1, 0), 0)
        got[place == 0] = 0
        got[tied[place]] = WINDOW
        todo = np.flatnonzero((place > 0) & (got < WINDOW))
        while len(todo):
            differ = eight[here[todo] + got[todo]] ^ eight[before[todo] + got[todo]]
            same = 8 - np.searchsorted(steps, differ, "right")
            got[todo] += same
            todo = todo[(same == 8) & (got[todo] < WINDOW)]
        length[:active] = np.minimum(got, WINDOW)
        shared[here] = length[:active]
    return shared


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true values."""
    edge = np.diff(np.concatenate(([0], flag.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


RESULT = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("salt", pa.int32()), ("window", pa.binary())])
RESULT_SQL = "id bigint, mark bigint, first bigint, last bigint, salt int, window binary"


def _shards(table: pa.Table) -> pa.Table:
    """What _shard finds in the regions of a task, cut between keys into shards of about SHARD_BYTES.

    Rows without bytes are runs already known to repeat and pass through.
    """
    known = table.filter(pa.compute.is_null(table["bytes"])).select(["id", "mark", "first", "last"])
    parts = [_result({x: known[x].to_numpy() for x in known.column_names}, [])]
    table = table.filter(pa.compute.is_valid(table["bytes"])).sort_by([("key", "ascending"), ("salt", "ascending")])
    if table.num_rows:
        key = table["key"].to_numpy()
        size = np.cumsum(pa.compute.binary_length(table["bytes"]).to_numpy() + 1)
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        at = 0
        while at < len(key):
            k = int(np.searchsorted(size[ends - 1], (size[at - 1] if at else 0) + SHARD_BYTES))
            end = max(int(ends[min(k, len(ends) - 1)]), int(ends[np.searchsorted(ends, at, "right")]))
            parts.append(_shard(table.slice(at, end - at)))
            at = end
    return pa.concat_tables(parts)


def _result(runs: dict[str, np.ndarray], kept: list[tuple]) -> pa.Table:
    flat = pa.table({x: v.astype(np.int64) for x, v in runs.items()})
    n = flat.num_rows
    flat = flat.append_column("salt", pa.nulls(n, pa.int32())).append_column("window", pa.nulls(n, pa.binary()))
    more = pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*kept, strict=True), RESULT, strict=True)], schema=RESULT) if kept else RESULT.empty_table()
    return pa.concat_tables([flat.cast(RESULT), more])


def _shard(table: pa.Table) -> pa.Table:
    """Repeated windows of a shard as runs (id, mark, first, last); of cut keys also each window kept, in suffix order."""
    col = {x: table[x].to_numpy() for x in ("id", "mark", "first", "last", "salt")}
    parts = table["bytes"].to_pylist()
    text = np.frombuffer(SEPARATOR.join(parts) + SEPARATOR, np.uint8)
    sizes = np.array([len(x) for x in parts])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    counts = col["last"] - col["first"] + 1
    order, rank, tied = suffix_array(text)
    shared = common_prefixes(text, order, rank, tied, starts, counts)
    region = np.repeat(np.arange(len(parts)), counts)
    within = np.arange(len(region)) - np.repeat(np.cumsum(counts) - counts, counts)
    window = starts[region] + within
    _, doc = np.unique(np.rec.fromarrays([col["id"], col["mark"]]), return_inverse=True)
    when = (doc[region] << 40) + col["first"][region] + within  # order among all windows of the shard
    sort = np.argsort(rank[window])
    group = np.flatnonzero(np.concatenate(([True], shared[window[sort]][1:] < WINDOW)))
    earliest = np.minimum.reduceat(when[sort], group)
    gone = np.empty(len(window), bool)
    gone[sort] = when[sort] != np.repeat(earliest, np.diff(np.append(group, len(window))))
    lined = np.zeros(len(text), bool)
    lined[window] = gone
    a, b = _runs(lined)
    r = np.searchsorted(starts, a, "right") - 1
    runs = {"id": col["id"][r], "mark": col["mark"][r], "first": col["first"][r] + a - starts[r], "last": col["first"][r] + b - starts[r]}
    kept = []
    for i in sort[~gone[sort] & (col["salt"][region[sort]] >= 0)].tolist():
        k, at = region[i], int(within[i])
        place = int(col["first"][k] + at)
        kept.append((int(col["id"][k]), int(col["mark"][k]), place, place, int(col["salt"][k]), parts[k][at : at + WINDOW]))
    return _result(runs, kept)


PLACE = ["id", "mark", "first"]


def _sooner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether places (id, mark, first) of a come before those of b, row by row."""
    less, same = np.zeros(len(a), bool), np.ones(len(a), bool)
    for k in range(3):
        less |= same & (a[:, k] < b[:, k])
        same &= a[:, k] == b[:, k]
    return less


def _merge_runs(a: tuple, b: tuple) -> tuple[tuple, np.ndarray]:
    """Two runs (sorted windows, their places) as one with the earliest place of each window, and the places that go."""
    at = np.searchsorted(a[0], b[0])
    found = np.zeros(len(at), bool)
    inside = at < len(a[0])
    found[inside] = a[0][at[inside]] == b[0][inside]
    places = a[1].copy()
    mine, theirs = at[found], b[1][found]
    swap = _sooner(theirs, places[mine])
    gone = np.concatenate((theirs[~swap], places[mine[swap]]))
    places[mine[swap]] = theirs[swap]
    return (np.insert(a[0], at[~found], b[0][~found]), np.insert(places, at[~found], b[1][~found], 0)), gone


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Windows that some other shard of their key has earlier: the shards' sorted runs are merged, the smallest two at a time."""
    runs = []
    for _, part in pdf.groupby("salt"):
        windows = np.array(part["window"].tolist(), f"S{WINDOW}")
        order = np.argsort(windows, kind="stable")  # in order but for runs of several shards of a task
        runs.append((windows[order], part[PLACE].to_numpy(np.int64)[order]))
    gone = [np.empty((0, 3), np.int64)]
    while len(runs) > 1:
        runs.sort(key=lambda x: len(x[0]), reverse=True)
        both, out = _merge_runs(runs.pop(), runs.pop())
        runs.append(both)
        gone.append(out)
    out = np.concatenate(gone)
    return pd.DataFrame({"id": out[:, 0], "mark": out[:, 1], "first": out[:, 2], "last": out[:, 2]})


def _count_keys(texts: DataFrame) -> DataFrame:
    """(key, n) of keys that more than one region has, or one region that may repeat windows of its own and counts twice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                keys = [k for x in whole.column(0).slice(at, 256).to_pylist() for k in _counted(x)]
                key, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return texts.select("data").mapInArrow(work, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def _shared_regions(texts: DataFrame, counts: DataFrame, n_keys: int, most_bits: int) -> DataFrame:
    """(key, id, mark, first, last, bytes) of regions whose key counts more than once.

    Within the bound, a broadcast bitmap of the keys tells them (a few others may come along) and a task drops the bytes of
    regions that it has seen before; beyond it, regions are joined with the keys and then with their texts.
    """
    bits = power_of_two(16 * n_keys, 1 << 20, most_bits)
    if bits < 4 * n_keys:
        places = texts.select("id", "mark", "data").mapInArrow(_places, "id bigint, mark bigint, key bigint, first bigint, last bigint")
        held = places.join(counts.select("key"), "key").join(texts.select("id", "mark", "data"), ["id", "mark"])
        return held.select("key", "id", "mark", "first", "last", F.expr(f"substring(data, cast(first + 1 as int), cast(last - first + {WINDOW} as int))").alias("bytes"))
    marked = texts.sparkSession.sparkContext.broadcast(bitmap(counts, "key", bits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for who, mark, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for keys, first, last, _ in regions(data):
                    at = np.flatnonzero(in_bitmap(marked.value, keys, bits))
                    for key, a, b in zip(keys[at].tolist(), first[at].tolist(), last[at].tolist(), strict=True):
                        part, mine = data[a : b + WINDOW], (who, mark, a)
                        if (theirs := seen.get(part)) and theirs < mine:
                            part = None
                        else:
                            seen[part] = mine
                        for c, x in zip(cols, (key, who, mark, a, b, part), strict=True):
                            c.append(x)
                if len(cols[0]) > 20_000:
                    yield _rows(cols)
                    cols = ([], [], [], [], [], [])
                if len(seen) > REMEMBER:
                    seen.clear()
            yield _rows(cols)

    return texts.select("id", "mark", "data").mapInArrow(work, "key bigint, id bigint, mark bigint, first bigint, last bigint, bytes binary")


def _rows(cols: tuple[list, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())], ["key", "id", "mark", "first", "last", "bytes"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for who, mark, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            for keys, first, last, _ in regions(data):
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, who)), pa.array(np.full(n, mark)), pa.array(keys), pa.array(first), pa.array(last)], ["id", "mark", "key", "first", "last"])


def repeated(texts: DataFrame, split: int = SPLIT, most_bits: int = MOST_BITS) -> DataFrame:
    """Runs (id, mark, first, last) of starts of windows that start earlier too, by id, mark and place.

    texts: (id, mark, data) of distinct texts, read twice; id and mark name a text.
    """
    counts = stored(_count_keys(texts))
    n_keys, n_regions = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = _shared_regions(texts, counts, n_keys, most_bits)
    full = stored(counts.where(F.col("n") > split).select("key", F.ceil(F.col("n") / split).alias("salts")))
    found = found.join(full, "key", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(F.lit(5), "id", "mark", "first"), F.col("salts")), F.lit(-1)).cast("int")).drop("salts")
    bins = 8 + int(n_regions) * 132 // TASK_BYTES
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), bins // 4)  # a task's share stays the same
    dealt = found.withColumn("bin", F.pmod(F.xxhash64(F.lit(6), "key", "salt"), F.lit(bins))).repartition(parts, "bin")
    done = stored(dealt.groupBy("bin").applyInArrow(_shards, RESULT_SQL))
    cut = done.where(F.col("window").isNotNull()).withColumn("bin", F.pmod(F.xxhash64("window"), F.lit(bins)))
    merged = cut.groupBy("bin").applyInPandas(_merge, "id bigint, mark bigint, first bigint, last bigint")
    return done.where(F.col("window").isNull()).select("id", "mark", "first", "last").unionByName(merged)


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Result of each text (sha, data, runs)."""
    for batch in batches:
        out = []
        for data, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            spans: list[list[int]] = []
            for run in sorted((r["first"], r["last"] + WINDOW) for r in runs):
                if spans and run[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], run[1])
                else:
                    spans.append(list(run))
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            out.append((sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"first": a, "end": b} for a, b in spans]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))], ["sha", "n_removed", "n_spans", "kept_sha256", "spans"])


def _flagged(df: DataFrame, marked: DataFrame, column: str, yes: bool) -> DataFrame:
    """Rows of df whose long column may be (yes) or surely isn't (no) among those of marked, by a broadcast bitmap."""
    bits = power_of_two(16 * marked.count(), 1 << 20, MOST_BITS)
    shared = df.sparkSession.sparkContext.broadcast(bitmap(marked, column, bits))

    @F.pandas_udf("boolean")
    def held(values: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(shared.value, values.to_numpy(np.int64), bits))

    return df.where(held(column) if yes else ~held(column))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, spans (first and end byte of each removed run).

    Null text counts as empty. Integer ids order the documents, null first; rows that repeat an id are ordered by a hash of
    their text, and rows that repeat id and text are one document and get equal results.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("real_id"), data.alias("data"))
    rows = rows.select("real_id", F.coalesce(F.col("real_id").cast("long"), F.lit(NO_ID)).alias("id"), F.sha2("data", 256).alias("sha"), "data")
    rows = rows.withColumn("mark", F.xxhash64("sha"))
    signed = stored(rows.select("real_id", "id", "sha", "mark", F.octet_length("data").cast("long").alias("n_bytes")))
    groups = stored(signed.groupBy("sha", "mark").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.max("n_bytes").alias("n_bytes")))
    copied = groups.where(f"n > 1 and n_bytes >= {WINDOW}")
    long = rows.where(F.octet_length("data") >= WINDOW).select("id", "sha", "mark", "data")
    single = _flagged(long, copied, "mark", False)
    once = stored(_flagged(long, copied, "mark", True).groupBy("sha", "mark").agg(F.min("id").alias("id"), F.max("data").alias("data")))
    texts = single.unionByName(once.select(*single.columns))
    runs = stored(repeated(texts, split, most_bits))
    by_text = stored(runs.groupBy("id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("runs")))
    touched = _flagged(texts, by_text, "mark", True).join(by_text, ["id", "mark"]).select("sha", "data", "runs")
    made = stored(touched.mapInArrow(_cut_texts, "sha string, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<first:bigint,end:bigint>>"))
    facts = stored(groups.where("n > 1").select("sha", "first_id").join(made, "sha", "full"))
    out = signed.join(facts, "sha", "left")
    copy = F.col("first_id").isNotNull() & (F.col("id") != F.col("first_id")) & (F.col("n_bytes") >= WINDOW)
    none = F.array().cast("array<struct<first:bigint,end:bigint>>")
    return out.select(
        F.col("real_id").alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", none)).alias("spans"),
    )
