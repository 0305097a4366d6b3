"""Log-likelihood scans: hits of every matrix on either strand.

The production form is an Arrow kernel over batches of pieces: sequences are cut with an overlap and the pieces are spread over
the tasks, so that neither a chromosome nor a file of one split keeps a single task busy. Moving a base costs far less than
scoring it. The sql form scores with plain expressions and is what it is tested against.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from motifspark.operators.kernel import Scorer, encode

PIECE = 1 << 18  # starts of a piece
TASK = 32 << 20  # bytes of input
UNKNOWN = 1 << 60  # what Spark gives for tables without a size is beyond
TOGETHER = 1 << 16  # characters of short pieces that are scored at once
ADDED = 1 << 21  # hits that a task holds before it adds them up by place
FEW = 1 << 18  # scored words that are broadcast
SHORT = 1 << 10  # of a piece whose substrings are taken by expressions
BEYOND, BELOW = 1 << 62, (1 << 62) + 1  # what stands for an infinite score, and for one that rounds to -0


def ascii_bytes(seq: Column) -> Column:
    """seq as bytes, one for each character, so that substrings are taken without a walk from the start."""
    return F.when(F.octet_length(seq) == F.length(seq), seq).otherwise(F.regexp_replace(seq, r"[^\x00-\x7F]", "N")).cast("binary")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by hash of keys, one task for each TASK bytes of the tables read but spark.sql.shuffle.partitions at least.

    Without a number Spark would join small partitions again, though the work on a base is far more than its bytes tell.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows.isStreaming:
        return rows.repartition(least, *keys)
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < UNKNOWN)
    return rows.repartition(max(least, size // TASK), *keys)


def cut(rows: DataFrame, first: Column, end: Column, width: int, window: int, size: int) -> DataFrame:
    """rows (with seq) once for each run of `size` starts in [first, end), and once where there is none.

    Adds n (the sequence's length), k and last_k (this and the last run), start and own (first start of the run and how many),
    offset (place of the piece's first character), skip (of the run's first start in it) and piece, which holds what the
    starts' sites and the window on either side need.
    """
    margin = window + 1
    out = rows.withColumns({"n": F.length("seq").cast("long"), "seq": ascii_bytes(F.col("seq"))})
    out = out.withColumns({"first": first.cast("long"), "end": end.cast("long")})
    out = out.withColumn("last_k", F.greatest(F.lit(0), F.expr(f"(`end` - `first` - 1) div {size}")))
    out = out.withColumn("k", F.explode(F.expr("sequence(0L, last_k)")))
    out = out.withColumn("start", F.col("first") + F.col("k") * size)
    out = out.withColumn("own", F.greatest(F.lit(0), F.least(F.col("end") - F.col("start"), F.lit(size))))
    out = out.withColumn("offset", F.greatest(F.lit(0), F.col("start") - margin))
    stop = F.when(F.col("own") > 0, F.least(F.col("n"), F.col("start") + F.col("own") + margin + width)).otherwise(F.col("offset"))
    piece = F.substr("seq", (F.col("offset") + 1).cast("int"), (stop - F.col("offset")).cast("int")).cast("string")
    return out.withColumns({"skip": F.col("start") - F.col("offset"), "piece": piece}).drop("seq", "first", "end")


def pieces(seqs: DataFrame, width: int, window: int, size: int = PIECE) -> DataFrame:
    """(seq_idx, seq_id, n, offset, skip, own, piece): overlapping pieces, own the number of starts from `skip` on that a piece answers for."""
    rows = cut(seqs.select("seq_idx", "seq_id", "seq"), F.lit(0), F.length("seq"), width, window, size)
    rows = rows.where(F.coalesce(F.col("k") < F.col("n"), F.lit(False)))  # none of no text; a condition on seq alone would compute it once more, before an exchange below
    return spread(rows.select("seq_idx", "seq_id", "n", "offset", "skip", "own", "k", "piece"), "seq_idx", "k").drop("k")


def score_sites(seqs: DataFrame, scorer: Scorer, nucs_after_tss: int | None = None, piece: int = PIECE) -> DataFrame:
    """Hits (strand, pwm_idx, pwm_id, seq_idx, seq_id, loc, score above the matrix's cutoff) of all sequences (seq_idx, seq_id, seq).

    Sequences are cut into pieces; score_pieces says more.
    """
    return score_pieces(pieces(seqs, *reach(scorer), piece), scorer, nucs_after_tss)


def reach(scorer: Scorer) -> tuple[int, int]:
    """Characters that a start's site needs, and on either side its background."""
    return max((len(p.mat) for p in scorer.pwms), default=1), scorer.background.window if scorer.background.kind == "local" else 0


def score_pieces(cut_up: DataFrame, scorer: Scorer, nucs_after_tss: int | None = None) -> DataFrame:
    """Hits of pieces (seq_idx, seq_id, n, offset, skip, own, piece) of sequences.

    loc is relative to the TSS, which has nucs_after_tss characters from it on; half the length if None. A NaN score (masked
    character or undefined background) is no hit; an infinite one is.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            yield from _found(held, scorer, nucs_after_tss)

    # a row holds all hits of a matrix and strand in a piece, in the order of the kernel; Spark takes it apart
    found = cut_up.mapInArrow(work, "which int, seq_idx bigint, seq_id string, locs array<bigint>, scores array<double>")
    rows = found.select("which", "seq_idx", "seq_id", "scores", F.posexplode("locs").alias("i", "loc"))
    return rows.select(*kind_columns(scorer), "seq_idx", "seq_id", "loc", F.get("scores", F.col("i")).alias("score"))


def different_words(seqs: DataFrame, width: int) -> DataFrame:
    """(motif): every different run of width characters of the sequences; a task names each once or seldom, then Spark drops repeats."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for held in _held(batches, 1 << 20):
            parts = []
            for _, _, _, _, skip, own, piece in held:
                end = min(skip + own, len(piece) - width + 1)
                if end > skip:
                    text = np.frombuffer(piece[skip : end + width - 1].encode("ascii"), np.uint8)
                    parts.append(np.lib.stride_tricks.sliding_window_view(text, width))
            if not parts:
                continue
            rows = np.concatenate(parts)
            if width <= 8:
                words = np.zeros(len(rows), np.uint64)
                for m in range(width):
                    words = words << np.uint64(8) | rows[:, m]
                found = {int(x).to_bytes(width, "big") for x in np.unique(words)}
            else:
                found = set(np.unique(np.ascontiguousarray(rows).view(f"S{width}").ravel()).tolist())
            new = found - seen
            seen = (seen if len(seen) < ADDED else set()) | new
            yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in new], pa.string())], ["motif"])

    return pieces(seqs, width, 0).mapInArrow(work, "motif string").distinct()


def hit_numbers(cut_up: DataFrame, scorer: Scorer, nucs_after_tss: int | None, scores: bool, part: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    """(part, which, seq_idx, seq_id, first, packed) for each piece, matrix and strand with hits, as they are to be sorted: packed are the scores, or the
    places from first, the first one, on; unpacked_hits reads them. part gives the number of a row's task from a kind and seq_idx."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = scorer.by_word()
        ranks = {w: np.stack([_ranks(x)[0] for x in t]) for w, t in words.items()} if words and scores else None
        for held in _held(batches, 1 << 18 if words else TOGETHER):
            rows, idx = [], np.array([x[0] for x in held], np.int64)
            for k, at, score, low, high, shift in _by_piece(held, scorer, nucs_after_tss, words, ranks):
                mine = np.flatnonzero(high > low)
                if not len(mine):
                    continue
                pack = packed_places if not scores else packed_slices if ranks else _packed_each
                each = pack(thousandths(score) if pack is _packed_each else score if scores else at, low[mine], high[mine])
                rows += [(to, k, *held[i][:2], first, data) for i, to, first, data in zip(mine.tolist(), part(k, idx[mine]).tolist(), (at[low[mine]] + shift[mine]).tolist(), each, strict=True)]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, types, strict=True)], ["part", "which", "seq_idx", "seq_id", "first", "packed"])

    return cut_up.mapInArrow(work, "part int, which int, seq_idx bigint, seq_id string, first bigint, packed binary")


def unpacked_hits(scorer: Scorer, scores: bool) -> Callable[[int, int, bytes], np.ndarray]:
    """What makes places, or thousandths of scores, of a row's which, first and packed in hit_numbers."""
    words = scorer.by_word() if scores else None
    values = {k: _ranks(t[k])[1] for w, t in words.items() for k, width in enumerate(_widths(scorer)) if w == width} if words else None
    if not scores:
        return lambda which, first, data: unpacked(data) + first
    return (lambda which, first, data: values[which][unpacked(data)]) if values else (lambda which, first, data: unpacked(data))


def _widths(scorer: Scorer) -> list[int]:
    return [len(p.mat) for _ in scorer.strands for p in scorer.pwms]


def _ranks(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of words' scores among their different thousandths, what most words have first, and the thousandths by rank."""
    values, at, n = np.unique(thousandths(scores), return_inverse=True, return_counts=True)
    n[values == 0] = 1  # mostly of words that are no hits
    order = np.argsort(-n, kind="stable")
    rank = np.argsort(order, kind="stable").astype(np.uint16 if len(order) < 1 << 16 else np.int32)
    return rank[at], values[order]


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as what they exceed the least one by: a byte each, after one of 255 for each 255 in it; where that takes more than two bytes
    for a number, in as few as the largest needs, byte by byte place, coded by frequency."""
    low = int(values.min())
    above, width = values - low, 0
    if int((above // 255).sum()) <= len(above):
        data = _in_bytes(above)[0].tobytes()
    else:
        width = next(w for w in (2, 4, 8) if int(above.max()) < 1 << 8 * w)
        coder = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
        data = coder.compress(above.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()) + coder.flush()
    return struct.pack("<bq", width, low) + data


def _in_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes, of 255 for each 255 in one before its rest, and where each ends."""
    many = values // 255
    ends = np.cumsum(many + 1, dtype=np.int64)
    out = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = values - many * 255
    return out, ends


def _packed_each(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[bytes]:
    return (packed(values[a:b]) for a, b in zip(low.tolist(), high.tolist(), strict=True))


def packed_slices(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[bytes]:
    """packed of the slices of small numbers, made at once."""
    data, ends = _in_bytes(values)
    if len(data) > 2 * len(values):
        yield from _packed_each(values, low, high)
    else:
        data, ends, head = data.tobytes(), np.concatenate(([0], ends)), struct.pack("<bq", 0, 0)
        yield from (head + data[a:b] for a, b in zip(ends[low].tolist(), ends[high].tolist(), strict=True))


def packed_places(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[bytes]:
    """Of each slice of rising numbers the distances from its first one, as bits, or as packed steps where these are fewer."""
    start, marks = places[0], np.zeros(places[-1] - places[0] + 1, bool)
    marks[places - start] = True
    for a, b, first, last in zip(low.tolist(), high.tolist(), places[low].tolist(), places[high - 1].tolist(), strict=True):
        if last - first >= 8 * (b - a):
            yield struct.pack("<b", -1) + packed(np.diff(places[a:b], prepend=first))
        else:
            yield b"\xfe" + np.packbits(marks[first - start : last - start + 1]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """What packed and packed_places have packed; of the latter, the distances from the first number."""
    width = struct.unpack_from("<b", data)[0]
    if width == -2:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1)).view(bool))
    if width == -1:
        return np.cumsum(unpacked(data[1:]))
    low = struct.unpack_from("<q", data, 1)[0]
    if width:
        planes = np.frombuffer(zlib.decompress(memoryview(data)[9:]), np.uint8).reshape(width, -1)
        return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64) + low
    found = np.frombuffer(data, np.uint8, offset=9)
    if data.find(b"\xff", 9) < 0:
        return found.astype(np.int64) + low
    sums = np.cumsum(found, dtype=np.int64)[found != 255]
    sums[1:] -= sums[:-1].copy()
    return sums + low


def thousandths(score: np.ndarray) -> np.ndarray:
    """The numbers that three places show, half to even; BEYOND for infinite ones, BELOW for a zero that shows a sign."""
    times = score * 1000
    with np.errstate(invalid="ignore"):
        whole = np.rint(times)
        sure = np.abs(np.abs(times - whole) - 0.5) > 1e-6 + np.abs(times) * 1e-15
        sure &= np.isfinite(times) & ((whole != 0) | ~np.signbit(score))
    out = np.where(sure, whole, 0).astype(np.int64)
    for i in np.flatnonzero(~sure).tolist():
        text = f"{score[i]:.3f}"
        out[i] = BEYOND if text == "inf" else BELOW if text == "-0.000" else int(text.replace(".", ""))
    return out


def kind_columns(scorer: Scorer) -> list[Column]:
    """strand, pwm_idx and pwm_id of a row's number `which` of strand and matrix."""
    kinds = [(s, p) for s in scorer.strands for p in scorer.pwms]
    named = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("which") + 1)
    return [named([s for s, _ in kinds]).alias("strand"), named([p.pwm_idx for _, p in kinds]).alias("pwm_idx"), named([p.pwm_id for _, p in kinds]).alias("pwm_id")]


def totals(cut_up: DataFrame, scorer: Scorer, nucs_after_tss: int | None = None, by_word: bool = True) -> DataFrame:
    """(strand, pwm_idx, pwm_id, n_hits, n_infinite, n_seqs, total, first_loc, last_loc) of the hits of score_pieces, for matrices and strands that have any.

    Hits are added up in the kernel; a sequence leaves it as bits, one for each matrix and strand with a hit, so that sequences in
    several pieces or rows count once. by_word: count words where they have scores, so that the
    library's size does not matter; else look them up, which a small one is done with sooner.
    """
    size = len(scorer.strands) * len(scorer.pwms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = scorer.by_word()
        for held in _held(batches, 1 << (20 if by_word else 18) if words else TOGETHER):
            met = np.zeros((len(held), -(-size // 64) * 64), bool)
            each = _word_totals(held, scorer, words, nucs_after_tss, met) if words and by_word else hit_totals(held, scorer, nucs_after_tss, met, words)
            which, n, infinite, total, first, last = (list(x) for x in zip(*each, strict=True)) if each else ([] for _ in range(6))
            bits = np.packbits(met, axis=1, bitorder="little").view("<i8")
            row, word = np.nonzero(bits)
            none, idx = [None] * len(row), [held[i][0] for i in row.tolist()]
            columns = [which + none, n + none, infinite + none, total + none, first + none, last + none, [None] * len(which) + idx, [None] * len(which) + word.tolist(), [None] * len(which) + bits[row, word].tolist()]
            types = [pa.int32(), *[pa.int64()] * 2, pa.float64(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["which", "n", "infinite", "total", "first", "last", "seq_idx", "word", "bits"])

    found = cut_up.mapInArrow(work, "which int, n bigint, infinite bigint, total double, first bigint, last bigint, seq_idx bigint, word int, bits bigint")
    sums = [F.sum("n").alias("n"), F.sum("infinite").alias("infinite"), F.sum("total").alias("total"), F.min("first").alias("first"), F.max("last").alias("last")]
    once = found.groupBy("which", "seq_idx", "word").agg(*sums, F.bit_or("bits").alias("bits"))
    held_by = F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("bits", k) == 1), lambda k: F.col("word") * 64 + k)
    each = once.withColumn("which", F.explode(F.when(F.col("word").isNull(), F.array("which")).otherwise(held_by)))
    added = each.groupBy("which").agg(*sums, F.count("seq_idx").alias("n_seqs"))
    return added.select(*kind_columns(scorer), F.col("n").alias("n_hits"), F.col("infinite").alias("n_infinite"), "n_seqs", "total", F.col("first").alias("first_loc"), F.col("last").alias("last_loc"))


def hit_totals(held: list[tuple], scorer: Scorer, nucs_after_tss: int | None, met: np.ndarray, words: dict[int, np.ndarray] | None = None) -> list[tuple]:
    """(kind, hits, infinite ones, total, first and last loc) of the pieces' hits; marks in met the kinds that each piece has."""
    out = []
    for k, at, score, low, high, shift in _by_piece(held, scorer, nucs_after_tss, words):
        mine = high > low
        n = int((high - low).sum())
        if n:
            met[mine, k] = True
            if n < len(at):
                score = np.concatenate([score[a:b] for a, b in zip(low[mine].tolist(), high[mine].tolist(), strict=True)])
            first, last = at[low[mine]] + shift[mine], at[high[mine] - 1] + shift[mine]
            out.append((k, n, int(np.isinf(score).sum()), float(score.sum()), int(first.min()), int(last.max())))
    return out


def _word_totals(held: list[tuple], scorer: Scorer, words: dict[int, np.ndarray], nucs_after_tss: int | None, met: np.ndarray) -> list[tuple]:
    """_hit_totals by counts of words, whose scores are known: the work on a start does not grow with the library."""
    starts, own, shift = _placed(held, nucs_after_tss)
    code = encode("\0".join([*(x[-1] for x in held), ""]))
    kinds, out = np.array([len(p.mat) for _ in scorer.strands for p in scorer.pwms]), []
    bad = np.concatenate(([0], np.cumsum(code < 0)))
    safe = np.maximum(code, 0).astype(np.int64)
    for w, scores in words.items():
        size = len(code) - w + 1
        if size <= 0:
            continue
        at = np.flatnonzero(own[:size] & (bad[w:] == bad[:size]))
        number = np.zeros(len(at), np.int64)
        for m in range(w):
            number = number * 4 + safe[at + m]
        piece = np.searchsorted(starts, at, "right") - 1
        loc = at + shift[piece]
        count = np.bincount(number, minlength=4**w)
        low, high = np.full(4**w, np.iinfo(np.int64).max), np.full(4**w, np.iinfo(np.int64).min)
        np.minimum.at(low, number, loc)
        np.maximum.at(high, number, loc)
        hit = scores != 0
        mine = np.flatnonzero(hit[:, count > 0].any(1))
        n, total = hit[mine] @ count, scores[mine] @ count
        marks = hit[mine].T.astype(np.float32)
        for a in range(0, len(held), 512):
            lo, hi = np.searchsorted(piece, (a, a + 512))
            has = np.zeros((min(512, len(held) - a), 4**w), np.float32)
            has[piece[lo:hi] - a, number[lo:hi]] = 1
            met[a : a + 512, mine] |= has @ marks > 0
        first, last = np.where(hit[mine], low, np.iinfo(np.int64).max).min(1), np.where(hit[mine], high, np.iinfo(np.int64).min).max(1)
        out += list(zip(mine.tolist(), n.tolist(), [0] * len(mine), total.tolist(), first.tolist(), last.tolist(), strict=True))
    return out


def curve(cut_up: DataFrame, scorer: Scorer, nucs_after_tss: int | None = None) -> DataFrame:
    """(strand, pwm_idx, pwm_id, loc, cumscore): the hits of score_pieces added up by place, first over the sequences of a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = {}, 0
        for held in _held(batches):
            for k, _, loc, score in _own_hits(held, scorer, nucs_after_tss):
                parts.setdefault(k, []).append((loc, score))
                size += len(loc)
            if size > ADDED:
                parts = {k: [_by_place(x)] for k, x in parts.items()}
                size = sum(len(x[0][0]) for x in parts.values())
                if size > ADDED // 2:
                    yield from _curve_rows(parts)
                    parts, size = {}, 0
        yield from _curve_rows({k: [_by_place(x)] for k, x in parts.items()})

    found = cut_up.mapInArrow(work, "which int, loc bigint, score double")
    return found.groupBy("which", "loc").agg(F.sum("score").alias("cumscore")).select(*kind_columns(scorer), "loc", "cumscore")


def _by_place(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Places in order and the sums of their scores."""
    loc, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    low, span = loc.min(), loc.max() - loc.min() + 1
    if span > 8 * len(loc) + TOGETHER:
        places, at = np.unique(loc, return_inverse=True)
        return places, np.bincount(at, score)
    at = np.flatnonzero(np.bincount(loc - low))
    return at + low, np.bincount(loc - low, score)[at]


def _curve_rows(parts: dict[int, list]) -> Iterator[pa.RecordBatch]:
    for k, [(loc, score)] in parts.items():
        for a in range(0, len(loc), 1 << 16):
            mine = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(loc[mine]), k), pa.int32()), pa.array(loc[mine], pa.int64()), pa.array(score[mine])], ["which", "loc", "score"])


def _held(batches: Iterator[pa.RecordBatch], most: int = TOGETHER) -> Iterator[list[tuple]]:
    """Pieces that are scored together."""
    for batch in batches:
        held, size = [], 0
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            size += len(row[-1])
            if size >= most:
                yield held
                held, size = [], 0
        yield held


def _placed(held: list[tuple], nucs_after_tss: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the joined text of pieces: where each begins, the starts that they answer for, and what leads from a start to its place relative to the TSS."""
    starts = np.cumsum([0, *(len(x[-1]) + 1 for x in held)])
    own = np.zeros(starts[-1], bool)
    shift = np.empty(len(held), np.int64)
    for i, (_, _, n, offset, skip, many, _) in enumerate(held):
        own[starts[i] + skip : starts[i] + skip + many] = True
        shift[i] = offset - starts[i] - (n - (n // 2 if nucs_after_tss is None else nucs_after_tss))
    return starts, own, shift


def _own_hits(held: list[tuple], scorer: Scorer, nucs_after_tss: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, piece, loc, score) of the hits whose starts the pieces answer for, of kinds that have one."""
    starts, own, shift = _placed(held, nucs_after_tss)
    for k, (_, _, at, score) in enumerate(scorer.hits([(x[-1], x[2]) for x in held])):
        mine = own[at]
        at, score = at[mine], score[mine]
        if len(at):
            piece = np.searchsorted(starts, at, "right") - 1
            yield k, piece, at + shift[piece], score


def _by_piece(held: list[tuple], scorer: Scorer, nucs_after_tss: int | None, words: dict[int, np.ndarray] | None = None, values: dict[int, np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, starts, scores, low, high, shift) of every kind: the hits that piece i answers for are those from low[i] to high[i], their places starts + shift[i].

    With words (Scorer.by_word) scores are looked up by word, or what values has instead."""
    starts, own, shift = _placed(held, nucs_after_tss)
    first = starts[:-1] + np.array([x[4] for x in held], np.int64)
    end = first + np.array([x[5] for x in held], np.int64)
    for k, at, score in _word_hits(held, scorer, own, words, values or words) if words else ((k, *x[2:]) for k, x in enumerate(scorer.hits([(x[-1], x[2]) for x in held]))):
        yield k, at, score, np.searchsorted(at, first), np.searchsorted(at, end), shift


def _word_hits(held: list[tuple], scorer: Scorer, own: np.ndarray, words: dict[int, np.ndarray], values: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    code = encode("\0".join([*(x[-1] for x in held), ""]))
    bad, safe, made = np.flatnonzero(code < 0), np.maximum(code, 0), {}
    for k, w in enumerate(_widths(scorer)):
        size = len(code) - w + 1
        if size <= 0:
            continue
        if w not in made:
            number, mine = safe[:size].astype(np.uint16 if w < 8 else np.int32), own[:size].copy()
            for m in range(w):
                at = bad - m
                mine[at[(at >= 0) & (at < size)]] = False
                if m:
                    number *= 4
                    number += safe[m : m + size].view(np.uint8)
            made[w] = number.astype(np.intp), mine
        number, mine = made[w]
        at = np.flatnonzero((words[w][k] != 0)[number] & mine)
        yield k, at, values[w][k][number[at]]


def _found(held: list[tuple], scorer: Scorer, nucs_after_tss: int | None) -> Iterator[pa.RecordBatch]:
    """Hits of the starts that pieces answer for; the pieces are scored together."""
    rows, locs, scores, sizes = [], [], [], [0]
    for k, piece, loc, score in _own_hits(held, scorer, nucs_after_tss):
        first = np.flatnonzero(np.diff(piece, prepend=-1))
        rows += [(k, held[i][0], held[i][1]) for i in piece[first].tolist()]
        locs.append(loc)
        scores.append(score)
        base = sizes[-1]
        sizes += (base + np.append(first[1:], len(loc))).tolist()
        if sizes[-1] > 1 << 20:
            yield _lists(rows, locs, scores, sizes)
            rows, locs, scores, sizes = [], [], [], [0]
    yield _lists(rows, locs, scores, sizes)


def _lists(rows: list[tuple], locs: list[np.ndarray], scores: list[np.ndarray], ends: list[int]) -> pa.RecordBatch:
    which, idx, seq_id = zip(*rows, strict=True) if rows else ((), (), ())
    ends = pa.array(ends, pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.empty(0, kind))) for x, kind in ((locs, np.int64), (scores, np.float64))]
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(idx, pa.int64()), pa.array(seq_id, pa.string()), *lists], ["which", "seq_idx", "seq_id", "locs", "scores"])


def score_sites_sql(seqs: DataFrame, scorer: Scorer, nucs_after_tss: int | None = None) -> DataFrame:
    """score_sites for equal and global backgrounds in plain expressions: every k-mer is scored once and joined to its starts."""
    bg, spark = scorer.background, seqs.sparkSession
    if bg.kind == "local":
        raise ValueError("local backgrounds are scored by score_sites")
    ln = lambda x: float(np.log(x)) if x > 0 else float("-inf")
    rows = [(s, p.pwm_idx, p.pwm_id, len(p.mat), [float(x) for x in p.log(s).ravel()], scorer.cutoff(p)) for s in scorer.strands for p in scorer.pwms]
    lib = spark.createDataFrame(rows, "strand string, pwm_idx int, pwm_id string, w int, theta array<double>, cutoff double")
    b = F.array(*[F.lit(ln(x)) for x in (bg.m0 if bg.kind == "global" else [0.25] * 4)])
    first_order = bg.kind == "global" and bg.m1 is not None
    b1 = F.array(*[F.lit(ln(x)) for row in bg.m1 for x in row]) if first_order else None
    tss = F.col("n") - (F.floor(F.col("n") / 2) if nucs_after_tss is None else F.lit(nucs_after_tss))
    width = max((len(p.mat) for p in scorer.pwms), default=1)
    starts = pieces(seqs, width, 0, SHORT).select("seq_idx", "seq_id", F.upper("piece").cast("binary").alias("piece"), "skip", (F.col("skip") + F.col("own") - 1).alias("last"), (F.col("offset") - tss).alias("shift"))
    widths = sorted({len(p.mat) for p in scorer.pwms})
    sites = starts.join(F.broadcast(lib.select("w").distinct()), F.length("piece") >= F.col("w"))
    sites = sites.where(F.least("last", F.length("piece") - F.col("w")) >= F.col("skip"))
    sites = sites.withColumn("j", F.explode(F.expr("sequence(skip, least(last, length(piece) - w))")))
    sites = sites.select("seq_idx", "seq_id", (F.col("j") + F.col("shift")).alias("loc"), "w", F.substr("piece", (F.col("j") + 1).cast("int"), F.col("w")).cast("string").alias("kmer"))
    few = sum(4**w for w in widths) * len(rows) <= FEW
    if few:  # all words there are, so the sites are not looked through for them, and the scored ones are broadcast
        every = [spark.range(4**w).select(F.lit(w).alias("w"), F.concat(*[F.substr(F.lit("ACGT"), (F.shiftright("id", 2 * m) % 4 + 1).cast("int"), F.lit(1)) for m in range(w)], F.lit("")).alias("kmer")) for w in widths]
        kmers = reduce(DataFrame.unionByName, every) if every else sites.select("w", "kmer").limit(0)
    else:
        sites = sites.where(F.col("kmer").rlike("^[ACGT]+$"))
        kmers = sites.select("w", "kmer").distinct()
    codes = F.transform(F.split("kmer", ""), lambda c: F.instr(F.lit("ACGT"), c) - 1)
    scored = kmers.withColumn("codes", F.slice(codes, F.lit(1), F.col("w"))).join(F.broadcast(lib), "w")

    def term(i):
        c = F.element_at("codes", i)
        above = F.element_at("theta", (i - 1) * 4 + c + 1)
        if not first_order:
            return above - F.element_at(b, c + 1)
        return above - F.when(i == 1, F.element_at(b, c + 1)).otherwise(F.element_at(b1, F.element_at("codes", F.greatest(i - 1, F.lit(1))) * 4 + c + 1))

    score = F.aggregate(F.sequence(F.lit(1), F.col("w")), F.lit(0.0), lambda acc, i: acc + term(i))
    scored = scored.withColumn("score", score).where((F.col("score") > F.col("cutoff")) & ~F.isnan("score"))
    scored = scored.drop("codes", "theta", "cutoff")
    return sites.join(F.broadcast(scored) if few else scored, ["w", "kmer"]).select("strand", "pwm_idx", "pwm_id", "seq_idx", "seq_id", "loc", "score")


def ordered(hits: DataFrame) -> DataFrame:
    """FWD before REV, then matrix label, sequence and place."""
    return hits.orderBy(F.when(F.col("strand") == "FWD", 0).otherwise(1), "pwm_id", "seq_idx", "loc")


def header_counts(hits: DataFrame) -> DataFrame:
    """(strand, pwm_id, n_seqs): sequences with at least one hit."""
    return hits.groupBy("strand", "pwm_id", "seq_idx").agg(F.lit(1).alias("one")).groupBy("strand", "pwm_id").agg(F.count("*").alias("n_seqs"))


def infinite_scores(hits: DataFrame) -> DataFrame:
    """(strand, pwm_id, n_infinite): the warning of the scans, as a count."""
    return hits.where(F.abs("score") == float("inf")).groupBy("strand", "pwm_id").agg(F.count("*").alias("n_infinite"))


def observed(hits: DataFrame, scorer: Scorer) -> tuple[DataFrame, Observation]:
    """hits whose first action also counts, by strand and matrix, all of them and the infinite ones; see observations."""
    seen, metrics = Observation(), []
    for i, (strand, p) in enumerate((s, p) for s in scorer.strands for p in scorer.pwms):
        own = (F.col("strand") == strand) & (F.col("pwm_idx") == p.pwm_idx)
        metrics += [F.count_if(own).alias(f"n{i}"), F.count_if(own & (F.abs("score") == float("inf"))).alias(f"inf{i}")]
    return hits.observe(seen, *metrics), seen


def observations(spark: SparkSession, scorer: Scorer, seen: Observation) -> DataFrame:
    """(strand, pwm_id, w, n_hits, n_infinite) of an observed scan, once an action has run."""
    got = seen.get
    kinds = [(s, p) for s in scorer.strands for p in scorer.pwms]
    return spark.createDataFrame([(s, p.pwm_id, len(p.mat), got[f"n{i}"], got[f"inf{i}"]) for i, (s, p) in enumerate(kinds)], "strand string, pwm_id string, w int, n_hits long, n_infinite long")
