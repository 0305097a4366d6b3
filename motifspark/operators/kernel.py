"""Vectorised scoring of one sequence: every matrix, strand and start in numpy, with no loop over positions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

STRANDS = ("FWD", "REV")
WORD = 5  # bases of a look-up: tables of 8 KB
WORDS = 1 << 23  # most cells of the tables of whole words
LOGS = 1024  # longest window of logarithms by table: 8 MB
_MASK = np.array([-1], np.int8)
_CODE = np.full(256, -1, np.int8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


@dataclass
class Pwm:
    """A matrix of a library: w rows of the probabilities of A, C, G, T."""

    pwm_idx: int
    pwm_id: str
    mat: list[list[float]]

    def log(self, strand: str) -> np.ndarray:
        m = np.array(self.mat, float).reshape(-1, 4)
        with np.errstate(divide="ignore"):
            return np.log(m if strand == "FWD" else m[::-1, ::-1])


@dataclass
class Background:
    """equal, global (m0, with m1 if given) or local (window on either side; first order unless m1 is False)."""

    kind: str = "equal"
    m0: list[float] | None = None
    m1: list[list[float]] | bool | None = None
    window: int = 250


@dataclass
class Scorer:
    """Scores of the starts of a sequence. compat: give undefined local backgrounds an infinite score instead of none."""

    pwms: list[Pwm]
    background: Background = field(default_factory=Background)
    strands: tuple[str, ...] = STRANDS
    cutoffs: list[float] | None = None  # by place, as the matrices
    compat: bool = False
    _made: list | None = field(default=None, repr=False, compare=False)

    def __post_init__(self) -> None:
        if any(s not in STRANDS for s in self.strands):
            raise ValueError(f"strands are {STRANDS}")
        if self.cutoffs is not None and len(self.cutoffs) != len(self.pwms):
            raise ValueError("one cutoff for each matrix is needed")

    def denominators(self, code: np.ndarray, n: int) -> dict[int, np.ndarray]:
        """Log-probability of the background for every start, by width."""
        bg, out = self.background, {}
        safe = np.maximum(code, 0).astype(np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            if bg.kind == "global":
                b = np.log(np.array(bg.m0, float))
                b1 = np.log(np.array(bg.m1, float)).ravel() if bg.m1 is not None and bg.m1 is not False else None
            elif bg.kind == "local":
                return self._local(code, n)
        for w in {len(p.mat) for p in self.pwms}:
            k = len(code) - w + 1
            if k <= 0:
                continue
            if bg.kind == "equal":
                out[w] = np.full(k, w * np.log(0.25))
            elif bg.kind == "global":
                total = b[safe[:k]]
                for m in range(1, w):
                    total = total + (b[safe[m : m + k]] if b1 is None else b1[safe[m - 1 : m - 1 + k] * 4 + safe[m : m + k]])
                out[w] = total
        return out

    def _local(self, code: np.ndarray, n: int) -> dict[int, np.ndarray]:
        """denominators under the local background: only the frequencies that a start's bases need are looked up, once for all widths."""
        window, first_order = self.background.window, self.background.m1 is not False
        base, pair = local_counts(code, window, first_order)
        size, out, total = len(code), {}, np.zeros(len(code))
        widths, at = {len(p.mat) for p in self.pwms}, np.arange(len(code))
        safe = np.maximum(code, 0).astype(np.int64)
        undefined = -np.inf if self.compat else np.nan
        singles = base.sum(0)
        rows = pair.reshape(4, 4, -1).sum(1).ravel() if first_order else None
        for m in range(min(max(widths, default=0), size)):
            k = size - m
            if m == 0 or not first_order:
                term = undefined if n < 2 * window + 1 else log_shares(base.ravel()[safe[m:] * size + at[:k]], singles[:k], window)
            elif n < 2 * window + 2:
                term = undefined
            else:
                prev = safe[m - 1 : -1]
                term = log_shares(pair.ravel()[(prev * 4 + safe[m:]) * size + at[:k]], rows[prev * size + at[:k]], window)
            total = total[:k] + term
            if m + 1 in widths:
                out[m + 1] = total
        if 0 in widths:
            out[0] = np.zeros(size + 1)
        return out

    def _tables(self) -> list[tuple]:
        """(matrix, strand, cutoff, blocks, rest) of every strand and matrix, made once: blocks are (first row, bases, log-probabilities of every
        word of so many bases), the one that tells sites apart most first, and rest is the most that the others can add."""
        if self._made is None:
            self._made = []
            for strand in self.strands:
                for p in self.pwms:
                    theta, blocks = p.log(strand), []
                    for m in range(0, len(theta), WORD):
                        table = np.zeros(1)
                        for row in theta[m : m + WORD]:
                            table = (table[:, None] + row).ravel()
                        blocks.append((m, min(WORD, len(theta) - m), table))
                    blocks.sort(key=lambda x: np.clip(x[2], -50, None).mean() - x[2].max())
                    self._made.append((p, strand, self.cutoff(p), blocks, sum(t.max() for _, _, t in blocks[1:])))
        return self._made

    def scores(self, seq: str, n: int | None = None):
        """(matrix, strand, score of each start, NaN where a character is masked or the background undefined).

        Log-probabilities are looked up by words of up to WORD bases, which all matrices share.
        """
        code = encode(seq)
        below = self.denominators(code, len(code) if n is None else n)
        words, masked = _words(code), _masked(code, below)
        for p, strand, _, blocks, _ in self._tables():
            k = len(code) - len(p.mat) + 1
            if k <= 0:
                yield p, strand, np.empty(0)
                continue
            total = np.zeros(k)
            for m, q, table in blocks:
                total += table[words[q - 1][m : m + k]]
            with np.errstate(invalid="ignore"):
                total -= below[len(p.mat)]
            total[masked[len(p.mat)]] = np.nan
            yield p, strand, total

    def hits(self, parts: list[tuple[str, int]]):
        """(matrix, strand, starts, scores) of the starts in the parts' text whose score exceeds the matrix's cutoff, of many (seq, n) at once.

        The parts are scored as one text with a masked character after each, as calls cost more than a short part's scores. Where a
        matrix's first word stays below the cutoff with the most that the others can add, the others are not looked up.
        """
        codes = [encode(seq) for seq, _ in parts]
        code = np.concatenate([x for c in codes for x in (c, _MASK)]) if codes else np.empty(0, np.int8)
        if self.background.kind != "local":
            below = self.denominators(code, len(code))
        else:
            below = {w: np.full(len(code) - w + 1, np.nan) for w in {len(p.mat) for p in self.pwms} if w <= len(code)}
            at = 0
            for c, (_, n) in zip(codes, parts, strict=True):
                for w, values in self.denominators(c, n).items():
                    below[w][at : at + len(values)] = values
                at += len(c) + 1
        words, masked = _words(code), _masked(code, below)
        for p, strand, cutoff, blocks, rest in self._tables():
            w = len(p.mat)
            k = len(code) - w + 1
            if k <= 0 or not blocks:
                at = np.flatnonzero(0 - below[w] > cutoff) if k > 0 else np.empty(0, int)
                yield p, strand, at, 0 - below[w][at] if k > 0 else np.empty(0)
                continue
            m, q, table = blocks[0]
            with np.errstate(invalid="ignore"):
                first = table[words[q - 1][m : m + k]]
                at = np.flatnonzero(first > below[w] + (cutoff - rest - 1e-9))
                score = first[at]
                for m, q, table in blocks[1:]:
                    score += table[words[q - 1][at + m]]
                score -= below[w][at]
                kept = (score > cutoff) & ~masked[w][at]
            yield p, strand, at[kept], score[kept]

    def by_word(self) -> dict[int, np.ndarray] | None:
        """For each width the score of every matrix and strand (rows) for every word of so many bases, 0 where it is no hit.

        None under a local background, where a word has no score of its own, and if the tables were large.
        """
        kinds, widths = [(p, s) for s in self.strands for p in self.pwms], {len(p.mat) for p in self.pwms}
        if self.background.kind == "local" or not widths or not 0 < min(widths) or len(kinds) * sum(4**w for w in widths) > WORDS:
            return None
        out = {}
        for w in widths:
            scores, step = np.zeros((len(kinds), 4**w)), w + 1
            text = ["".join("ACGT"[i >> 2 * (w - 1 - m) & 3] for m in range(w)) for i in range(4**w)]
            for k, (p, _, at, score) in enumerate(self.hits([(x, w) for x in text])):
                if len(p.mat) == w:
                    if not np.isfinite(score).all() or (score == 0).any():
                        return None
                    scores[k, at // step] = score
            out[w] = scores
        return out

    def cutoff(self, p: Pwm) -> float:
        return self.cutoffs[self.pwms.index(p)] if self.cutoffs else 0.0


def encode(seq: str) -> np.ndarray:
    return _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]


def _words(code: np.ndarray) -> list[np.ndarray]:
    """For 1 to WORD bases, the number of the word that begins at each place, masked characters read as A."""
    words = [np.maximum(code, 0).astype(np.intp)]
    while len(words) < WORD:
        words.append(words[-1][:-1] * 4 + words[0][len(words) :])
    return words


def _masked(code: np.ndarray, widths) -> dict[int, np.ndarray]:
    """For each width whether a masked character lies in the site of each start."""
    bad = np.concatenate(([0], np.cumsum(code < 0)))
    return {w: bad[w:] != bad[: len(bad) - w] for w in widths}


def _window_counts(kind: np.ndarray, kinds: int, n: int, window: int) -> np.ndarray:
    """(kinds, n): how often each kind is within window of each of n places."""
    sums = np.zeros((kinds, len(kind) + 1), np.int32)
    np.cumsum(kind == np.arange(kinds)[:, None], axis=1, dtype=np.int32, out=sums[:, 1:])
    at = np.arange(n)
    hi = np.minimum(at + window + 1, len(kind))
    return sums.take(hi, 1) - sums.take(np.minimum(np.maximum(at - window, 0), hi), 1)


def local_counts(code: np.ndarray, window: int, first_order: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Counts of bases (4, n) and pairs (16, n) around each place."""
    base = _window_counts(code, 4, len(code), window)
    if not first_order:
        return base, None
    pair = np.where((code[:-1] < 0) | (code[1:] < 0), -1, code[:-1].astype(int) * 4 + code[1:]) if len(code) else np.empty(0, int)
    return base, _window_counts(pair.astype(np.int8), 16, len(code), window)


@lru_cache(maxsize=4)
def _logs(size: int) -> np.ndarray:
    count = np.arange(size, dtype=float)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.log(count[:, None] / count).ravel()


def log_shares(count: np.ndarray, total: np.ndarray, window: int) -> np.ndarray:
    """Logarithms of count / total, looked up unless windows are long; NaN for an empty total."""
    size = 2 * window + 2
    if size <= LOGS:
        return _logs(size)[count * size + total]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.log(count / total)


def local_background(code: np.ndarray, window: int, first_order: bool = True, n: int | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Base frequencies (n, 4) and row-normalised pair frequencies (n, 16) around each place; NaN for an empty row."""
    base, pair = local_counts(code, window, first_order)
    with np.errstate(invalid="ignore", divide="ignore"):
        b = (base / base.sum(0)).T
        if not first_order:
            return b, None
        c = pair.reshape(4, 4, -1)
        return b, (c / c.sum(1, keepdims=True)).reshape(16, -1).T


def window_values(score: np.ndarray, cutoff: float, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the scores above the cutoff over each inclusive window of starts, clipped; 0 for an empty one."""
    kept = np.where(score > cutoff, score, 0.0)  # false for NaN
    lo, hi = np.clip(starts, 0, len(kept)), np.clip(ends + 1, 0, len(kept))
    if np.isinf(kept).any():
        return np.array([kept[a:b].sum() if b > a else 0.0 for a, b in zip(lo, hi, strict=True)])
    sums = np.concatenate(([0.0], np.cumsum(kept)))
    return np.where(hi > lo, sums[np.maximum(hi, lo)] - sums[lo], 0.0)
