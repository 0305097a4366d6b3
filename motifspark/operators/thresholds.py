"""Exact score distributions of matrices, and the thresholds taken from them.

A site's score is a sum of one term a place, ln theta less the log-probability of the base after the ones before it, so its distribution
is found place by place: a dynamic programme over (last bases, score so far) with scores in whole multiples of a grain.
Nothing is sampled: every site that the background (or the matrix) can make is in the distribution with its probability.
A library's matrices are dealt over tasks; background counts are made where the sequences are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifspark.operators.kernel import Pwm, encode
from motifspark.operators.scan import PIECE, pieces

GRAIN = 1e-3  # of scores
MOST_ORDER = 8  # 4^9 counts reach the driver
DISTRIBUTION = "pwm_idx int, pwm_id string, kind string, score_idx long, score double, p double"


@dataclass
class Markov:
    """A background of order k: probs[j][context, base] for contexts of j bases, j = 0 ... k; a site's first bases use the shorter ones."""

    probs: list[np.ndarray]

    @property
    def order(self) -> int:
        return len(self.probs) - 1


def word_counts(seqs: DataFrame, length: int, piece: int = PIECE) -> DataFrame:
    """(word, n): how often each run of `length` recognised characters occurs; word holds the bases as digits to base 4.

    Sequences are cut, and counts are summed in the tasks before they are shuffled.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4**length, np.int64)
        for batch in batches:
            for skip, own, seq in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("skip", "own", "piece")), strict=True):
                code = encode(seq).astype(np.int64)[skip : skip + own + length - 1]
                n = len(code) - length + 1
                if n > 0:
                    word, good = np.zeros(n, np.int64), np.ones(n, bool)
                    for m in range(length):
                        word = word * 4 + code[m : m + n]
                        good &= code[m : m + n] >= 0
                    total += np.bincount(word[good], minlength=4**length)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["word", "n"])

    return pieces(seqs, length, 0, piece).mapInArrow(work, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def markov_background(seqs: DataFrame, order: int = 1, pseudo: float = 0.0) -> Markov:
    """The background of a given order of all sequences, pseudo added to each count; a context that never occurs is uniform.

    4^(order+1) counts reach the driver at most, and those of the shorter contexts.
    """
    if not 0 <= order <= MOST_ORDER:
        raise ValueError(f"the order is 0 to {MOST_ORDER}")
    probs = []
    for j in range(order + 1):
        counts = np.full(4 ** (j + 1), float(pseudo))
        for word, n in word_counts(seqs, j + 1).collect():
            counts[word] += n
        counts = counts.reshape(-1, 4)
        total = counts.sum(1, keepdims=True)
        probs.append(np.where(total > 0, counts / np.where(total > 0, total, 1), 0.25))
    return Markov(probs)


def distribution(mat: list[list[float]], background: Markov, grain: float = GRAIN) -> tuple[int, np.ndarray, np.ndarray]:
    """(low, bg, fg): the probability that a background's site, and one made by the matrix, scores (low + i) * grain.

    Terms are rounded to multiples of grain, halves up, so a score is off by width * grain / 2 at most. Sites of infinite score are
    left out: bg and fg sum to less than 1 by their probability.
    """
    theta = np.array(mat, float).reshape(-1, 4)
    k, steps = background.order, []
    for m in range(len(theta)):
        prior = background.probs[min(m, k)]
        with np.errstate(divide="ignore", invalid="ignore"):
            term = np.log(theta[m])[None, :] - np.log(prior)
        finite = np.isfinite(term)
        steps.append((np.where(finite, np.floor(np.where(finite, term, 0) / grain + 0.5), 0).astype(np.int64), finite, prior, theta[m] / theta[m].sum()))
    lows = [int(t[f].min(initial=0)) if f.any() else 0 for t, f, _, _ in steps]
    size = 1 + sum((int(t[f].max(initial=lo)) if f.any() else 0) - lo for (t, f, _, _), lo in zip(steps, lows, strict=True))
    now = np.zeros((2, 1, size))  # of the background and the matrix, by context
    now[:, 0, 0] = 1
    used = 1
    for m, ((term, finite, prior, own), low) in enumerate(zip(steps, lows, strict=True)):
        keep = 4 ** min(m + 1, k)
        after = np.zeros((2, keep, size))
        more = int((term - low)[finite].max(initial=0)) if finite.any() else 0
        for context in range(now.shape[1]):
            for base in range(4):
                if finite[context, base]:
                    d = int(term[context, base]) - low
                    to = (context * 4 + base) % keep
                    after[0, to, d : d + used] += now[0, context, :used] * prior[context, base]
                    after[1, to, d : d + used] += now[1, context, :used] * own[base]
        now, used = after, used + more
    return sum(lows), now[0].sum(0), now[1].sum(0)


def _library(spark: SparkSession, pwms: list[Pwm]) -> DataFrame:
    """(pwm_idx, pwm_id, mat), a task each for up to as many tasks as there are matrices."""
    rows = spark.createDataFrame([(p.pwm_idx, p.pwm_id, [[float(x) for x in r] for r in p.mat]) for p in pwms], "pwm_idx int, pwm_id string, mat array<array<double>>")
    return rows.repartition(max(1, min(len(pwms), 4 * spark.sparkContext.defaultParallelism)), "pwm_idx")


def score_distributions(spark: SparkSession, pwms: list[Pwm], background: Markov, grain: float = GRAIN) -> DataFrame:
    """(pwm_idx, pwm_id, kind BG or FG, score_idx, score, p): the exact distributions of all matrices; scores that cannot occur have no row."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for idx, name, mat in zip(pdf["pwm_idx"], pdf["pwm_id"], pdf["mat"], strict=True):
                low, *both = distribution([list(r) for r in mat], background, grain)
                for kind, p in zip(("BG", "FG"), both, strict=True):
                    at = np.flatnonzero(p)
                    yield pd.DataFrame({"pwm_idx": idx, "pwm_id": name, "kind": kind, "score_idx": low + at, "score": (low + at) * grain, "p": p[at]})

    return _library(spark, pwms).mapInPandas(work, DISTRIBUTION)


def cutoffs(low: int, bg: np.ndarray, fg: np.ndarray, criterion: float) -> tuple[float, float]:
    """(false-positive, false-negative) cutoff in grains: the lowest score that background sites exceed with probability criterion at
    most, and the highest that the matrix's own sites do not exceed with probability criterion at most.

    Sites count as hits above the cutoff. Where every score misses too many own sites, the one just below the lowest.
    """
    # both from the small side up, so that tails keep their digits
    above = np.concatenate((np.cumsum(bg[::-1])[::-1][1:], [0.0]))
    possible = np.flatnonzero((bg > 0) | (fg > 0))
    if not len(possible):
        return np.nan, np.nan
    fp = possible[above[possible] <= criterion]
    missed = np.cumsum(fg)
    fn = possible[missed[possible] <= criterion]
    return float(low + fp[0]), float(low + (fn[-1] if len(fn) else possible[0] - 1))


def exact_thresholds(spark: SparkSession, pwms: list[Pwm], background: Markov, criterion: float = 0.01, kind: str = "FP", grain: float = GRAIN, midpoint: bool = False) -> DataFrame:
    """(pwm_idx, pwm_id, cutoff, fp, fn) of each matrix: the cutoff, and the exact error rates of hits above it.

    kind: FP, FN (see cutoffs) or MAX, the larger of both. midpoint: halfway to the next score that can occur, so that rounding cannot turn a
    site at the cutoff into a hit; the rates are the same. Matrices without a score that can occur have nulls.
    """
    if kind not in ("FP", "FN", "MAX"):
        raise ValueError("kind is FP, FN or MAX")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for idx, name, mat in zip(pdf["pwm_idx"], pdf["pwm_id"], pdf["mat"], strict=True):
                low, bg, fg = distribution([list(r) for r in mat], background, grain)
                both = cutoffs(low, bg, fg, criterion)
                at = {"FP": both[0], "FN": both[1], "MAX": max(both)}[kind]
                if np.isnan(at):
                    out.append((idx, name, None, None, None))
                    continue
                first = int(at) - low + 1
                later = np.flatnonzero((bg[max(0, first) :] > 0) | (fg[max(0, first) :] > 0))
                half = (max(0, first) + later[0] + low - at) / 2 if midpoint and len(later) else 0.0
                out.append((idx, name, (at + half) * grain, float(bg[max(0, first) :].sum()), float(fg[: max(0, first)].sum())))
            yield pd.DataFrame(out, columns=["pwm_idx", "pwm_id", "cutoff", "fp", "fn"])

    return _library(spark, pwms).mapInPandas(work, "pwm_idx int, pwm_id string, cutoff double, fp double, fn double")


def binned(distributions: DataFrame, bins: int = 500) -> DataFrame:
    """(pwm_id, kind, bin_idx, lb, ub, height): histograms of the distributions in equal bins from a matrix's lowest score to its highest."""
    span = Window.partitionBy("pwm_id")
    low, high = F.min("score").over(span), F.max("score").over(span)
    rows = distributions.select("pwm_id", "kind", "score", "p", low.alias("low"), high.alias("high"))
    width = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / bins).otherwise(F.lit(1.0))
    rows = rows.withColumn("width", width).withColumn("bin_idx", F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("low")) / F.col("width"))).cast("int"))
    held = rows.groupBy("pwm_id", "kind", "bin_idx", "low", "width").agg(F.sum("p").alias("height"))
    lb = F.col("low") + F.col("bin_idx") * F.col("width")
    return held.select("pwm_id", "kind", "bin_idx", lb.alias("lb"), (lb + F.col("width")).alias("ub"), "height")
