"""Operator 7: language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, all but letters become blanks, and its byte 2- to 4-grams without an inner blank are hashed into
`BUCKETS`. Their embeddings are averaged and classified; both layers are trained by stochastic gradient descent in numpy
on a bounded sample of labelled rows, with one more class for texts of no language: rows of the sample whose letters are
shuffled or drawn anew. A temperature and a threshold, set on rows held back from the sample, calibrate the score and the
rejection: a text goes when its best language leads the class of no language by less than the threshold.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
DIM = 16
PER_LANGUAGE, MOST_ROWS = 800, 8000  # bounds of the training sample
MOST_LANGUAGES = MOST_ROWS // 2  # of which such a sample holds a row each, and as many rows of no language
EPOCHS, RATE = 8, 4.0
SPAN = 1 << 18  # bytes hashed at once
PARTS = 32  # parts in which the sample reaches the driver, one after the other
UNKNOWN = "und"
KEPT = 0.998  # least share of the rightly classified held-back rows that the rejection keeps
_LETTER = re.compile(r"[^\W\d_]")
_CLASS = np.full(256, 32, np.uint32)
_CLASS[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]


def subwords(text: str) -> np.ndarray:
    """How often each bucket's subwords occur in the whole text."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), SPAN):
        a = _CLASS[data[at : at + SPAN + 3]]
        end = min(SPAN, len(a))  # grams that start in this span
        inner, h = np.zeros(len(a), bool), a * np.uint32(0x9E3779B1)
        blank = a == 32
        for n in (2, 3, 4):
            if len(a) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + a[n - 1 :]
            ok = ~inner[: len(h)][:end] if n > 2 else ~(blank[:-1] & blank[1:])[:end]
            g = h[:end][ok]
            g = (g ^ (g >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            counts += np.bincount(g >> np.uint32(18), minlength=BUCKETS)
            inner = inner[:-1] | blank[n - 1 : n - 1 + len(inner) - 1]
    return counts


def no_language(text: str) -> str:
    """text with its letters shuffled or, one time in two, drawn from a to z; the same for the same text."""
    rng = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    letters = _LETTER.findall(text.lower())
    if rng.random() < 0.5:
        letters = rng.choices("abcdefghijklmnopqrstuvwxyz", k=len(letters))
    else:
        rng.shuffle(letters)
    new = iter(letters)
    return _LETTER.sub(lambda _: next(new), text.lower())


@dataclass
class Model:
    """The last column of weights and bias is the class of no language."""

    languages: list[str]
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = -np.inf

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(counts)
        c = counts[at]
        return (c @ self.embedding[at] / max(1, c.sum())) @ self.weights + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score and whether it is rejected; und, 0, True without a letter or without a model."""
        if not isinstance(text, str) or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        z = self.logits(subwords(text))
        p = _softmax(z[:-1] / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(_lead(z) < self.reject_below)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _lead(z: np.ndarray) -> float:
    """Logit of the best language above that of no language."""
    return float(z[:-1].max() - z[-1])


def _shares(counts: np.ndarray) -> np.ndarray:
    c = counts.astype(np.float32)
    return c / max(1, c.sum())


def fit(samples: list[tuple[np.ndarray, np.ndarray, str | None]], seed: int = 7) -> Model:
    """Train on (buckets, counts, language) samples, of no language where it is null; every fifth one calibrates instead.

    Counts may have any scale of at least 1; shares are taken from them a row at a time, so the sample is held once.
    """
    languages = sorted({x[2] for x in samples if x[2] is not None})
    classes = [*languages, None]
    rng = np.random.default_rng(seed)
    model = Model(languages, rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.1, (DIM, len(classes))), np.zeros(len(classes)))
    rows = [(at, c, classes.index(x)) for at, c, x in samples]
    held, train = rows[::5], [x for i, x in enumerate(rows) if i % 5] or rows
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            at, w, y = train[i]
            w = _shares(w)
            rate = RATE * (1 - done / steps)
            hidden = w @ model.embedding[at]
            error = _softmax(hidden @ model.weights + model.bias)
            error[y] -= 1
            back = (model.weights @ error).astype(np.float32)
            model.weights -= 0.1 * rate * np.outer(hidden, error)
            model.bias -= 0.02 * rate * error
            model.embedding[at] -= np.float32(rate) * np.outer(w / (w.max() if len(w) else 1), back) * np.float32(0.1)
            done += 1
    leads: tuple[list[float], list[float]] = ([], [])  # of right rows, and of rows of no language
    z = [((_shares(w) @ model.embedding[at]) @ model.weights + model.bias, y) for at, w, y in held]
    named = [(a[:-1], y) for a, y in z if y < len(languages)]
    if named:
        loss = lambda t: -np.mean([np.log(_softmax(a / t)[b] + 1e-300) for a, b in named])
        model.temperature = float(min(np.geomspace(1, 8, 13), key=loss))
    for a, y in z:
        if y == len(languages) or a[:-1].argmax() == y:
            leads[y == len(languages)].append(_lead(a))
    if leads[0] and leads[1]:
        # half-way between the two where they lie apart, and never so high that more than 1 - KEPT of the right rows go
        right, none = np.quantile(leads[0], 1 - KEPT), np.quantile(leads[1], 0.99)
        model.reject_below = float(min(right, (right + none) / 2))
    return model


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model:
    """Fit on labelled rows that are usable: about per_language of each of the most_languages most frequent languages.

    Rows are chosen by a hash of their id, and as many as a language has are repeated as texts of no language, MOST_ROWS at
    most in all; their subword counts, of at most BUCKETS buckets each, go to the driver in PARTS parts, four bytes a bucket:
    its number, and its count as a share of the row's largest one in half precision.
    Without a labelled row the model knows no language and answers und.
    """
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counted = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not counted:
        return Model([], np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, 1)), np.zeros(1))
    per_language = min(per_language, MOST_ROWS // (len(counted) + 1))
    part = F.element_at(F.create_map(*[F.lit(x) for k, n in counted.items() for x in (k, min(1.0, per_language / n))]), F.col("lang"))
    chance = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(F.col("lang").isin(*counted)).where(chance < part)
    again = F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(len(counted))) == 0
    chosen = chosen.select("id", "text", "lang", again.alias("again"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, langs, again = (x.to_pylist() for x in batch.columns)
            more = [i for i, x in enumerate(again) if x and _LETTER.search(texts[i])]
            counts = [subwords(x) for x in [*texts, *(no_language(texts[i]) for i in more)]]
            ids, langs = [*ids, *(ids[i] for i in more)], [*langs, *(None for _ in more)]
            at = [np.flatnonzero(c) for c in counts]
            n = [(c[a] / max(1, c.max())).astype(np.float16).tobytes() for c, a in zip(counts, at, strict=True)]
            columns = [pa.array(ids, batch.column(0).type), pa.array(langs, pa.string()), pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()), pa.array(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang", "at", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = chosen.mapInArrow(work, f"id {kind}, lang string, at binary, n binary").withColumn("order", F.xxhash64(F.lit(12), "id"))
    found = found.orderBy("order", "id", "lang", "at", "n").limit(MOST_ROWS).drop("id").repartition(PARTS)
    rows = sorted(found.toLocalIterator(), key=lambda r: (r.order, r.lang is None, r.lang or "", r.at, r.n))
    return fit([(np.frombuffer(r.at, np.uint16), np.frombuffer(r.n, np.float16), r.lang) for r in rows])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with one more column, found: a struct of lang_pred, score and rejected, from the whole text alone.

    A null text, or one without a letter, gives und, 0 and true; rows that repeat are predicted each; an empty table gives
    an empty one. A column of docs that is named found is replaced: keep_identified keeps all columns, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(x) for x in texts], columns=["lang_pred", "score", "rejected"])

    return docs.withColumn("found", found(F.col(f"`{text_col}`")))


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects (no letter, or too little lead over texts of no language)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = predict(docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text_")), model, "text_")
    return marked.where(~F.col("found.rejected")).select("row.*")


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text divisible by 5; null ids too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))
