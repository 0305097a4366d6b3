"""Sequence files whose records are read by many tasks: one chromosome is as many pieces as its file has splits.

Spark splits a file at line ends; a task reads its split's lines and knows neither which record the first ones belong to nor how far
that record has come. A small index, a row per split, holds what is needed: how many records start in it, and how many bases lie before the
first start and after the last. Running sums over it give every segment its record, its place there and the record's length.
Lines must be of bounded length, as they are in such files; a record may be of any.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifspark.operators.scan import PIECE, spread
from motifspark.operators.stats import small

SPLIT = "file string, split bigint, no bigint, header string, n bigint, offset bigint, bases string"
INDEX = "file string, split bigint, starts bigint, head bigint, tail bigint, last string"


class _Reader:
    """Cuts the lines of one split into segments: runs of bases of one record."""

    def __init__(self, file: str, split: int, size: int) -> None:
        self.file, self.split, self.size = file, split, size
        self.no, self.header, self.offset = 0, None, 0  # of the record that is open; 0: it began before this split
        self.held, self.length = [], 0
        self.waiting: list[tuple] = []  # segments of a record whose length is not yet known
        self.head, self.out = 0, []

    def line(self, text: str) -> None:
        text = text.strip()
        if text.startswith(">"):
            self.close(True)
            self.no, self.header, self.offset = self.no + 1, text[1:].strip(), 0
        elif text:
            bases = "".join(text.split())
            self.held.append(bases)
            self.length += len(bases)
            if self.length >= self.size:
                self.flush()

    def flush(self) -> None:
        self.waiting.append((self.file, self.split, self.no, self.header, None, self.offset, "".join(self.held)))
        self.offset += self.length
        self.held, self.length = [], 0
        if self.no == 0:  # its length is the index's to know
            self.out += self.waiting
            self.waiting = []

    def close(self, ended: bool) -> None:
        """ended: the next line starts a record, so an own record's length is known."""
        if self.held or (self.no and not self.offset):
            self.flush()
        n = self.offset if ended and self.no else None
        self.out += [(*x[:4], n, *x[5:]) for x in self.waiting]
        self.waiting = []
        if self.no == 0:
            self.head = self.offset

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def facts(self) -> tuple:
        return self.file, self.split, self.no, self.head, self.offset, self.header


def _segments(lines: DataFrame, size: int, index: bool) -> DataFrame:
    names = [c.split()[0] for c in (INDEX if index else SPLIT).split(", ")]
    text, number = pa.string(), pa.int64()
    types = [text, number, number, number, number, text] if index else [text, number, number, text, number, number, text]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), types, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for value, file, split in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or (file, split) != (now.file, now.split):
                    if now is not None:
                        now.close(False)
                        out += [now.facts()] if index else now.taken()
                    now = _Reader(file, split, size)
                now.line(value)
                if index:
                    now.taken()
            out += [] if index or now is None else now.taken()
            yield batch_of(out)
        if now is not None:
            now.close(False)
            yield batch_of([now.facts()] if index else now.taken())

    return lines.mapInArrow(work, INDEX if index else SPLIT)


def read_split_fasta(spark: SparkSession, path: str, size: int = PIECE) -> DataFrame:
    """(seq_idx, seq_id, header, n, offset, bases): segments of about `size` bases at most, of records of any length.

    n is the record's length and offset the segment's place in it; a record without bases has one empty segment. seq_idx counts the records
    in order of files (by path) and places. Text before a file's first header and white space are dropped. Files are read twice: once for the index.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    splits = _segments(lines, size, True)
    order = Window.partitionBy("file").orderBy("split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    started = F.when(F.col("starts") > 0, 1).otherwise(0)
    total = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0)).cast("long")
    # group: how many splits with a start lie before; a record that runs on from one split into others is in their groups
    splits = splits.select("*", total(started, before).alias("group"), total("starts", before).alias("first")).withColumn("own", F.col("group") + started)
    run = Window.partitionBy("file", "group").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("heads", total("head", run))
    heads = splits.groupBy("file", "group").agg(F.sum("head").alias("rest"))
    began = splits.where("starts > 0").select("file", F.col("own").alias("group"), F.col("tail").alias("begun"), F.col("last").alias("carried"))
    records = began.join(heads, ["file", "group"], "left").select("file", "group", "carried", "begun", (F.col("begun") + F.coalesce("rest", F.lit(0))).alias("whole"))
    files = splits.groupBy("file").agg(F.sum("starts").alias("starts")).orderBy("file").collect()  # as many rows as there are files
    firsts, at = [], 0
    for f in files:
        firsts.append((f.file, at))
        at += f.starts
    index = splits.join(spark.createDataFrame(firsts, "file string, file_first bigint"), "file")
    index = index.join(records, ["file", "group"], "left").withColumn("open_at", F.col("begun") + F.col("heads"))
    own = records.select("file", F.col("group").alias("own"), F.col("whole").alias("last_n"))
    index = index.join(own, ["file", "own"], "left").select("file", "split", (F.col("file_first") + F.col("first")).alias("first"), "carried", "open_at", "whole", "last_n")
    met = _segments(lines, size, False).join(small(index), ["file", "split"])
    runs_on = F.col("no") == 0
    header = F.when(runs_on, F.col("carried")).otherwise(F.col("header"))
    out = met.where(header.isNotNull()).select(
        (F.col("first") + F.col("no") - 1).alias("seq_idx"), F.split(header, r"\s+")[0].alias("seq_id"), header.alias("header"),
        F.when(runs_on, F.col("whole")).otherwise(F.coalesce("n", "last_n")).alias("n"), F.when(runs_on, F.col("open_at") + F.col("offset")).otherwise(F.col("offset")).alias("offset"), "bases",
    )
    return out.where(F.col("seq_id") != "")


def segment_pieces(segments: DataFrame, width: int, window: int, size: int = PIECE) -> DataFrame:
    """The pieces of segments as operators.scan.pieces makes them of whole sequences: (seq_idx, seq_id, n, offset, skip, own, piece).

    Each segment goes, cut, to the pieces that need some of it, and each piece is put together of its parts: the one exchange that scoring needs anyway.
    """
    margin = window + 1
    rows = segments.where("n > 0").select("seq_idx", "seq_id", "n", F.col("offset").alias("at"), "bases", F.length("bases").cast("long").alias("len")).where("len > 0")
    # a piece needs [k size - margin, (k + 1) size + margin + width)
    first = F.greatest(F.lit(0), F.floor((F.col("at") - margin - width) / size)).cast("long")
    last = F.least(F.expr(f"(n - 1) div {size}"), F.floor((F.col("at") + F.col("len") - 1 + margin) / size)).cast("long")
    rows = rows.withColumns({"first": first, "last": last}).where("`first` <= `last`").withColumn("k", F.explode(F.expr("sequence(`first`, `last`)")))
    own = F.least(F.col("n") - F.col("k") * size, F.lit(size)).cast("long")
    low = F.greatest(F.lit(0), F.col("k") * size - margin)
    high = F.least(F.col("n"), F.col("k") * size + own + margin + width)
    rows = rows.withColumns({"own": own, "low": low.cast("long"), "a": F.greatest("at", low), "b": F.least(F.col("at") + F.col("len"), high)}).where("a < b")
    part = F.substr("bases", (F.col("a") - F.col("at") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int"))
    rows = spread(rows.select("seq_idx", "seq_id", "n", "k", "low", "own", F.col("a").alias("from"), part.alias("part")), "seq_idx", "k")
    parts = rows.groupBy("seq_idx", "k").agg(*[F.first(c).alias(c) for c in ("seq_id", "n", "low", "own")], F.array_sort(F.collect_list(F.struct("from", "part"))).alias("parts"))
    piece = F.array_join(F.transform("parts", lambda x: x["part"]), "")
    return parts.select("seq_idx", "seq_id", "n", F.col("low").alias("offset"), (F.col("k") * size - F.col("low")).alias("skip"), "own", piece.alias("piece"))
