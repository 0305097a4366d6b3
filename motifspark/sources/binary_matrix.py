"""The binary feature matrix as a data source: parallel parts with known byte offsets, read back by ranges.

A matrix is a folder: `header`, parts of rows, and `layout.json`, which lists the parts in order with the bytes before each and the
offsets of every block of rows. Header and parts, one after the other, are the single file of the format. A task writes its part and reports its
rows; the offsets are running sums over the reports, made on commit, so nothing is visible before all parts are. A reading task seeks to
the blocks that it was given, so that one large part is read by many tasks.

Register with `register(spark)`; then `df.write.format("feature_matrix").mode("append").save(path)` for a label and double columns, and
`spark.read.format("feature_matrix").load(path)`. Paths are those of pyarrow's file systems: plain ones, or file, hdfs, s3 or gs addresses.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, StringType, StructType

NAME = "feature_matrix"
BLOCK = 4096  # rows between known offsets
BEGIN, END = b"!!", b"!!!!"  # fixed values of the format


def label(text: str | None) -> bytes:
    """One byte of length and at most 255 ASCII characters."""
    raw = (text or "").encode("ascii", "replace")[:255]
    return bytes([len(raw)]) + raw


def header(rows: int, names: list[str], nonzero: int) -> bytes:
    """Big-endian counts and the columns' labels; the length of labels covers the last one only, as the format has it."""
    labels = [label(x) for x in names]
    return BEGIN + struct.pack(">iiqi", rows, len(names), nonzero, len(labels[-1]) if labels else 0) + b"".join(labels)


def packed(batch: pa.RecordBatch) -> tuple[list[bytes], int]:
    """Rows of a batch (label, doubles) in the format, and the number of cells that aren't zero; null cells are 0."""
    columns = [c.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
    cells = np.stack(columns, axis=1) if columns else np.empty((len(batch), 0))
    raw, width = cells.astype(">f8").tobytes(), 8 * len(columns)
    names = batch.column(0).cast(pa.string()).to_pylist()
    return [label(x) + raw[i * width : (i + 1) * width] + END for i, x in enumerate(names)], int(np.count_nonzero(cells))


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    """What a task reports: its place, file, rows, cells that aren't zero, bytes, and offsets of its blocks."""

    place: int
    file: str
    rows: int
    nonzero: int
    size: int
    blocks: list[int]


@dataclass
class Range(InputPartition):
    """Rows of a part from one offset to another."""

    file: str
    begin: int
    end: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool) -> None:
        self.path, self.names, self.overwrite = path, names, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        """A part under a name of its own: a repeated or speculative task cannot spoil it."""
        system, folder = _at(self.path)
        system.create_dir(folder, recursive=True)
        place = TaskContext.get().partitionId()
        out = Part(place, f"part-{place:06d}-{uuid.uuid4().hex}", 0, 0, 0, [])
        with system.open_output_stream(f"{folder}/{out.file}") as sink:
            for batch in batches:
                rows, nonzero = packed(batch)
                for row in rows:
                    if out.rows % BLOCK == 0:
                        out.blocks.append(out.size)
                    out.rows, out.size = out.rows + 1, out.size + len(row)
                sink.write(b"".join(rows))
                out.nonzero += nonzero
        return out

    def commit(self, messages: list[Part | None]) -> None:
        """Offsets by running sums over the parts, then the header and the layout."""
        system, folder = _at(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.place)
        head = header(sum(p.rows for p in parts), self.names, sum(p.nonzero for p in parts))
        layout, at = [], len(head)
        for p in parts:
            layout.append({"file": p.file, "offset": at, "rows": p.rows, "size": p.size, "blocks": p.blocks})
            at += p.size
        if not self.overwrite and system.get_file_info(f"{folder}/layout.json").type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} holds a matrix already")
        for name, data in (("header", head), ("layout.json", json.dumps({"names": self.names, "size": at, "parts": layout}).encode())):
            with system.open_output_stream(f"{folder}/{name}") as sink:
                sink.write(data)

    def abort(self, messages: list[Part | None]) -> None:
        system, folder = _at(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{folder}/{m.file}")


class Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str], blocks_a_task: int) -> None:
        self.path, self.names, self.n, self.step = path, names, len(names) - 1, blocks_a_task

    def partitions(self) -> list[Range]:
        """Ranges of so many blocks of rows each; the layout is as large as rows / BLOCK."""
        out = []
        for p in _layout(self.path)["parts"]:
            ends = p["blocks"][self.step :: self.step] + [p["size"]]
            out += [Range(p["file"], a, b) for a, b in zip(p["blocks"][:: self.step], ends, strict=False)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        system, folder = _at(self.path)
        with system.open_input_file(f"{folder}/{part.file}") as source:
            source.seek(part.begin)
            data = source.read(part.end - part.begin)
        names, rows, at, width = [], [], 0, 8 * self.n
        while at < len(data):
            length = data[at]
            names.append(data[at + 1 : at + 1 + length].decode("ascii"))
            at += 1 + length
            rows.append(data[at : at + width])
            if data[at + width : at + width + 4] != END:
                raise ValueError(f"{part.file} is no feature matrix")
            at += width + 4
        cells = np.frombuffer(b"".join(rows), ">f8").reshape(len(names), self.n).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(cells[:, i]) for i in range(self.n))], self.names)


class FeatureMatrix(DataSource):
    """Options: blocks, the number of blocks of rows that a task reads (16)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        out = StructType().add("sample", StringType())
        for name in _layout(self.options["path"])["names"]:
            out.add(name, DoubleType())
        return out

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema.names, int(self.options.get("blocks", "16")))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema.names[1:], overwrite)


def _layout(path: str) -> dict:
    system, folder = _at(path)
    with system.open_input_stream(f"{folder}/layout.json") as source:
        return json.loads(source.read())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeatureMatrix)


def write_binary(table: DataFrame, path: str) -> None:
    """A wide table (a label, then doubles) as a feature matrix in a new folder."""
    register(table.sparkSession)
    table.write.format(NAME).mode("append").save(path)


def read_binary(spark: SparkSession, path: str, blocks: int = 16) -> DataFrame:
    """(sample, one double column for each label) of a feature matrix."""
    register(spark)
    return spark.read.format(NAME).option("blocks", blocks).load(path)


def write_single(path: str, out: str) -> int:
    """The matrix as the one file of the format: header and parts copied one after the other in pieces; its bytes."""
    system, folder = _at(path)
    target, name = _at(out)
    layout = _layout(path)
    with target.open_output_stream(name) as sink:
        for file in ("header", *(p["file"] for p in layout["parts"])):
            with system.open_input_stream(f"{folder}/{file}") as source:
                while data := source.read(1 << 22):
                    sink.write(data)
    return layout["size"]
