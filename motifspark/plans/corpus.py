"""The driver's tables as sequences, intervals and small libraries, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifspark.operators import scan
from motifspark.operators.kernel import Pwm
from motifspark.sources.readers import normalise

# fixed values: letters in order of the alphabet, upper then lower case, dealt to A, C, G, T in turn
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DEALT = "".join("ACGT"[i % 26 % 4] for i in range(52))

MATRICES = {
    "MOTIF_A": [[0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.7, 0.1], [0.05, 0.05, 0.1, 0.8], [0.6, 0.2, 0.1, 0.1], [0.1, 0.6, 0.2, 0.1], [0.25, 0.25, 0.25, 0.25]],
    "MOTIF_B": [[0.05, 0.05, 0.85, 0.05], [0.8, 0.1, 0.05, 0.05], [0.1, 0.1, 0.1, 0.7], [0.45, 0.05, 0.45, 0.05]],
}
REGIONS = [(0, "MOTIF_A", "FWD", -3.0, 8.5), (1, "MOTIF_B", "FWD", 12.7, 140.0), (0, "MOTIF_A", "REV", -3.0, 10.0), (1, "MOTIF_B", "REV", None, None)]
ROE_SQL = "row_idx int, pwm_id string, strand string, max_peak_loc double, half_width double"


def library(pseudo: float) -> list[Pwm]:
    return [Pwm(i, k, normalise(m, pseudo)) for i, (k, m) in enumerate(MATRICES.items())]


def raw_library() -> list[Pwm]:
    """The matrices as they are written to a file: cells of four places, without pseudo counts."""
    return [Pwm(i, k, m) for i, (k, m) in enumerate(MATRICES.items())]


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, ROE_SQL)


def sequences(spark: SparkSession, sf_dir: str, masked: bool = False) -> DataFrame:
    """(seq_idx, seq_id, seq) of whole documents: letters dealt to bases; others dropped, or kept as masked characters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = scan.spread(docs, "doc_id")  # the table's one row group would be one task
    kept = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]", "." if masked else "")
    return docs.select(F.col("doc_id").alias("seq_idx"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("seq_id"), F.translate(kept, LETTERS, DEALT).alias("seq"))


def open_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, tissue, start, end): an interval of 5 to 44 places for each event, around the TSS of its user's sequence."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    start = F.col("event_id") % 900 - 520
    return e.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("seq_id"), F.when(F.col("event_id") % 2 == 0, "LEAF").otherwise("ROOT").alias("tissue"), start.alias("start"), (start + 5 + F.col("event_id") % 40).alias("end"))
