"""Scans of sequence files as they arrive in a folder: stateless, so any trigger and any output mode that appends will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifspark.operators.kernel import Scorer
from motifspark.operators.scan import score_sites


def stream_fasta(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Unbounded (seq_idx, seq_id, seq) of the records of new files; seq_idx is a hash of file and label."""
    raw = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    body = F.regexp_replace("value", "^>", "")
    parts = F.split(body, "\n", 2)
    seq_id = F.split(F.trim(parts[0]), r"\s+")[0]
    rows = raw.select(F.xxhash64(F.col("_metadata.file_path"), seq_id).alias("seq_idx"), seq_id.alias("seq_id"), F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), r"\s", "").alias("seq"))
    return rows.where(F.col("seq_id") != "")


def stream_hits(spark: SparkSession, folder: str, scorer: Scorer, nucs_after_tss: int | None = 0) -> DataFrame:
    """Unbounded hits of the sequences that arrive; write them with writeStream and a checkpoint location."""
    return score_sites(stream_fasta(spark, folder), scorer, nucs_after_tss)
