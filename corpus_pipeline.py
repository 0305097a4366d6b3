"""The corpus pipeline: language ID, exact and near deduplication, mixing to target weights, best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() stores each stage's rows as
Parquet in the shared folder and reads them back for the next one, and deletes the stage's own scratch tables. All but the last
return the columns of documents, whatever their names. Null texts and texts without a letter go in the first stage; null ids,
rows that repeat an id, and whole rows that come twice are rows like any other; an empty table gives an empty one in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifspark.llm import exact_dedup, language, mixing, packing, simhash
from motifspark.llm.common import own_scratch, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or that the classifier, trained on their labelled part, rejects; no labels, no documents."""
    return language.keep_identified(docs, language.train(docs, ~language.held_out()))


def deduplicate_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that of the largest doc_id; a null one only where there is no other."""
    return exact_dedup.drop_exact(docs)


def deduplicate_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by fingerprints or by 0.8 of their five-word shingles the row of the smallest doc_id stays.

    One with a null id stays only where there is no other.
    """
    return simhash.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents: one row for each pass over a source that takes words of a document; null is a source too."""
    mixed = mixing.mixed_texts(docs, mixing.mix(docs))
    return mixed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048 tokens; a document that is mixed in twice is two texts."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", deduplicate_exact),
    ("SimHash near-dedup", deduplicate_near),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the trained classifier nor the fingerprints; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with own_scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), keep=True)
    return docs
