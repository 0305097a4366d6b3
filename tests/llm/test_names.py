"""Stages on tables whose columns have names with dots or names that operators use themselves."""

from pyspark.sql import functions as F

from motifspark.llm import language

ROW = "doc_id long, text string, lang string, `a.b` int, found string, row string"


def test_language_stage_keeps_every_column(spark):
    rows = [(i, "the cat sat on the mat " * 5 if i % 2 else "le chat est sur la table " * 5, "en" if i % 2 else "fr", i, "x", "y") for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, None, None, 7, None, None), (101, "...", None, 8, "x", "y")], ROW)
    model = language.train(docs, F.lit(True))
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns
    got = {tuple(r) for r in kept.collect()}
    assert got <= set(rows) and got
    none = language.keep_identified(docs, language.train(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)))
    assert none.columns == docs.columns and none.count() == 0
