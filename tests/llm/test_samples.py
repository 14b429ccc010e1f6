"""Op 2's sample of a language whose rows mostly have no text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import langid_ppm


def test_rows_without_text_take_no_place(spark):
    text = F.when(F.col("id") % 100 == 0, F.concat(F.lit("text "), "id")).when(F.col("id") % 2 == 0, F.lit(""))
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
    assert len(langid_ppm.training_sample(d, F.lit(False))["en"]) == 200
    assert len(langid_ppm.training_sample(d, F.lit(False), per_language=50)["en"]) == 50
