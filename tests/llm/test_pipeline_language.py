"""The pipeline's first stage on documents of which some carry another language's label."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F


def test_swapped_labels_are_mended(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.col("lang").alias("true_lang"), "source", "n_chars")
    named = F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")])
    other = F.element_at(named, (F.pmod(F.array_position(named, "true_lang") + F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(4)) + 1).cast("int"))
    swapped = docs.withColumn("lang", F.when(F.crc32(F.concat(F.lit("swap"), "doc_id")) % 20 == 0, other).otherwise(F.col("true_lang")))
    wrong = swapped.filter("lang <> true_lang").count()
    assert wrong >= 30
    kept = corpus_pipeline.identify_language(spark, swapped, "")
    assert kept.count() == docs.count()  # no clean document is lost
    assert kept.filter("lang <> true_lang").count() <= wrong // 20
