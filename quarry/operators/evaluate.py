"""Lexical evaluation of predictions, and sanity checks of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import exact_match, is_blank, normalize_question, token_recall

# Fixed value: the summary's warning.
WARNING = "Lexical metrics are a baseline only."


def evaluated(rows: DataFrame) -> DataFrame:
    """All columns of ``rows`` (prediction, reference, ...) with ``exact_match`` and ``token_recall``."""
    p, r = F.coalesce(F.col("prediction"), F.lit("")), F.coalesce(F.col("reference"), F.lit(""))
    return rows.withColumns({"exact_match": exact_match(p, r), "token_recall": token_recall(p, r)})


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """One row; means of no examples are 0."""
    return rows.agg(
        F.count("*").alias("examples"),
        F.coalesce(F.avg(F.col("exact_match").cast("double")), F.lit(0.0)).alias("exact_match"),
        F.coalesce(F.avg("token_recall"), F.lit(0.0)).alias("mean_token_recall"),
        F.lit(WARNING).alias("warning"),
    )


def dataset_sanity(records: DataFrame, corpus_ids: DataFrame | None = None) -> DataFrame:
    """One row of the planned checks: empty fields, missing sources, repeated questions, mean lengths."""
    rows = records.withColumn("_key", normalize_question(F.col("instruction")))
    stats = rows.agg(
        F.count("*").alias("examples"),
        F.count_if(is_blank(F.col("instruction"))).alias("empty_instructions"),
        F.count_if(is_blank(F.col("output"))).alias("empty_outputs"),
        (1 - F.countDistinct("_key") / F.count("*")).alias("duplicate_question_rate"),
        F.avg(F.length("input")).alias("mean_input_length"),
        F.avg(F.length("output")).alias("mean_output_length"),
    )
    if corpus_ids is None:
        return stats
    missing = records.join(corpus_ids.select("document_id").distinct(), "document_id", "left_anti").agg(F.count("*").alias("missing_sources"))
    return stats.crossJoin(missing)  # one row each


def type_distribution(records: DataFrame) -> DataFrame:
    return records.groupBy("document_type").agg(F.count("*").alias("examples"))


def dataset_hash(records: DataFrame) -> DataFrame:
    """A version of the dataset that doesn't depend on the order of its rows."""
    return records.agg(F.count("*").alias("examples"), F.sum(F.xxhash64(*records.columns).cast("decimal(38,0)")).alias("version"))
