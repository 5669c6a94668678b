"""A training corpus from ``documents``: five stages, each written as Parquet and read again as the next one's input.

toxicity: documents scored 0.5 or more go.
near_dup: one document of each near-duplicate component stays.
decontaminate: documents that hold a benchmark item go.
secrets: secrets in texts are masked.
mixing: documents are drawn towards the sources' target weights, once per take, with their shard.

Defined results, stage by stage as the operators have them: rows with a null or empty text are not toxic, are copies of
nothing and hold neither benchmark items nor secrets; as they have no words, the mix never takes them.  Rows with a null id are
judged by their texts, and never dropped as copies.  Of rows that repeat one, one stays.  Very long texts are read whole.  Columns
beyond those of ``documents`` pass through all stages, whatever their names; the mix puts its copy and shard in
place of columns of these names.  Empty tables give empty tables; without labels or benchmark these stages keep all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, decontaminate, mixing, near_dup, secrets, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return near_dup.deduplicated(docs, k=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    masked = secrets.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*names) if "n_chars" in names else masked.select(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dup", drop_copies),
    ("decontaminate", drop_leaks),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: SQL can't express the learnt and latent stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; those before go once they have been read."""
    docs = common.table(spark, sf_dir, "documents")
    for no, (name, stage) in enumerate(STAGES):
        done = docs
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if no:
            common.forget(done)
    return docs
