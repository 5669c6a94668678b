"""Train, validation and test split by document: whole documents, exact sizes, seeded order."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank

SEED = 42
TRAIN, VALIDATION = 0.90, 0.05
RANK_PARTS = 256


def check_ratios(train: float, validation: float) -> None:
    if train + validation >= 1:
        raise ValueError("train and validation ratios must add up to less than 1")


def check_ids(records: DataFrame, order: str, key: str = "document_id") -> None:
    """Raise for the first record, counted from 1 in file order, without an id."""
    bad = records.where(is_blank(F.col(key).cast("string"))).agg(F.min(order).alias("first")).first()["first"]
    if bad is not None:
        n = records.where(F.col(order) <= bad).count()
        raise ValueError(f"record {n}: document_id is missing; validate the dataset first")


def ranked_ids(records: DataFrame, seed: int = SEED, key: str = "document_id") -> DataFrame:
    """(key, rank from 1, n) of the distinct ids by md5 of seed and id.

    Ranks are exact without one sort: ids fall into ranges by the leading hex
    digits, are ranked within, and get the count of the ranges before.
    """
    ids = records.select(F.col(key).cast("string").alias(key)).distinct()
    ids = ids.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary")))
    ids = ids.withColumn("_part", F.substring("_h", 1, 2))
    sizes = ids.groupBy("_part").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")
    sizes = sizes.withColumns({"_before": before, "n": F.sum("_c").over(Window.partitionBy())}).drop("_c")  # 256 rows
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_h", key))
    return ids.withColumn("_r", rank).join(F.broadcast(sizes), "_part").select(key, (F.col("_r") + F.col("_before")).alias("rank"), "n")


def shuffled_ids(records: DataFrame, order: str, seed: int = SEED, key: str = "document_id") -> DataFrame:
    """(key, rank, n) in the order of a seeded Mersenne-Twister shuffle of the ids in first-seen order.

    For parity with a single-process run: the ids, not the records, come to the driver.
    """
    ids = [r[0] for r in records.groupBy(F.col(key).cast("string").alias("k")).agg(F.min(order).alias("o")).orderBy("o").select("k").collect()]
    random.Random(seed).shuffle(ids)
    return records.sparkSession.createDataFrame([(k, i + 1, len(ids)) for i, k in enumerate(ids)], f"{key} string, rank long, n long")


def assigned(ranked: DataFrame, train: float = TRAIN, validation: float = VALIDATION, cap: int | None = None) -> DataFrame:
    """(key, split): the first int(n * train) ids, the next int(n * validation), the rest; beyond a cap (0: none) ids have no split."""
    check_ratios(train, validation)
    n = F.least(F.col("n"), F.lit(cap)) if cap else F.col("n")
    rows = ranked.where(F.col("rank") <= cap) if cap else ranked
    first = F.floor(n * F.lit(float(train)))
    second = first + F.floor(n * F.lit(float(validation)))
    return rows.select(*(c for c in ranked.columns if c not in ("rank", "n")), F.when(F.col("rank") <= first, "train").when(F.col("rank") <= second, "validation").otherwise("test").alias("split"))


def split_records(records: DataFrame, train: float = TRAIN, validation: float = VALIDATION, seed: int = SEED, cap: int | None = None, key: str = "document_id") -> DataFrame:
    """``records`` with ``split``; null for documents beyond the cap, which stay in the whole dataset only."""
    ids = assigned(ranked_ids(records, seed, key), train, validation, cap).withColumnRenamed(key, "_id")
    return records.join(ids, records[key].cast("string") == F.col("_id"), "left").drop("_id")


def summary(split: DataFrame, key: str = "document_id") -> DataFrame:
    """One row: documents within the cap, all examples, and examples and documents by split."""
    docs = split.groupBy(F.col(key).cast("string").alias("k"), "split").agg(F.count("*").alias("c"))
    cols = [F.count_if(F.col("split").isNotNull()).alias("documents"), F.coalesce(F.sum("c"), F.lit(0)).alias("examples")]
    for s in ("train", "validation", "test"):
        cols.append(F.coalesce(F.sum(F.when(F.col("split") == s, F.col("c"))), F.lit(0)).alias(f"{s}_examples"))
        cols.append(F.count_if(F.col("split") == s).alias(f"{s}_documents"))
    return docs.agg(*cols)


def leaks(split: DataFrame, key: str = "document_id") -> DataFrame:
    """Ids in more than one split; none are expected."""
    return split.groupBy(key).agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def write_splits(split: DataFrame, folder: str) -> None:
    """all, train, validation and test as JSON lines under ``folder``, and split_summary."""
    split = split.persist()
    try:
        split.drop("split").write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/all")
        for s in ("train", "validation", "test"):
            split.where(F.col("split") == s).drop("split").write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{s}")
        summary(split).coalesce(1).write.mode("overwrite").json(f"{folder}/split_summary")
    finally:
        split.unpersist()
