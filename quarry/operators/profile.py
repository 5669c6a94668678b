"""Corpus profile: counts, rates, length statistics, frequencies and suspicious documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rounded, strip

SHORT = 100
TOP = 20


def with_text(corpus: DataFrame, text: str = "text") -> DataFrame:
    """A missing text counts as '', so it is empty and short."""
    return corpus.withColumn(text, F.coalesce(F.col(text), F.lit("")))


def nearest_rank(lengths: DataFrame, shares: tuple[float, ...], n: str = "n") -> DataFrame:
    """(share, value) at index round-half-even((count - 1) * share), by cumulative counts of the distinct values.

    Only distinct values are ordered, so the window holds as many rows as
    there are different lengths.
    """
    from pyspark.sql import Window

    counts = lengths.groupBy(n).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy(n))
    ranked = counts.withColumns({"upto": upto, "total": F.sum("c").over(Window.partitionBy())})
    wanted = ranked.select(n, "upto", "c", "total", F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share"))
    at = F.rint((F.col("total") - 1) * F.col("share")).cast("long")
    return wanted.where((at < F.col("upto")) & (at >= F.col("upto") - F.col("c"))).select("share", F.col(n).alias("value"))


def length_percentiles(corpus: DataFrame, text: str = "text", shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    return nearest_rank(with_text(corpus, text).select(F.length(text).cast("long").alias("n")), shares)


def corpus_profile(corpus: DataFrame, text: str = "text", short: int = SHORT) -> DataFrame:
    """One row: totals, rates to 4 places, length statistics; zeros for an empty corpus.

    One pass counts the documents of each length; all else follows from these counts.
    """
    from pyspark.sql import Window

    rows = with_text(corpus, text).select(F.length(text).cast("long").alias("n"), (strip(F.col(text)) == "").alias("blank"))
    counts = rows.groupBy("n").agg(F.count("*").alias("c"), F.count_if("blank").alias("b"))
    counts = counts.withColumns({"upto": F.sum("c").over(Window.orderBy("n")), "total": F.sum("c").over(Window.partitionBy())})

    def at(share: float):
        place = F.rint((F.col("total") - 1) * share).cast("long")
        return F.coalesce(F.max(F.when((place < F.col("upto")) & (place >= F.col("upto") - F.col("c")), F.col("n"))), F.lit(0))

    sum_ = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    stats = counts.agg(
        sum_(F.col("c")).alias("total_documents"),
        sum_(F.col("b")).alias("empty_documents"),
        sum_(F.when(F.col("n") < short, F.col("c"))).alias("short_documents"),
        F.coalesce(F.min("n"), F.lit(0)).alias("min_length"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_length"),
        F.coalesce(rounded(F.try_divide(F.sum(F.col("n") * F.col("c")), F.sum("c")), 1), F.lit(0.0)).alias("mean_length"),
        at(0.5).alias("p50_length"), at(0.9).alias("p90_length"), at(0.99).alias("p99_length"),
    )
    # A rate of no documents is 0.
    rate = lambda c: F.when(F.col("total_documents") > 0, rounded(F.try_divide(F.col(c), F.col("total_documents")), 4)).otherwise(F.lit(0.0))
    return stats.withColumns({"short_threshold": F.lit(short), "empty_rate": rate("empty_documents"), "short_rate": rate("short_documents")})


def frequency(corpus: DataFrame, column: str) -> DataFrame:
    """How often each value occurs; a missing column counts as 'unknown', a null stays null."""
    value = F.col(column) if column in corpus.columns else F.lit("unknown")
    return corpus.groupBy(value.alias(column)).agg(F.count("*").alias("documents"))


def suspicious(corpus: DataFrame, order: str, text: str = "text", short: int = SHORT, top: int = TOP) -> DataFrame:
    """The first ``top`` short documents in file order: the report's limit."""
    rows = with_text(corpus, text).withColumn("length", F.length(text).cast("long"))
    return rows.where(F.col("length") < short).orderBy(order).limit(top)


def exact_duplicates(corpus: DataFrame, text: str = "text") -> DataFrame:
    """(content_id, documents) of contents that occur more than once."""
    return corpus.groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("content_id")).agg(F.count("*").alias("documents")).where("documents > 1")
