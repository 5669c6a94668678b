"""Incremental dataset building: new corpus files as a stream, finished documents left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import qa
from ..sources import jsonl


def start(spark: SparkSession, source: str, target: str, checkpoint: str, generator: qa.Generator, **options) -> StreamingQuery:
    """Generate pairs for the documents of new JSON-lines files under ``source``; records go to ``target``, a folder per micro-batch.

    Each micro-batch leaves out documents that batches before it have records of;
    their ids are kept beside the records, so that no text is read again.  A
    batch that is run again after a failure writes its own folders anew.
    """
    docs = spark.readStream.schema(jsonl.CORPUS).json(source)
    ids = f"{target}.done"

    def add(batch: DataFrame, no: int) -> None:
        batch = batch.withColumn("ord", F.xxhash64("document_id", "relative_path"))
        before = None
        if no:
            before = spark.read.schema("document_id string, batch long").parquet(ids).where(F.col("batch") < no)
        records, _stats = qa.build_dataset(batch, generator, before, most=None, replies=f"{target}.replies/batch={no}", **options)
        jsonl.write_jsonl(records, f"{target}/batch={no}")
        spark.read.schema("document_id string").json(f"{target}/batch={no}").distinct().write.mode("overwrite").parquet(f"{ids}/batch={no}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
