"""JSON lines: scan and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "document_id string, file_name string, relative_path string, extension string, extraction_method string, text string, text_length long, units int, sha256 string, extracted_at string"
RECORD = "document_id string, document_type string, instruction string, input string, output string"
QA_RAW = RECORD + ", grounding double"
PREDICTION = "document_id string, model string, instruction string, reference string, prediction string"
_MESSAGES = "array<struct<role:string,content:string>>"
SFT = f"document_id string, document_type string, prompt {_MESSAGES}, completion {_MESSAGES}"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a declared schema; blank lines are skipped, a malformed one raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Only what training reads: the scan parses these two columns."""
    return read_jsonl(spark, path, f"prompt {_MESSAGES}, completion {_MESSAGES}").select("prompt", "completion")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One object per row, nulls kept; each write is atomic by job."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_report(df: DataFrame, path: str) -> str:
    """A one-row report as one JSON object; also returned, for printing."""
    row = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    row.coalesce(1).write.mode("overwrite").text(path)
    return row.first()["value"]
