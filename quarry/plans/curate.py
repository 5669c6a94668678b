"""Whole jobs, from files to a split dataset and from predictions to scores; each is a function with the parameters of its step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators import evaluate, profile, qa, sft, split, validate
from ..sources import files, jsonl


def extract_documents(spark: SparkSession, input_dir: str, output: str, max_documents: int | None = None, readers: dict[str, files.Reader] | None = None) -> str:
    """Files under ``input_dir`` to a corpus in JSON lines, and its statistics beside it; returns the statistics.

    Rows are written once, with their errors; corpus and statistics read them back.
    """
    files.extracted(files.discovered(spark, input_dir, max_documents), readers).write.mode("overwrite").parquet(f"{output}.rows")
    rows = spark.read.parquet(f"{output}.rows")
    stamp = F.date_format("extracted_at", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    jsonl.write_jsonl(files.corpus_of(rows).withColumn("extracted_at", stamp), output)
    return jsonl.write_report(files.extraction_stats(rows), f"{output}.stats")


def inspect_corpus(spark: SparkSession, input: str, top: int = profile.TOP, min_text_length: int = profile.SHORT) -> dict[str, DataFrame]:
    """The report's parts: profile, frequencies and the first ``top`` suspicious documents by physical line."""
    lines = validate.numbered_lines(spark, input).where(~is_blank(F.col("value")))
    corpus = lines.select("line", F.from_json("value", jsonl.CORPUS, {"mode": "FAILFAST"}).alias("r")).select("line", "r.*")
    return {
        "profile": profile.corpus_profile(corpus, short=min_text_length),
        "extraction_methods": profile.frequency(corpus.fillna("unknown", ["extraction_method"]), "extraction_method"),
        "extensions": profile.frequency(corpus.fillna("unknown", ["extension"]), "extension"),
        "suspicious": profile.suspicious(corpus, "line", short=min_text_length, top=top).select("line", "document_id", "file_name", "extension", "length", "extraction_method"),
    }


def generate_qa_dataset(spark: SparkSession, input: str, output: str, generator: qa.Generator, resume: bool = False, max_documents: int | None = qa.MAX_DOCUMENTS, **options) -> str:
    """Pairs for the first ``max_documents`` documents; with ``resume`` appended to what is there."""
    corpus = validate.numbered_lines(spark, input).where(~is_blank(F.col("value")))
    corpus = corpus.select(F.col("line").alias("ord"), F.from_json("value", jsonl.CORPUS, {"mode": "FAILFAST"}).alias("r")).select("ord", "r.*")
    done = jsonl.read_jsonl(spark, output, jsonl.QA_RAW) if resume else None
    records, stats = qa.build_dataset(corpus, generator, done, most=max_documents, replies=f"{output}.replies", **options)
    jsonl.write_jsonl(records, output, append=resume)
    return jsonl.write_report(stats, f"{output}.stats")


def prepare_dataset(spark: SparkSession, input: str, output: str) -> int:
    return validate.validate_jsonl(spark, input, output)


def split_dataset(spark: SparkSession, input: str, output_dir: str, seed: int = split.SEED, train_ratio: float = split.TRAIN, validation_ratio: float = split.VALIDATION, max_documents: int | None = None) -> None:
    split.check_ratios(train_ratio, validation_ratio)
    lines = validate.numbered_lines(spark, input).where(~is_blank(F.col("value")))
    records = lines.select("line", F.from_json("value", jsonl.RECORD, {"mode": "FAILFAST"}).alias("r")).select("line", "r.*")
    split.check_ids(records, "line")
    split.write_splits(split.split_records(records.drop("line"), train_ratio, validation_ratio, seed, max_documents), output_dir)


def format_sft_dataset(spark: SparkSession, input: str, output: str, max_context_chars: int | None = 1800) -> int:
    out = sft.formatted(jsonl.read_jsonl(spark, input, jsonl.RECORD), max_context_chars)
    jsonl.write_jsonl(out, output)
    return jsonl.read_jsonl(spark, output, jsonl.SFT).count()


def generate_predictions(spark: SparkSession, input: str, output: str, predictor: sft.Predictor, base_model: str, adapter: str | None = None, max_new_tokens: int = sft.MAX_NEW_TOKENS, max_context_chars: int | None = 1800) -> None:
    rows = jsonl.read_jsonl(spark, input, jsonl.RECORD)
    jsonl.write_jsonl(sft.predicted(rows, predictor, base_model, adapter, max_context_chars, max_new_tokens), output)


def evaluate_generation(spark: SparkSession, predictions: str, output: str) -> str:
    """Scored rows under ``output``/examples and the summary under ``output``/summary, which is returned."""
    rows = evaluate.evaluated(jsonl.read_jsonl(spark, predictions, jsonl.PREDICTION))
    jsonl.write_jsonl(rows, f"{output}/examples")
    return jsonl.write_report(evaluate.evaluation_summary(rows), f"{output}/summary")
