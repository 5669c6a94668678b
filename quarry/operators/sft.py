"""Prompt and completion records for fine-tuning, the token budget, and predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CONTEXT_CHARS, WS, truncate_context

MAX_TOKENS = 1024
MAX_NEW_TOKENS = 256

# The prompt's texts.
SYSTEM_PROMPT = "Ты корпоративный AI-ассистент. Отвечай только на основании предоставленного контекста. Если контекста недостаточно, прямо укажи, что информации недостаточно."
CONTEXT_HEADING = "\n\nКонтекст документа:\n"

Predictor = Callable[[list[tuple[str, str]], int], str]


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_text(instruction: Column, context: Column, most: int | None = CONTEXT_CHARS) -> Column:
    cut = truncate_context(context, most)
    return F.when(cut == "", instruction).otherwise(F.concat(instruction, F.lit(CONTEXT_HEADING), cut))


def prompt(instruction: Column, context: Column, most: int | None = CONTEXT_CHARS, system: str = SYSTEM_PROMPT) -> Column:
    return F.array(_message("system", F.lit(system)), _message("user", user_text(instruction, context, most)))


def formatted(records: DataFrame, most: int | None = CONTEXT_CHARS, system: str = SYSTEM_PROMPT) -> DataFrame:
    """(document_id, document_type, prompt, completion); the answer is never cut."""
    kind = F.col("document_type") if "document_type" in records.columns else F.lit("unknown")
    return records.select("document_id", kind.alias("document_type"), prompt(F.col("instruction"), F.col("input"), most, system).alias("prompt"), F.array(_message("assistant", F.col("output"))).alias("completion"))


def words_of_messages(*messages: Column) -> Column:
    """A token count for tests and rough budgets: words split at whitespace."""
    text = F.array_join(F.flatten(F.array(*(F.transform(m, lambda x: x["content"]) for m in messages))), " ")
    return F.size(F.filter(F.split(text, f"[{WS}]+"), lambda w: w != ""))


def within_budget(examples: DataFrame, tokens: Column | None = None, most: int = MAX_TOKENS) -> DataFrame:
    """Examples of at most ``most`` tokens; ``tokens`` may be a pandas UDF over prompt and completion."""
    n = words_of_messages(F.col("prompt"), F.col("completion")) if tokens is None else tokens
    return examples.where(n <= most)


def budget_report(examples: DataFrame, tokens: Column | None = None, most: int = MAX_TOKENS) -> DataFrame:
    n = words_of_messages(F.col("prompt"), F.col("completion")) if tokens is None else tokens
    return examples.agg(F.count("*").alias("before"), F.count_if(n <= most).alias("kept"), F.count_if(n > most).alias("dropped"))


def filter_by_length(examples: DataFrame, tokens: Column | None = None, most: int = MAX_TOKENS) -> DataFrame:
    """``within_budget``, but an error if nothing remains."""
    kept = within_budget(examples, tokens, most)
    if kept.isEmpty():
        raise RuntimeError(f"no example has {most} tokens or fewer")
    return kept


def model_label(adapter: Column, base: Column) -> Column:
    return F.coalesce(F.nullif(adapter, F.lit("")), F.concat(F.lit("base:"), base))


def predicted(records: DataFrame, predictor: Predictor, base_model: str, adapter: str | None = None, most: int | None = CONTEXT_CHARS, new_tokens: int = MAX_NEW_TOKENS) -> DataFrame:
    """(document_id, model, instruction, reference, prediction) by an injected predictor over the training prompt."""
    model = adapter or f"base:{base_model}"
    rows = records.select(F.col("document_id").cast("string").alias("document_id"), "instruction", F.col("output").alias("reference"), prompt(F.col("instruction"), F.col("input"), most).alias("prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = [predictor([(m["role"], m["content"]) for m in messages], new_tokens) for messages in pdf["prompt"]]
            yield pdf.drop(columns="prompt").assign(model=model, prediction=said)

    return rows.mapInPandas(run, "document_id string, instruction string, reference string, model string, prediction string").select("document_id", "model", "instruction", "reference", "prediction")
