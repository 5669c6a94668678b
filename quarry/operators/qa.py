"""Question-answer pairs: parsing a generator's replies, grounding, first-accepted dedupe, resume, counters."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chunks import select_context, split_chunks
from ..functions.doctype import document_type
from ..functions.text import CONTEXT_CHARS, grounding, is_blank, normalize_question, rounded, stems, strip

MIN_GROUNDING = 0.6
MAX_CHARS = 24_000
MAX_DOCUMENTS = 500
QUESTIONS = 5

Generator = Callable[[str, int], str]

PAIRS = "array<struct<is_object:boolean,instruction:string,input:string,output:string>>"


def parse_reply(reply: str) -> list:
    """The JSON array in a model's reply: from its first opening to its last closing bracket, whatever fence or text is around."""
    found = re.search(r"\[.*\]", reply, re.DOTALL)
    if found is None:
        raise ValueError("the reply holds no JSON array")
    return json.loads(found[0])


def coerced(items: list) -> list[dict]:
    """Each item as strings, as ``str`` gives them; items that are no objects are marked.

    A null input is a missing one: as the word None it would be quoted from every text with these letters.
    """
    out = []
    for item in items:
        if isinstance(item, dict):
            fragment = item.get("input")
            out.append({"is_object": True, "input": "" if fragment is None else str(fragment)} | {k: str(item.get(k, "")) for k in ("instruction", "output")})
        else:
            out.append({"is_object": False, "instruction": None, "input": None, "output": None})
    return out


@F.udf(T.ArrayType(T.StructType([T.StructField("is_object", T.BooleanType()), *(T.StructField(c, T.StringType()) for c in ("instruction", "input", "output"))])))
def reply_pairs(reply):
    """A reply's pairs; null if it can't be parsed.  JSON of mixed types needs Python's coercion."""
    try:
        return coerced(parse_reply(reply)) if reply is not None else None
    except ValueError:
        return None


def first_documents(corpus: DataFrame, order: str, most: int | None = MAX_DOCUMENTS) -> DataFrame:
    """The first ``most`` documents in file order, before any other filter; 0 is none, None is all."""
    return corpus if most is None else corpus.orderBy(order).limit(most)


def remaining(corpus: DataFrame, done: DataFrame, key: str = "document_id") -> DataFrame:
    """Resume: documents without a row in the prior output."""
    return corpus.join(done.select(key).distinct(), key, "left_anti")


def generated(corpus: DataFrame, generator: Generator, questions: int = QUESTIONS, max_chars: int = MAX_CHARS, text: str = "text") -> DataFrame:
    """``corpus`` with ``raw`` (array of pairs; null where the generator or its reply failed) and ``failure``."""
    schema = corpus.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw, failure = [], []
            for t in pdf[text]:
                try:
                    raw.append(coerced(parse_reply(generator(t[:max_chars], questions))))
                    failure.append(None)
                except Exception as e:  # one document's failure doesn't end the run
                    raw.append(None)
                    failure.append(str(e))
            yield pdf.assign(raw=raw, failure=failure)

    return corpus.mapInPandas(run, f"{schema},raw:{PAIRS},failure:string")


def pairs_of(documents: DataFrame, text: str = "text", raw: str = "raw", path: str | None = None, size: int = CONTEXT_CHARS) -> DataFrame:
    """One row per pair with its position; what belongs to the document is computed before the pairs are."""
    t = strip(F.coalesce(F.col(text), F.lit("")))
    docs = documents.withColumn("_text", t).withColumns({
        "document_type": document_type(F.col("_text"), None if path is None else F.col(path)),
        "_norm": normalize_question(F.col("_text")),
        "_chunks": split_chunks(F.col("_text"), size),
    })
    rows = docs.select("document_id", "ord", "document_type", "_text", "_norm", "_chunks", F.posexplode(raw).alias("pos", "pair")).where("pair.is_object")
    return rows.withColumns({"instruction": strip(F.col("pair.instruction")), "output": strip(F.col("pair.output")), "fragment": F.col("pair.input")}).drop("pair")


def with_context(pairs: DataFrame, size: int = CONTEXT_CHARS) -> DataFrame:
    context = select_context(F.col("_text"), F.col("fragment"), F.col("instruction"), F.col("output"), size, F.col("_norm"), F.col("_chunks"))
    rows = pairs.withColumn("input", context)
    return rows.withColumn("score", grounding(stems(F.col("output")), stems(F.col("input"))))


def status(empty: Column, score: Column, pos: Column, scope: list[str], key: Column, least: float = MIN_GROUNDING) -> Column:
    """'empty', 'duplicate', 'ungrounded' or 'accepted', as a pass in order would decide.

    A key counts as seen from its first accepted pair on: before that pair all of
    its pairs are ungrounded, after it all are duplicates.
    """
    good = ~empty & (score >= least)
    first = F.min(F.when(good, pos)).over(Window.partitionBy(*scope, key))
    return F.when(empty, "empty").when(pos > first, "duplicate").when(~good, "ungrounded").otherwise("accepted")


def judged(pairs: DataFrame, scope: tuple[str, ...] = ("document_id", "ord"), least: float = MIN_GROUNDING) -> DataFrame:
    empty = is_blank(F.col("instruction")) | is_blank(F.col("output"))
    rows = pairs.withColumn("_key", normalize_question(F.col("instruction")))
    return rows.withColumn("status", status(empty, F.col("score"), F.col("pos"), list(scope), F.col("_key"), least))


def accepted(rows: DataFrame) -> DataFrame:
    """The dataset records, grounding rounded to 3 places."""
    return rows.where("status = 'accepted'").select("document_id", "document_type", "instruction", "input", "output", rounded(F.col("score"), 3).alias("grounding"))


def counters(rows: DataFrame) -> DataFrame:
    count = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    return rows.agg(count("accepted", "examples"), count("empty", "empty"), count("duplicate", "duplicates"), count("ungrounded", "ungrounded"))


def written_once(rows: DataFrame, path: str | None) -> DataFrame:
    """``rows`` from where they are written: ``path``, or a checkpoint in the session's ``spark.checkpoint.dir``; cached if neither is given."""
    spark = rows.sparkSession
    if path is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not folder:
            return rows.persist()
        path = f"{folder.rstrip('/')}/replies-{uuid.uuid4().hex}"
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def build_dataset(corpus: DataFrame, generator: Generator, done: DataFrame | None = None, most: int | None = MAX_DOCUMENTS, questions: int = QUESTIONS, max_chars: int = MAX_CHARS, size: int = CONTEXT_CHARS, least: float = MIN_GROUNDING, replies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, statistics) from a corpus (document_id, text, ord, ...).

    A generator may answer otherwise when asked again, so its replies are written
    once, to ``replies``, and both results read them from there.
    """
    chosen = first_documents(corpus, "ord", most)
    todo = chosen if done is None else remaining(chosen, done)
    full = todo.where(~is_blank(F.col("text"))).withColumn("text", strip(F.col("text")))
    raw = written_once(generated(full, generator, questions, max_chars), replies)
    path = "relative_path" if "relative_path" in corpus.columns else None
    rows = judged(with_context(pairs_of(raw.where("raw is not null"), path=path, size=size), size), least=least)
    seen = raw.agg(F.count_if(F.col("raw").isNotNull()).alias("documents"), F.count_if(F.col("raw").isNull()).alias("failed"))
    skipped = chosen.agg(F.count("*").alias("n")).crossJoin(todo.agg(F.count("*").alias("m"), F.count_if(is_blank(F.col("text"))).alias("skipped_empty")))
    skipped = skipped.select((F.col("n") - F.col("m")).alias("skipped_done"), "skipped_empty")
    return accepted(rows), seen.crossJoin(skipped).crossJoin(counters(rows))  # one row each
