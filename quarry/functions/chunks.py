"""Chunks of a text's paragraphs, and the choice of a context for a question and answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import collected
from .text import CONTEXT_CHARS, WS, normalize_question, stems, strip


def split_chunks(text: Column, size: int = CONTEXT_CHARS) -> Column:
    """Paragraphs packed greedily into chunks of at most ``size`` characters, joined by line ends.

    Longer paragraphs are first cut into pieces of ``size``; a full piece can't
    take another, so it stays a chunk of its own.
    """
    paragraphs = F.filter(F.transform(F.split(text, f"\n[{WS}]*\n|\n"), strip), lambda p: p != "")
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(1), F.length(p), F.lit(size)), lambda i: F.substring(p, i, F.lit(size)))))
    none = F.array().cast("array<string>")

    def pack(a: Column, p: Column) -> Column:
        fits = F.length(a["state"]) + 1 + F.length(p) <= size
        empty = a["state"] == ""
        return F.struct(
            F.when(empty, p).when(fits, F.concat(a["state"], F.lit("\n"), p)).otherwise(p).alias("state"),
            F.when(empty | fits, a["out"]).otherwise(F.concat(a["out"], F.array(a["state"]))).alias("out"),
        )

    return collected(pieces, F.lit(""), none, pack, lambda a: F.when(a["state"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["state"]))))


def select_context(text: Column, fragment: Column, question: Column, answer: Column, size: int = CONTEXT_CHARS, text_norm: Column | None = None, chunks: Column | None = None) -> Column:
    """The fragment if the text has it and it fits; else the text if it fits; else the chunk that shares most stems with question and answer, the first of equals.

    ``text_norm`` and ``chunks``: the text's normal form and chunks where they have
    been computed once per document, before its pairs.
    """
    fragment = strip(F.coalesce(fragment, F.lit("")))
    norm = normalize_question(text) if text_norm is None else text_norm
    whole = (fragment != "") & (F.length(fragment) <= size) & F.contains(norm, normalize_question(fragment))
    target = F.array_union(stems(question), stems(answer))
    pieces = split_chunks(text, size) if chunks is None else chunks
    ranked = F.transform(pieces, lambda c, i: F.struct(F.size(F.array_intersect(target, stems(c))).alias("score"), (-i).alias("turn"), c.alias("chunk")))
    return F.when(whole, fragment).when(F.length(text) <= size, text).otherwise(F.array_max(ranked)["chunk"])
