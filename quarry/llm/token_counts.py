"""Token counts by offset-mapped attribution (operator 2).

A document is encoded once, as a whole.  Its tokens' spans come from the byte
lengths of the tokens (byte-level BPE loses no byte); its sections' spans tile
or pick parts of it; both are sorted, so joining them is a search of section
bounds in token offsets.  A token across a boundary is allocated by ``rule``:

  first   to the section that holds its first byte (default),
  last    to the section that holds its last byte,
  most    to the section that holds most of its bytes, ties to the first.

So where sections tile the text every token counts exactly once, and bytes
outside all sections count nowhere.

Sections are the text's lines, each with its line end, or spans given by a
column: array of struct(name, start, end) in code points, sorted, not overlapping.

Defined results: null or empty text has no tokens and no sections; an empty line
is a section; repeated rows each get their counts; other columns aren't read.
An empty table gives no rows.  Texts without any boundary are encoded like
others, with memory by their length; so are long runs of white space, which
the splitting pattern's engine can't hold: such a run is a piece of its own but
for its last character, which the pattern leaves to what follows.
The vocabulary's path is a parameter and must exist on every worker.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text before merging, as the public 50k byte-level vocabulary was made.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern has it, in runs that are taken out of its hands.
LONG_RUN = 10_000
SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
RULES = ("first", "last", "most")


@cache
def encoder(path: str):
    """The encoding of a ``.tiktoken`` file and the byte length of every token."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def token_ids(encoding, text: str, long_run: int = LONG_RUN) -> list[int]:
    """The tokens of a whole text: what ``encode_ordinary`` gives, for texts of any make."""
    out, at = [], 0
    for run in re.finditer(SPACES + "{%d,}" % long_run, text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += encoding.encode_ordinary(text[at : run.start()])
        out += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:])


def token_spans(text: str, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of a text's tokens."""
    encoding, sizes = encoder(path)
    end = np.cumsum(sizes[np.asarray(token_ids(encoding, text), np.int64)])
    return np.concatenate(([0], end[:-1])) if len(end) else end, end


def line_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of lines, each with its line end."""
    cut = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    bounds = np.concatenate(([0], cut, [len(data)] if not len(cut) or cut[-1] < len(data) else [])).astype(np.int64)
    return bounds[:-1], bounds[1:]


def attributed(start: np.ndarray, end: np.ndarray, s_start: np.ndarray, s_end: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a section's bound; spans sorted, sections disjoint."""
    if not len(s_start) or not len(start):
        return np.zeros(len(s_start), np.int64), 0
    first = np.searchsorted(s_end, start, side="right")  # the first section that ends after the token's start
    last = np.searchsorted(s_start, end - 1, side="right") - 1  # the last that starts before its end
    inside = lambda bounds: np.searchsorted(bounds, end, side="left") > np.searchsorted(bounds, start, side="right")
    crossing = inside(s_start) | inside(s_end)
    holds = lambda k, at: (k >= 0) & (k < len(s_start)) & (s_start[np.clip(k, 0, len(s_start) - 1)] <= at) & (at < s_end[np.clip(k, 0, len(s_start) - 1)])
    if rule == "first":
        to = np.where(holds(first, start), first, -1)
    elif rule == "last":
        to = np.where(holds(last, end - 1), last, -1)
    elif rule == "most":
        to, best = np.full(len(start), -1), np.zeros(len(start), np.int64)
        span = int((last - first).max()) if len(first) else 0
        for d in range(max(0, span) + 1):
            k = first + d
            ok = (k <= last) & (k < len(s_start))
            j = np.clip(k, 0, len(s_start) - 1)
            size = np.where(ok, np.minimum(end, s_end[j]) - np.maximum(start, s_start[j]), 0)
            more = size > best
            to, best = np.where(more, k, to), np.where(more, size, best)
    else:
        raise ValueError(f"rule must be one of {RULES}")
    return np.bincount(to[to >= 0], minlength=len(s_start)), int(crossing.sum())


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_bytes, n_tokens, n_crossing, sections) per row; sections: array of (name, tokens) in order."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    given = F.lit(None).cast("array<struct<name:string,start:long,end:long>>") if sections is None else F.col(sections).cast("array<struct<name:string,start:long,end:long>>")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), given.alias("given"))
    item = pa.list_(pa.struct([("name", pa.string()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                sizes, tokens, crossing, out = [], [], [], []
                for t, g in zip(part.column("text"), part.column("given"), strict=True):
                    t = t.as_py() or ""
                    data = t.encode()
                    start, end = token_spans(t, vocabulary)
                    if sections is None:
                        s_start, s_end = line_spans(data) if data else (np.empty(0, np.int64), np.empty(0, np.int64))
                        names = None
                    else:
                        spans = [x for x in g.as_py() or [] if x]
                        # Code points to bytes: where characters begin.
                        begins = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
                        place = lambda c: begins[np.clip(np.asarray(c, np.int64), 0, len(begins) - 1)]  # noqa: E731, B023
                        s_start, s_end = place([x["start"] for x in spans]), place([x["end"] for x in spans])
                        names = [x["name"] for x in spans]
                        if (s_start[1:] < s_end[:-1]).any():
                            raise ValueError("sections must be sorted and must not overlap")
                    n, across = attributed(start, end, s_start, s_end, rule)
                    sizes.append(len(data))
                    tokens.append(len(start))
                    crossing.append(across)
                    out.append([{"name": names[i] if names else None, "tokens": x} for i, x in enumerate(n.tolist())])
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(crossing, pa.int64()), pa.array(out, item)], ["key", "n_bytes", "n_tokens", "n_crossing", "sections"])

    return rows.mapInArrow(run, "key long, n_bytes long, n_tokens long, n_crossing long, sections array<struct<name:string,tokens:long>>").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_tokens", "n_crossing", F.col("sections.tokens").alias("line_tokens"))
