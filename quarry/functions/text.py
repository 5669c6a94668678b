"""Text functions as Column expressions: cleaning, two normal forms, stems, overlaps, truncation, rounding.

Whitespace and word characters are spelt out, because the JVM's classes differ
from what the results are defined by: WS is every Unicode space, WORD every
letter, number or underscore.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"a-z0-9_A-Z\p{L}\p{N}"
#: WS as a set of characters, for the trim functions: a pattern like ``[WS]+$`` takes quadratic time.
SPACES = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

STEM_LETTERS = 5
LEAST_WORD = 4
CONTEXT_CHARS = 1800


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    """Null, empty or only whitespace."""
    return strip(F.coalesce(c, F.lit(""))) == ""


def clean_text(c: Column) -> Column:
    """NUL to space, runs of spaces and tabs to one space, three or more line ends to two, stripped; in this order."""
    c = F.regexp_replace(c, r"\x00", " ")
    c = F.regexp_replace(c, "[ \t]+", " ")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def _lower(c: Column) -> Column:
    return F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ё"), F.lit("е"))


def normalize_question(c: Column) -> Column:
    """Lower case, ё as е, other marks as spaces, single spaces; null as ''."""
    return F.trim(F.regexp_replace(_lower(c), f"[^{WORD}]+", " "))


def normalize_answer(c: Column) -> Column:
    """Lower case, stripped, single spaces, then marks deleted: what they leave is neither stripped nor joined again."""
    c = F.regexp_replace(strip(F.lower(c)), f"[{WS}]+", " ")
    return F.regexp_replace(c, f"[^{WORD}{WS}]", "")


def stems(c: Column) -> Column:
    """Distinct beginnings of the words of four letters or more of the normal form."""
    # A match takes the first letters as its group and the rest of the word with it.
    return F.array_distinct(F.regexp_extract_all(_lower(c), F.lit(f"([{WORD}]{{{LEAST_WORD},{STEM_LETTERS}}})[{WORD}]*+"), F.lit(1)))


def token_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_answer(c), " "), lambda w: w != ""))


def grounding(answer_stems: Column, context_stems: Column) -> Column:
    """Share of the answer's stems that the context has; 1 for an answer without stems."""
    return F.when(F.size(answer_stems) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(answer_stems, context_stems)) / F.size(answer_stems))


def token_recall(prediction: Column, reference: Column) -> Column:
    """Share of the reference's tokens that the prediction has; 0 for a reference without tokens."""
    r = token_set(reference)
    return F.when(F.size(r) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(token_set(prediction), r)) / F.size(r))


def exact_match(prediction: Column, reference: Column) -> Column:
    return normalize_answer(prediction) == normalize_answer(reference)


def rounded(c: Column, places: int) -> Column:
    """Half-even on the exact binary value."""
    return F.call_function("format_number", c.cast("double"), F.lit("0." + "0" * places if places else "0")).cast("double")


def truncate_context(c: Column, most: int | None = CONTEXT_CHARS) -> Column:
    """Stripped; over ``most`` characters it is cut, at the last space if that lies in the last fifth, and gets ' …'."""
    c = strip(F.coalesce(c, F.lit("")))
    if most is None:
        return c
    cut = F.substring(c, 1, most)
    # The last space's index from 0; -1 if there is none.
    space = F.length(cut) - F.instr(F.reverse(cut), " ")
    space = F.when(F.instr(cut, " ") > 0, space).otherwise(F.lit(-1))
    cut = F.when(space > 0.8 * most, F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(cut, F.lit(SPACES)), F.lit(" …")))
