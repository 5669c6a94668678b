"""Secret scan: fixed patterns plus sliding-window entropy (operator 5), JVM functions only.

Three pattern kinds give base spans, leftmost and non-overlapping per kind.
Candidate strings (runs over a character class) that the patterns leave over
are then tested by the Shannon entropy of a sliding window: counts per
character move along by one in and one out, and the sum of c*log2(c) is
updated from the two counts that change, so a step doesn't recount its window.
Windows at or above the class's threshold that touch join into a span, so what
lies between hot stretches of a candidate is no part of one.  Candidates that an
allow-list pattern fits (UUID-like ids, digests named by their algorithm, long
runs of one character, words without digits) are suppressed; base spans are not.

Offsets count code points; ends are exclusive.  A span is the whole match.

Defined results: null text is empty text, with no spans and the digest of "".
Spans of several kinds may overlap; an entropy span that lies within a base span
is left out.  Repeated rows each get their result; only named columns are read; an
empty table gives no rows.  Long texts and candidates are scanned whole, in time
proportional to their length; masking takes a pass over the text for each of its spans.
``scan`` puts its columns in place of any of the same names (those and ``_`` with
a kind's name); ``redacted`` keeps every column, whatever its name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folds import collected
from .common import let, table


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int  # the group whose length counts
    least: int


BASE = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # The least length stands in the pattern: a run's later starts are shorter, so matches are those of AKIA[A-Z0-9]+ and
    # [0-9a-f]+ that are long enough, without an entry for every letter a to f.
    Kind("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Kind("hex", r"[0-9a-f]{32,}", 0, 32),
)


@dataclass(frozen=True)
class EntropyClass:
    """Candidate strings over ``alphabet``, and the bits a window of ``window`` characters must reach."""

    name: str
    pattern: str
    alphabet: str
    window: int
    bits: float


#: Pairs of letters that words seldom hold, words joined to one another included.
ODD = r"(?i:[jqvz][bcdfghjklmnpqrstvwxz]|[bcdfghklmnprstvwxz][jqx]|q[^u]|b[gkpwz]|c[bdfgmnpvw]|d[kx]|f[bcdghkmnpvwz]|g[cdfkpvz]|h[bcdfgkpvz]|k[cdgpvz]|lx|m[gkrvwz]|p[dgkvwz]|w[cgjpqvxz]|x[bdfgjknrsvwz]|aa|ii|uu|yy|uo|iy|yu)"

CLASSES = (
    EntropyClass("entropy_hex", r"(?<![A-Za-z0-9])(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{32,}(?![A-Za-z0-9])", "0123456789ABCDEF", 24, 3.0),
    EntropyClass("entropy_base64", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9A-Z+/_-]*[a-z])(?=[0-9a-z+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=", 20, 3.55),
    EntropyClass("entropy_lower", r"(?<![A-Za-z0-9])(?=[a-z]*[0-9])(?=[0-9]*[a-z])[a-z0-9]{20,}(?![A-Za-z0-9])", "abcdefghijklmnopqrstuvwxyz0123456789", 20, 3.25),
    # Upper-case hex has its own class.
    EntropyClass("entropy_upper", r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9A-F]*[G-Z])[A-Z0-9]{20,}(?![A-Za-z0-9])", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20, 3.25),
    # Words joined have as much entropy as random letters, so a candidate must hold three odd pairs.
    EntropyClass("entropy_letters", rf"(?<![A-Za-z0-9])(?=(?>[A-Za-z]*?{ODD}){{3}})[A-Za-z]{{20,}}(?![A-Za-z0-9])", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 20, 3.1),
)

#: A path's segment: words with or without capitals, lone letters and numbers, or at most four characters.
_SEGMENT = r"(?:(?:(?:[A-Z][a-z]++|[a-z]{2,}+|[A-Z]{2,}+|[A-Za-z](?![A-Za-z])|[0-9]{1,8}+(?![A-Za-z]))[_-]?)++(?![A-Za-z0-9_-])|[A-Za-z0-9_-]{1,4}+(?![A-Za-z0-9_-]))"

ALLOW = (
    r"(?i)^(sha(1|224|256|384|512)|md5)-",
    r"(?i)example|placeholder|your[_-]?(key|token)|changeme",
    r"^(.)\1+$",
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    rf"^(?=.{{1,500}}$)(?=.*/)/{{0,2}}{_SEGMENT}(?:/{_SEGMENT})*/?$",
    # A name: words, then a number.
    r"^(?=.{1,100}$)(?:(?:[A-Z][a-z]++|[a-z]{3,}+|[A-Z]{3,}+)[_-]?)++[0-9]{1,8}$",
)


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, s) of the leftmost non-overlapping matches whose group has ``least`` characters or more."""
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["state"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        hit = F.array(F.struct(start.alias("start"), end.alias("end"), x["whole"].alias("s")))
        return F.struct(end.alias("state"), F.when(F.length(x["part"]) >= least, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), part.alias("part"))
    return F.when(text.rlike(pattern), collected(zipped, F.lit(0), none, step, lambda a: a["out"])).otherwise(none)


def _weight(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def hot_ranges(s: Column, cls: EntropyClass) -> Column:
    """Array of (from, to) offsets in ``s``: the windows whose entropy reaches ``cls.bits``, those that touch joined."""
    w, size = cls.window, len(cls.alphabet)
    # Entropy of a full window is log2(w) - sum(c log2 c) / w.
    most = w * (F.log2(F.lit(float(w))) - cls.bits)
    none = F.array().cast("array<struct<from:int,to:int>>")
    zero = F.struct(F.array_repeat(F.lit(0), size).alias("c"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("from"), F.lit(None).cast("int").alias("to"), none.alias("out"))
    open_ = lambda acc: F.array(F.struct(acc["from"].alias("from"), acc["to"].alias("to")))

    def moved(acc: Column, i: Column, x: Column) -> Column:
        """One step: character code ``new`` comes in, ``old`` (-1: none) goes out."""
        new, old = x["new"], x["old"]
        n_new, n_old = F.get(acc["c"], new), F.get(acc["c"], F.greatest(old, F.lit(0)))
        change = F.when(old == new, 0.0).otherwise(_weight(n_new + 1) - _weight(n_new) + F.when(old >= 0, _weight(n_old - 1) - _weight(n_old)).otherwise(0.0))
        counts = F.when(old == new, acc["c"]).otherwise(F.transform(acc["c"], lambda c, j: c + F.when(j == new, 1).when(j == old, -1).otherwise(0)))

        def ended(total: Column, hit: Column) -> Column:
            apart = hit & (acc["to"].isNull() | (i - w > acc["to"]))
            return F.struct(
                counts.alias("c"), total.alias("sum"), F.when(apart, i - w).otherwise(acc["from"]).alias("from"), F.when(hit, i).otherwise(acc["to"]).alias("to"),
                F.when(apart & acc["to"].isNotNull(), F.concat(acc["out"], open_(acc))).otherwise(acc["out"]).alias("out"),
            )

        return let(acc["sum"] + change, lambda total: let((i >= w) & (total <= most + 1e-9), lambda hit: ended(total, hit)))

    def over(codes: Column) -> Column:
        """``codes``: the characters' places in the alphabet, so that a step finds its two at once however long the candidate is."""

        def step(acc: Column, i: Column) -> Column:
            return let(F.struct(F.get(codes, i - 1).alias("new"), F.when(i > w, F.get(codes, i - 1 - w)).otherwise(F.lit(-1)).alias("old")), lambda x: moved(acc, i, x))

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step, lambda a: F.when(a["to"].isNull(), a["out"]).otherwise(F.concat(a["out"], open_(a))))

    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return let(F.transform(chars, lambda c: F.instr(F.lit(cls.alphabet), c) - 1), over)


def entropy_spans(text: Column, cls: EntropyClass, base: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    """Array of (start, end, s): candidates' hot ranges, without allowed candidates and without what ``base`` spans hold."""
    found = matches(text, cls.pattern, 0, cls.window)
    found = F.filter(found, lambda x: ~F.lit(False) if not allow else ~_any([x["s"].rlike(p) for p in allow]))
    found = F.filter(found, lambda x: ~F.exists(base, lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"])))
    part = lambda x, r: F.struct((x["start"] + r["from"]).alias("start"), (x["start"] + r["to"]).alias("end"), F.substring(x["s"], r["from"] + 1, r["to"] - r["from"]).alias("s"))
    spans = F.flatten(F.transform(found, lambda x: F.transform(hot_ranges(x["s"], cls), lambda r: part(x, r))))
    return F.filter(spans, lambda x: ~F.exists(base, lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"])))


def _any(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(df: DataFrame, text: str = "text", classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``df`` with ``base_spans`` and ``spans``: arrays of (start, rank, end, kind, s), sorted by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    names = {k.name: i for i, k in enumerate((*BASE, *classes))}

    def of(found: Column, name: str) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(names[name]).alias("rank"), x["end"].alias("end"), F.lit(name).alias("kind"), x["s"].alias("s")))

    # Columns by step, so that each pattern runs once over a text.
    df = df.withColumns({f"_{k.name}": matches(t, k.pattern, k.group, k.least) for k in BASE})
    df = df.withColumn("base_spans", F.array_sort(F.concat(*(of(F.col(f"_{k.name}"), k.name) for k in BASE))))
    df = df.withColumns({f"_{c.name}": entropy_spans(t, c, F.col("base_spans"), allow) for c in classes})
    df = df.withColumn("spans", F.array_sort(F.concat("base_spans", *(of(F.col(f"_{c.name}"), c.name) for c in classes))))
    return df.drop(*(f"_{k.name}" for k in (*BASE, *classes)))


def redacted(df: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of ``text`` (overlaps joined) replaced by ``mask``; null text stays null."""
    rest = [c for c in df.columns if c != text]
    # The other columns travel as one, so no name of theirs meets one of the scan's.
    out = scan(df.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row"), F.col(text).alias("_t")), "_t")
    t = F.col("_t")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = x["start"] >= a["at"]
        keep = F.concat(a["out"], F.substring(t, a["at"] + 1, x["start"] - a["at"]), F.lit(mask))
        # A span that begins within the last one only moves the end.
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(new, keep).otherwise(a["out"]).alias("out"))

    done = F.aggregate("spans", zero, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    masked = F.when(F.size("spans") > 0, done).otherwise(t)
    return out.select(*((masked if c == text else F.col("_row")[c]).alias(c) for c in df.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
