"""URL filter by redirect equivalence (operator 1).

Block and allow rules (host with subdomains, path prefix; the longest rule
wins) judge a URL.  URLs that redirect or canonical links join are aliases:
distributed connected components over those edges carry decisions to aliases
that no rule fits.  Precedence within a component: a URL's own rule; else
allow, if any URL of the component has an allow rule; else block, if any has a
block rule; else allow.

Edges come from ``<link rel=canonical href=...>``, canonical being any of its rel
values, and ``<meta http-equiv=refresh content="0; url=...">`` in the HTML, from any part of it,
and from an optional redirect table.  Targets are resolved against the page's URL or
its ``<base href>``, relative paths and their dot segments included; those that
name the page itself or another scheme than one with a host are no edge.

Defined results: a null URL or one without ``://`` has empty host and path,
fits no rule, joins no component and is allowed.  Repeated rows each get
their verdict.  Empty tables give empty results.  Very long pages are searched
whole.  Rules of one length that fit alike: allow first, then by name.  Only the named columns are
read, so extra or clashing columns do no harm.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, connected_components, let, table, written


@dataclass(frozen=True)
class Rule:
    action: str  # "allow" or "block"
    host: str  # lower-case; fits the host itself and all subdomains
    path: str  # prefix; starts with "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

#: Beyond so many rules they are joined by host suffix, not written into one expression.
INLINE_RULES = 200


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """A URL as a node: scheme and host lower-cased, fragment and an empty path's slash evened out; null if it has no host."""
    scheme = ascii_lower(F.regexp_extract(url, r"(?s)^\s*(.*?)://", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when((rest == "") | rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host_of(url), rest))


def unescaped(c: Column) -> Column:
    """HTML's escapes of ASCII marks, by number and by name, ``&amp;`` last."""
    for mark in string.punctuation.replace("&", "") + "&":
        named = {'"': "|quot", "'": "|apos", "<": "|lt", ">": "|gt", "&": "|amp"}.get(mark, "")
        c = F.regexp_replace(c, f"(?i)&(?:#0*{ord(mark)}|#x0*{ord(mark):x}{named});", "\\$" if mark == "$" else "\\\\" if mark == "\\" else mark)
    return c


def without_dots(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    pop = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), lambda a, x: F.when(x == "..", pop(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    tail = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), tail)).otherwise(path)


def resolved(base: Column, target: Column) -> Column:
    """``target`` as an absolute URL, seen from ``base``; null if that names no host or the base itself."""

    def from_(x: Column) -> Column:
        base, target = x["base"], x["target"]
        root = F.concat(F.regexp_extract(base, r"(?s)^\s*(.*?)://", 1), F.lit("://"), host_of(base))
        path, query = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(\?[^#]*)", 1)
        folder = F.regexp_extract(F.concat(F.lit("/"), path_of(base)), r"(?s)^/(.*/|)", 1)
        whole = F.when(path == "", path_of(base)).when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path))
        joined = F.concat(root, let(whole, lambda p: F.when(path == "", p).otherwise(without_dots(p))), query)
        return (
            F.when((target == "") | target.startswith("#") | (host_of(base) == ""), F.lit(None).cast("string"))
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^\s*(.*?:)//", 1), target))
            .otherwise(joined)
        )

    return let(F.struct(base.alias("base"), F.trim(unescaped(target)).alias("target")), from_)


def matched(df: DataFrame, host: str, path: str, rules: tuple[Rule, ...]) -> DataFrame:
    """``df`` with ``rule`` and ``action`` of the longest rule that fits (ties: allow, then by name)."""
    order = sorted(set(rules), key=lambda r: (-len(r.name), r.action, r.name, r.host))
    if len(order) <= INLINE_RULES:
        rule = action = None
        for r in order:
            fits = ((F.col(host) == r.host) | F.col(host).endswith("." + r.host)) & F.col(path).startswith(r.path)
            rule = F.when(fits, r.name) if rule is None else rule.when(fits, r.name)
            action = F.when(fits, r.action) if action is None else action.when(fits, r.action)
        none = F.lit(None).cast("string")
        return df.withColumns({"rule": none if rule is None else rule, "action": none if action is None else action})
    spark = df.sparkSession
    listed = spark.createDataFrame([(i, r.name, r.action, r.host, r.path) for i, r in enumerate(order)], "rank int, rule string, action string, r_host string, r_path string")
    pairs = df.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    labels = F.split(F.col("h"), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    best = pairs.select("h", "p", F.explode(ends).alias("r_host")).join(listed, "r_host").where(F.col("p").startswith(F.col("r_path")))
    best = best.groupBy("h", "p").agg(F.min(F.struct("rank", "rule", "action")).alias("best"))
    return df.join(best, (df[host] == best.h) & (df[path] == best.p), "left").withColumns({"rule": F.col("best.rule"), "action": F.col("best.action")}).drop("h", "p", "best")


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): URLs and what their HTML names as canonical or refreshes to."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?i)<(?:link|meta)\b[^<>]*>"), F.lit(0))
    canonical = r"""(?i)^<link\b.*\brel\s*=\s*(?:"[^"]*\bcanonical\b[^"]*"|'[^']*\bcanonical\b[^']*'|canonical\b)"""
    tags = F.filter(tags, lambda t: t.rlike("(?s)" + canonical) | t.rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?\s*refresh\b"""))
    own = F.regexp_extract(F.col(html), r"""(?i)<base\b[^<>]*\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1)
    found = pages.where(F.col(html).rlike(r"(?i)canonical|http-equiv")).select(F.col(url).alias("src"), own.alias("base"), F.explode(tags).alias("tag"))
    href = F.regexp_extract("tag", r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1)
    fresh = F.regexp_extract("tag", r"""(?i)\bcontent\s*=\s*["']?\s*[0-9.]+\s*[;,]\s*url\s*=\s*["']?([^"'\s>]+)""", 1)
    to = F.when(F.col("tag").rlike(r"(?i)^<link"), href).otherwise(fresh)
    found = found.select("src", F.coalesce(F.when(F.col("base") != "", resolved(F.col("src"), F.col("base"))), F.col("src")).alias("base"), to.alias("to"))
    return found.select("src", resolved(F.col("base"), F.col("to")).alias("dst")).where("dst is not null and src is not null")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, host, path, rule, verdict, propagated) for every row of ``pages``.

    ``redirects`` (src, dst): further edges, as an HTTP crawl log has them.
    """
    edges = link_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst"))
    edges = written(edges.select(alias_key(F.col("src")).alias("a"), alias_key(F.col("dst")).alias("b")).where("a <> b").distinct(), "links")
    own = matched(pages.select(F.col(key).alias("_id"), F.col(url).alias("_url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")), "host", "path", rules)
    if edges.isEmpty():
        out = own.withColumn("told", F.lit(None).cast("string"))
    else:
        parts = connected_components(edges)
        nodes = matched(parts.select("node", "component", host_of(F.col("node")).alias("h0"), path_of(F.col("node")).alias("p0")), "h0", "p0", rules)
        # Allow before block: the least of the two words.
        told = nodes.groupBy("component").agg(F.min("action").alias("told")).where("told is not null")
        told = nodes.select("node", "component").join(told, "component").select("node", "told")
        # URLs that are no node get keys of their own, so that they don't come together.
        node = F.coalesce(alias_key(F.col("_url")), F.concat(F.lit("#"), F.xxhash64("_id", "_url").cast("string")))
        out = own.withColumn("node", node).join(told, "node", "left")
    return out.select(
        F.col("_id").alias(key), "host", "path", "rule",
        F.coalesce("action", "told", F.lit("allow")).alias("verdict"),
        (F.col("action").isNull() & F.col("told").isNotNull()).alias("propagated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


#: Holds where no page names a canonical or refresh target (the driver's tables have none): SQL has no components here.
SQL = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(action, host, path) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/')),
m AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.action,
         row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.host || r.path) DESC) AS rn
  FROM u JOIN r ON (u.host = r.host OR u.host LIKE '%.' || r.host) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.action, 'allow') AS verdict, false AS propagated
FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.host = u.host AND m.path = u.path AND m.rn = 1
"""
