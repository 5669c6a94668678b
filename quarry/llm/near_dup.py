"""Near-duplicate documents by MinHash with sequential Bayesian verification (operator 8).

1. A text's set holds its k-word shingles (A-Z lower-cased, split at ASCII
   space) as 64-bit hashes.  Documents with equal sets form a class and count as
   one from here on, so copies never meet each other.
2. Each class has ``BANDS * ROWS`` MinHash values of 16 bits.  Classes with an
   equal band are candidates.  Texts are read once more for classes that have
   candidates; their sets are written, and only sets travel from then on.
3. Round one compares each bucket's members with its least member only: as many
   pairs as members.  Confirmed links give connected components.
4. Round two compares what a bucket still holds of different components.  All
   members outside its largest component, in blocks of about ``BLOCK``, meet all
   its members, in parts of about ``PART``: so as many rows as members where few
   are outside.  Blocks and parts are bounded by the bytes of their sets too.
   Signatures alone go to all of these groups, and a pair counts in its first
   common band only; sets go only where a signature leaves a pair open.  A group
   confirms its likeliest pairs first and skips those that its links so far
   join.  So every candidate pair is either compared or already in one component,
   and no group emits all its pairs.
5. A comparison reads the signatures in batches.  With m of n values equal, the
   posterior of the similarity is Beta(m + 1, n - m + 1); the pair is dropped once
   the chance that it reaches the threshold is under ``MISS``.  Survivors are
   confirmed on their full sets.  A class with many partners goes, salted, to
   groups of about ``PARTNERS``, and partners stream past it one at a time.

At similarity 0.8 a pair shares no band with a chance of (1 - 0.8 ** 6) ** 32 =
6e-5; each of the six batches drops it with a chance of about 1e-6.

Defined results: null text, empty text and text without words have empty sets,
are linked with nothing and are their own component.  Rows with a null doc_id
take no part: their component_id is null and they are kept.  Repeated rows
share their class.  Very long texts are sets like others; two are in
memory at a time, or what a group holds.  Only doc_id and the text are read,
so other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import connected_components, forget, table, written

BANDS, ROWS = 32, 6
BATCH = 32
MISS = 1e-6
BLOCK, PART = 256, 1024
GROUP_BYTES = 8 << 20
#: Partners of one class per verification group.
PARTNERS = 256
SHINGLE = 4
NEAR = (80, 100)  # linked if 100 * intersection >= 80 * union


@cache
def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return (rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)), rng.integers(0, 1 << 32, n, np.uint32)


def signature(s: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """n MinHash values of a set, 16 bits each."""
    a, b = _coefficients(n)
    x = (words.mixed(s) >> np.uint64(32)).astype(np.uint32)
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        hashed = x[i : i + 256, None] * a
        hashed += b
        np.minimum(low, hashed.min(0), out=low)
    low ^= low >> np.uint32(16)
    return (low * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.uint16)


def fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


@cache
def least_equal(near: tuple[int, int] = NEAR, n: int = BANDS * ROWS, batch: int = BATCH, miss: float = MISS) -> dict[int, int]:
    """For each number of values compared, the least count of equal ones at which the posterior chance of a link is ``miss`` or more.

    P(J >= t | m of n equal) under a uniform prior is P(Bin(n + 1, t) <= m).
    """
    t = near[0] / near[1]
    out = {}
    for k in range(batch, n + 1, batch):
        total = 0.0
        for m in range(k + 2):
            total += comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
            if total >= miss:
                out[k] = m
                break
    return out


def plausible(a: np.ndarray, b: np.ndarray, near: tuple[int, int] = NEAR) -> np.ndarray:
    """Which rows of the signature arrays survive, batch by batch."""
    alive = np.arange(len(a))
    equal = np.zeros(len(a), np.int32)
    done = 0
    for k, least in least_equal(near, a.shape[1]).items():
        equal[alive] += (a[alive, done:k] == b[alive, done:k]).sum(1, dtype=np.int32)
        alive = alive[equal[alive] >= least]
        done = k
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _sig(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _long(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def near_sets(a: np.ndarray, b: np.ndarray, near: tuple[int, int]) -> bool:
    if near[1] * min(len(a), len(b)) < near[0] * max(len(a), len(b)):
        return False
    both = words.overlap(a, b)
    return near[1] * both >= near[0] * (len(a) + len(b) - both)


def fold(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, h, n_shingles, fp, sig) per row: h is the text's own hash; fp and sig are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                n, fp, sig = [], [], []
                for t in part.column("text").cast(pa.binary()):
                    s = words.shingles(t.as_py(), k)
                    n.append(len(s))
                    fp.append(fingerprint(s) if len(s) else None)
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "h", "n_shingles", "fp", "sig"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "doc_id long, h long, n_shingles long, fp binary, sig binary")


def sets_of(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(node, x): the sets of ``members`` (node, rep, fp), from the texts of their least documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, x, held = [], [], 0
            for n, fp, t in zip(b.column("node"), b.column("fp"), b.column("text").cast(pa.binary()), strict=True):
                s = words.shingles(t.as_py(), k)
                if fingerprint(s) == fp.as_py():  # else another row that has the same doc_id
                    node.append(n.as_py())
                    x.append(s.tobytes())
                    held += len(x[-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(x, pa.binary())], ["node", "x"])
                    node, x, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(x, pa.binary())], ["node", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    return members.join(texts, "rep").select("node", "fp", "text").mapInArrow(run, "node long, x binary")


GROUP = ("a", "parts", "salt")


def streamed(pairs: DataFrame, payload: DataFrame, run: Callable) -> DataFrame:
    """``run`` over batches in which each group's lead (turn 0) comes before its partners (turn 1), with their payloads.

    ``pairs`` (a, parts, salt, node): the lead travels once to each of its groups, the
    partners to theirs, so no class's pairs come together in one task.
    """
    lead = pairs.select(*GROUP).distinct().select(*GROUP, F.col("a").alias("node"), F.lit(0).alias("turn"))
    rows = lead.unionAll(pairs.select(*GROUP, "node", F.lit(1).alias("turn"))).join(payload, "node").select(*GROUP, "turn", "node", "x")
    rows = rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "turn", "node")
    return rows.mapInArrow(run, "a long, parts long, salt long, node long")


def compared(pairs: DataFrame, classes: DataFrame, near: tuple[int, int]) -> DataFrame:
    """The ``pairs`` that their signatures don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None  # the signature of a group's lead, where the group goes on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            sig, turn, at = _sig(b.column("x")), _long(b.column("turn")), np.arange(b.num_rows)
            lead = np.maximum.accumulate(np.where(turn == 0, at, -1))
            if held is not None:  # as row 0, behind which the batch moves
                sig, lead, at = np.concatenate((held[None], sig)), lead + 1, at + 1
            rows = at[turn == 1]
            of = lead[turn == 1]
            keep = np.zeros(b.num_rows, bool)
            for i in range(0, len(rows), 4096):
                keep[at[0] * -1 + rows[i : i + 4096]] = plausible(sig[of[i : i + 4096]], sig[rows[i : i + 4096]], near)
            held = sig[lead[-1]].copy()
            yield b.select([*GROUP, "node"]).filter(pa.array(keep))

    return streamed(pairs, classes.select("node", F.col("sig").alias("x")), run)


def confirmed(pairs: DataFrame, sets: DataFrame, near: tuple[int, int]) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.empty(0, np.uint64)
        for b in batches:
            keep = []
            for turn, x in zip(b.column("turn").to_pylist(), b.column("x"), strict=True):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                if turn == 0:
                    lead = s.copy()
                keep.append(turn == 1 and near_sets(lead, s, near))
            yield b.select([*GROUP, "node"]).filter(pa.array(keep, pa.bool_()))

    return streamed(pairs, sets, run).select("a", F.col("node").alias("b"))


def banded(classes: DataFrame) -> DataFrame:
    """(bucket, band, node, size) for every band of every class."""
    width = 2 * ROWS
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("sig", i * width + 1, width)) for i in range(BANDS)))
    return classes.select(F.posexplode(keys).alias("band", "bucket"), "node", F.col("n_shingles").alias("size")).select("bucket", "band", "node", "size")


BLOCKS = ("bucket", "i", "j")


def outsiders(left: DataFrame) -> DataFrame:
    """(bucket, top, blocks, parts) of the buckets in which ``left`` (bucket, node, comp, size) has several components."""
    each = left.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    all_ = each.groupBy("bucket").agg(F.max(F.struct("n", "size", "comp")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("n > top.n")
    count = lambda n, most, size: F.greatest(F.ceil(n / most), F.ceil(size * 8 / GROUP_BYTES)).cast("int")
    return all_.select("bucket", F.col("top.comp").alias("top"), count(F.col("n") - F.col("top.n"), BLOCK, F.col("size") - F.col("top.size")).alias("blocks"), count(F.col("n"), PART, F.col("size")).alias("parts"))


def in_blocks(left: DataFrame, mixed: DataFrame) -> DataFrame:
    """(bucket, i, j, held, band, node, comp): outsiders of block i go to every part j, and all members of part j to every block i."""
    rows = left.join(mixed, "bucket")
    of = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block, part = of("blocks", 3), of("parts", 4)
    held = F.when(F.col("comp") != F.col("top"), F.transform(upto("parts"), lambda j: F.struct(block.alias("i"), j.alias("j"), F.lit(True).alias("held"))))
    past = F.transform(upto("blocks"), lambda i: F.struct(i.alias("i"), part.alias("j"), F.lit(False).alias("held")))
    none = F.array().cast("array<struct<i:int,j:int,held:boolean>>")
    rows = rows.select("bucket", "band", "node", "comp", (F.col("comp") != F.col("top")).alias("out"), F.explode(F.concat(F.coalesce(held, none), past)).alias("at"))
    return rows.select("bucket", "at.i", "at.j", "at.held", "out", "band", "node", "comp")


def by_group(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(group)`` for each (bucket, i, j) of ``rows``: a table that comes whole; groups are of bounded size."""
    names = [c for c in rows.columns if c not in BLOCKS]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.column_stack([_long(b.column(c)).astype(np.int64) for c in BLOCKS])
            if last is not None and (key[0] != last).any():
                yield from run(pa.Table.from_batches(open_))
                open_ = []
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            part = b.select(["bucket", "i", "j", *names])
            for x, y in zip([0, *cuts.tolist()], cuts.tolist(), strict=False):
                yield from run(pa.Table.from_batches([*open_, part.slice(x, y - x)]))
                open_ = []
            open_.append(part.slice(int(cuts[-1]) if len(cuts) else 0))
            last = key[-1]
        if open_:
            yield from run(pa.Table.from_batches(open_))

    rows = rows.select(*BLOCKS, *names).repartition(*BLOCKS).sortWithinPartitions(*BLOCKS, "node")
    return rows.mapInArrow(groups, schema)


def open_pairs(rows: DataFrame, classes: DataFrame, near: tuple[int, int]) -> DataFrame:
    """(bucket, i, j, node, comp, partners, equal): members with pairs of other components that signatures leave open.

    A pair stands at the one of its members that comes first, and in its first common band only.
    """

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        node, comp, band, held, out = (_long(group.column(c)) for c in ("node", "comp", "band", "held", "out"))
        sig = _sig(group.column("sig").combine_chunks())
        bands = sig.reshape(len(sig), BANDS, ROWS)
        past = np.flatnonzero(~held)
        pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for x in np.flatnonzero(held).tolist():
            # Two outsiders meet twice: the lesser one being held counts.
            ys = past[(comp[past] != comp[x]) & (band[past] == band[x]) & (~out[past] | (node[past] > node[x]))]
            ys = ys[plausible(np.broadcast_to(sig[x], (len(ys), sig.shape[1])), sig[ys], near)] if len(ys) else ys
            ys = ys[(bands[ys] == bands[x]).all(2).argmax(1) == band[x]] if len(ys) else ys
            if len(ys):
                pairs[x] = ys, (sig[ys] == sig[x]).sum(1)
        if not pairs:
            return
        part = np.array(sorted({*pairs, *np.concatenate([y for y, _ in pairs.values()]).tolist()}))
        none = np.empty(0, np.int64)
        found = group.select(["bucket", "i", "j", "node", "comp"]).take(pa.array(part)).combine_chunks()
        lists = [pa.array([node[pairs[x][0]] if x in pairs else none for x in part.tolist()], pa.list_(pa.int64())), pa.array([pairs[x][1] if x in pairs else none for x in part.tolist()], pa.list_(pa.int64()))]
        yield from found.append_column("partners", lists[0]).append_column("equal", lists[1]).to_batches()

    return by_group(rows.join(classes.select("node", "sig"), "node"), run, "bucket long, i int, j int, node long, comp long, partners array<long>, equal array<long>")


def links_across(open_: DataFrame, sets: DataFrame, near: tuple[int, int]) -> DataFrame:
    """(a, b): confirmed links among the open pairs, enough to join what belongs together, so fewer than members."""

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        comp = dict(zip(group.column("node").to_pylist(), group.column("comp").to_pylist(), strict=True))
        full = {n: np.frombuffer(x.as_buffer(), np.uint64) for n, x in zip(group.column("node").to_pylist(), group.column("x"), strict=True)}
        pairs = [(-e, x, y) for x, ys, es in zip(*(group.column(c).to_pylist() for c in ("node", "partners", "equal")), strict=True) for y, e in zip(ys, es, strict=True)]
        root = {c: c for c in comp.values()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for _, x, y in sorted(set(pairs)):
            a, b = top(comp[x]), top(comp[y])
            if a != b and near_sets(full[x], full[y], near):
                root[a] = b
                out.append((x, y))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return by_group(open_.join(sets, "node"), run, "a long, b long")


def with_components(docs: DataFrame, k: int, near: tuple[int, int]) -> DataFrame:
    """(doc_id, h, n_shingles, fp, component_id) for every row of ``docs``; a written table."""
    rows = written(fold(docs, k), "rows", docs.count(), 2048)
    known = rows.where("fp is not null and doc_id is not null")
    classes = known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("sig").alias("sig"))
    # A class's number is unique once it is written, and cheaper to group and join by than its fingerprint.
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes", rows.known_rows)
    bands = banded(classes)
    counts = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    buckets = written(bands.join(counts, "bucket"), "buckets", BANDS * classes.known_rows, 1 << 16)
    members = buckets.select("node").distinct().join(classes.select("node", "rep", "fp"), "node")
    sets = written(sets_of(docs, members, k), "sets", classes.known_rows, 2048)
    stars = buckets.where("node <> least").groupBy(F.col("least").alias("a"), "node").agg(F.max(F.ceil(F.col("n") / PARTNERS)).alias("parts"))
    stars = stars.select("a", "parts", F.pmod(F.xxhash64("node"), "parts").alias("salt"), "node")
    near_by = written(compared(stars, classes, near), "pairs", buckets.known_rows, 8192)
    links = written(confirmed(near_by, sets, near), "links", near_by.known_rows)
    comps, done = connected_components(links), [near_by]
    # The least member has met all others; what is left of a bucket matters if it holds several components.
    left = buckets.where("node <> least").drop("n", "least").join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    left = written(left.select("bucket", "band", "node", "comp", "size"), "left", buckets.known_rows, 1 << 16)
    mixed = written(outsiders(left), "mixed", left.known_rows, 1 << 16)
    done += [left, mixed]
    open_ = written(open_pairs(in_blocks(left, mixed), classes, near), "open", left.known_rows, 8192)
    done.append(open_)
    if open_.known_rows:
        more = written(links_across(open_, sets, near), "links", open_.known_rows)
        both = links.unionAll(more)
        both.known_rows = links.known_rows + more.known_rows
        done += [comps, more]
        comps = connected_components(both)
    named = comps.join(classes.select("node", "rep"), "node")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("node", "component_id")
    full = classes.select("node", "fp", "rep").join(named, "node", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.drop("sig").withColumn("fp", F.when(F.col("doc_id").isNotNull(), F.col("fp"))).join(full, "fp", "left")
    out = out.select("doc_id", "h", "n_shingles", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = written(out, "components", rows.known_rows, 1 << 14)
    forget(rows, classes, buckets, sets, links, comps, *done)
    return out


def components(docs: DataFrame, k: int = SHINGLE, near: tuple[int, int] = NEAR) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    return with_components(docs, k, near).select("doc_id", "n_shingles", "component_id")


def kept(doc: Column, component: Column) -> Column:
    return F.coalesce(doc == component, F.lit(True))


def deduplicated(docs: DataFrame, k: int = SHINGLE, near: tuple[int, int] = NEAR) -> DataFrame:
    """The rows of ``docs`` with one document of each component: that with the least doc_id.

    Where several rows have that id, one of those with the least text hash stays.
    """
    rows = with_components(docs.select("doc_id", "text"), k, near).where("fp is not null")
    texts = rows.groupBy("component_id", "doc_id", "h").agg(F.count("*").alias("n"))
    first = texts.where("doc_id = component_id").groupBy(F.col("component_id").alias("c")).agg(F.min("h").alias("first"))
    texts = texts.join(first, F.col("component_id") == F.col("c")).withColumn("stays", (F.col("doc_id") == F.col("c")) & (F.col("h") == F.col("first")))
    # Rows to leave out, and those that stay but are there more than once.
    gone = written(texts.where("not stays or n > 1").select(F.col("doc_id").alias("_gone"), F.col("h").alias("_h"), "stays"), "gone", rows.count(), 1 << 14)
    key = lambda g: [docs["doc_id"].cast("long") == g["_gone"], F.xxhash64(docs["text"]) == g["_h"]]
    out, twice = docs.join(gone, key(gone), "left_anti"), gone.where("stays")
    return out if twice.isEmpty() else out.unionAll(docs.join(twice, key(twice), "left_semi").dropDuplicates(["doc_id", "text"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", kept(F.col("doc_id"), F.col("component_id")))


SQL = r"""
WITH RECURSIVE
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
c AS MATERIALIZED (SELECT min(doc_id) AS rep, hash(list_sort(s)) AS h, any_value(s) AS s FROM s WHERE len(s) > 0 GROUP BY h, len(s)),
x AS MATERIALIZED (SELECT rep, len(s) AS n, unnest(s) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k) UNION SELECT b, a FROM p WHERE 100 * k >= 80 * (na + nb - k)),
r AS (SELECT a AS node, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node AND r.root < l.b),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.root, c.rep, s.doc_id) AS component_id, s.doc_id = coalesce(m.root, c.rep, s.doc_id) AS kept
FROM s LEFT JOIN c ON len(s.s) > 0 AND c.h = hash(list_sort(s.s)) AND len(c.s) = len(s.s) LEFT JOIN m ON m.node = c.rep
"""
