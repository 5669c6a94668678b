"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 9), SQL functions only.

1. Targets: sources in code-point order (null last) get weights 5, 2, 1,
   repeating, as shares of all words; none gets more than 3 times its own words,
   and the excess is shared again by weight until none is above.
2. Blocks: a seeded hash permutes each source's documents and cuts the order
   into ``BLOCKS`` blocks.  A source's quota is whole passes over its blocks, each in a
   permutation of its own, plus, in another, the blocks that fit into the rest of its target; the
   smallest of those that don't is cut between documents for what stays open.
3. Splitting tree: the root holds every source's block quota.  Each node gives
   half its capacity to its left child, drawing how many blocks of each source go
   there from the multivariate hypergeometric distribution (source by source, by
   inversion of a seeded uniform number), until there are ``2 ** LEVELS`` shards.
4. Each shard takes the next disjoint run of each source's permuted block
   slots, and a seeded hash shuffles its rows locally.

Only (source, block) sums are gathered to a window: ``BLOCKS`` rows a source.
Documents themselves are joined on (source, block), so a hot source spreads over
its blocks.  Nothing depends on partitioning; reruns agree.

Defined results: null text has size 0; a document of size 0 is never taken.
Null and equal sources are groups like any other; very long texts count whole.  Null or repeated ids hash by
id and text alike, so equal rows are taken alike, in a cut block as well.  Empty
input gives no rows.  ``mixed`` puts its copy and shard in place of columns of
these names; other extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, let, table, unit, word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BLOCKS = 256
LEVELS = 4
#: Ranges of a block, for the order of its documents.
RANGES = 256
SEED = 20240501


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size); by water-filling.

    With sources in order of cap / weight, those below the water level get their
    cap and the others share the rest by weight; the level is the first at which
    the next source's share is within its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*(F.lit(float(x)) for x in weights))
    s = sizes.withColumn("w", F.get(w, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    s = s.withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "total": F.sum("source_size").over(everything).cast("double"),
        "w_left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
    })
    # Words for one unit of weight once all sources before this one are at their caps.
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("w_left"))
    fits = F.col("w") * F.col("level") <= F.col("cap")
    s = s.withColumn("water", F.max(F.when(fits, F.col("level"))).over(everything))
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("w") * F.col("water"), F.col("cap"))).alias("target"))


def with_blocks(docs: DataFrame, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    u = unit(F.lit(seed), F.col("doc_id"), F.col("_key"))
    return docs.withColumns({"_u": u, "_block": F.floor(u * blocks).cast("int")})


def hypergeometric(u: Column, good: Column, total: Column, draws: Column) -> Column:
    """How many of ``draws`` blocks out of ``total`` are among ``good`` ones; by inversion of ``u``."""
    spec = F.struct(u.alias("u"), good.alias("good"), total.alias("total"), draws.alias("draws"), F.greatest(F.lit(0), draws - (total - good)).alias("low"), F.least(good, draws).alias("high"))

    def log_ratio(x: Column, k: Column) -> Column:
        return F.log((x["good"] - k) * (x["draws"] - k) / ((k + 1) * (x["total"] - x["good"] - x["draws"] + k + 1)))

    def log_weights(x: Column) -> Column:
        return F.aggregate(F.sequence(x["low"], x["high"]), F.array(F.lit(0.0)), lambda a, k: F.when(k < x["high"], F.concat(a, F.array(F.element_at(a, -1) + log_ratio(x, k)))).otherwise(a))

    def scaled(logs: Column) -> Column:
        return let(F.array_max(logs), lambda top: F.transform(logs, lambda y: F.exp(y - top)))

    def inverted(p: Column, x: Column) -> Column:
        walk = lambda bar: F.aggregate(p, F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("k")), lambda a, y: F.struct((a["sum"] + y).alias("sum"), F.when(a["sum"] <= bar, a["k"] + 1).otherwise(a["k"]).alias("k")))["k"]
        return let(x["u"] * F.aggregate(p, F.lit(0.0), lambda a, y: a + y), walk)

    def draw(x: Column) -> Column:
        return F.when(x["low"] >= x["high"], x["low"]).otherwise(x["low"] + let(let(log_weights(x), scaled), lambda p: inverted(p, x)))

    return let(spec, draw)


def _splitter(level: int, seed: int):
    """The fold over a node's sources: draws each source's share of the left child from what is left of both."""

    def step(a: Column, x: Column) -> Column:
        u = unit(F.lit(seed), F.lit(level), F.col("shard"), F.size(a["out"]))
        taken = lambda got: F.struct((a["total"] - x).alias("total"), (a["draws"] - got).alias("draws"), F.concat(a["out"], F.array(got)).alias("out"))
        return let(hypergeometric(u, x, a["total"], a["draws"]).cast("int"), taken)

    return step


def split_tree(quotas: DataFrame, levels: int = LEVELS, seed: int = SEED) -> tuple[DataFrame, list[DataFrame]]:
    """(source_no, shard, n, first): each shard's run of each source's block slots, from (source_no, quota); and the tables it is read from."""
    tables = []
    node = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("source_no", F.col("quota").cast("int").alias("q")))), lambda x: x["q"]).alias("q")).select(F.lit(0).alias("shard"), "q")
    for level in range(levels):
        total = F.aggregate("q", F.lit(0), lambda a, x: a + x)
        node = node.select("shard", "q", total.alias("total"))
        start = F.struct(F.col("total").alias("total"), F.floor(F.col("total") / 2).cast("int").alias("draws"), F.array().cast("array<int>").alias("out"))

        step = _splitter(level, seed)
        node = node.withColumn("left", F.aggregate("q", start, step, lambda a: a["out"]))
        right = F.zip_with("q", "left", lambda x, y: x - y)
        node = written(node.select(F.explode(F.array(F.struct((2 * F.col("shard")).alias("shard"), F.col("left").alias("q")), F.struct((2 * F.col("shard") + 1).alias("shard"), right.alias("q")))).alias("c")).select("c.shard", "c.q"), "tree", 2 ** (level + 1))
        tables.append(node)
    leaves = node.select("shard", F.posexplode("q").alias("source_no", "n"))
    first = F.sum("n").over(Window.partitionBy("source_no").orderBy("shard")) - F.col("n")
    return leaves.withColumn("first", first).where("n > 0"), tables


def _filled(a: Column, x: Column) -> Column:
    """The fold over a source's blocks: take one that fits into what is open, else note the smallest that doesn't."""
    fits = x["words"] <= a["open"]
    other = F.struct(x["words"].alias("words"), x["rank"].alias("rank"))
    cut = F.when(fits, a["cut"]).otherwise(F.when(a["cut"].isNull() | (other < a["cut"]), other).otherwise(a["cut"]))
    return F.struct(
        F.when(fits, a["open"] - x["words"]).otherwise(a["open"]).alias("open"),
        F.when(fits, F.concat(a["in"], F.array(x["rank"]))).otherwise(a["in"]).alias("in"),
        cut.alias("cut"),
    )


def plan(docs: DataFrame, blocks: int = BLOCKS, levels: int = LEVELS, seed: int = SEED, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Rows of ``docs`` (doc_id, source, size, _key) with source_size, target, takes and shards."""
    docs = with_blocks(docs, blocks, seed)
    sums = written(docs.groupBy("source", "_block").agg(F.sum("size").alias("words")), "blocks", docs.count())
    aims = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    aims = aims.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    # Rounding must not turn an exact number of passes into one less and a whole rest.
    aims = aims.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("int"))
    aims = written(aims.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))), "targets", sums.known_rows)
    b = sums.alias("b").join(aims.alias("a"), F.col("b.source").eqNullSafe(F.col("a.source"))).select("a.*", "b._block", "b.words")
    by = Window.partitionBy("source_no").orderBy(unit(F.lit(seed), F.lit("rest"), F.col("source_no"), F.col("_block")), "_block")
    b = b.withColumn("rank", F.row_number().over(by) - 1)
    # Blocks in their permutation fill the rest while they fit; of those left out the smallest is cut for what is still open.
    listed = F.array_sort(F.collect_list(F.struct("rank", "words")).over(Window.partitionBy("source_no")))
    start = F.struct(F.col("rest").alias("open"), F.array().cast("array<int>").alias("in"), F.lit(None).cast("struct<words:bigint,rank:int>").alias("cut"))
    b = b.withColumn("fill", F.aggregate(listed, start, _filled))
    b = b.withColumns({"extra": F.array_contains("fill.in", F.col("rank")).cast("int"), "open": F.col("fill.open"), "cut": F.coalesce(F.col("fill.cut.rank") == F.col("rank"), F.lit(False)) & (F.col("fill.open") > 0)}).drop("fill")
    b = written(b, "plan", sums.known_rows)
    whole = F.col("extra") + F.col("cut").cast("int")
    quotas = b.groupBy("source_no").agg((F.first("passes") * F.count("*") + F.sum(whole)).alias("quota"), F.count("*").alias("n_blocks"))
    tree, tables = split_tree(quotas, levels, seed)
    # A block's slots: one for each pass and, if drawn again, one in the rest's permutation, which the tree takes first.
    slots = b.join(quotas.select("source_no", "n_blocks"), "source_no").withColumns({"drawn": F.sum(whole).over(Window.partitionBy("source_no")), "nth": F.sum(whole).over(Window.partitionBy("source_no").orderBy("rank")) - 1})
    kept = ["source_no", "source", "_block", "source_size", "target", "passes", "extra", "cut", "open"]
    own = slots.select(*kept, F.lit(0).alias("_no"), F.when(whole > 0, F.col("nth")).alias("slot"))
    turns = slots.where("passes > 0").select(*kept, "drawn", "n_blocks", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("_no"))
    order = Window.partitionBy("source_no", "_no").orderBy(unit(F.lit(seed), F.lit("pass"), F.col("source_no"), F.col("_no"), F.col("_block")), "_block")
    turns = turns.withColumn("slot", F.col("drawn") + (F.col("_no") - 1) * F.col("n_blocks") + F.row_number().over(order) - 1)
    slots = own.unionByName(turns.select(*kept, "_no", "slot"))
    at = tree.select(F.col("source_no").alias("t_no"), "shard", "first", "n")
    slots = slots.join(at, (F.col("source_no") == F.col("t_no")) & (F.col("slot") >= F.col("first")) & (F.col("slot") < F.col("first") + F.col("n")), "left")
    chosen = slots.groupBy(*kept).agg(F.array_sort(F.collect_list(F.struct("_no", "shard"))).alias("s"))
    chosen = written(chosen.withColumn("shards", F.transform(F.filter("s", lambda x: x["shard"].isNotNull()), lambda x: x["shard"])).drop("s"), "slots", sums.known_rows)
    forget(sums, aims, b, *tables)
    d, c = docs.alias("d"), chosen.alias("c")
    out = d.join(c, F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d._block") == F.col("c._block"))).select("d.*", "c.source_size", "c.target", "c.source_no", "c.passes", "c.extra", "c.cut", "c.open", "c.shards")
    # In a cut block documents come in the permutation's order while at least half of each is below the rest.  The order
    # goes by ranges: sums of the ranges before, then an order within each.
    cut = out.where("cut").withColumn("_range", F.floor(F.col("_u") * blocks * RANGES).cast("long"))
    ranges = cut.groupBy("source_no", "_range").agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("source_no").orderBy("_range")) - F.col("_sum")
    ranges = ranges.select(F.col("source_no").alias("_s"), F.col("_range").alias("_r"), before.alias("_before"))
    cut = cut.join(ranges, (F.col("source_no") == F.col("_s")) & (F.col("_range") == F.col("_r"))).drop("_s", "_r")
    # Equal rows are peers: they come and go together.
    cut = cut.withColumn("_upto", F.col("_before") + F.sum("size").over(Window.partitionBy("source_no", "_range").orderBy("_u", "doc_id", "_key")))
    peers = F.sum("size").over(Window.partitionBy("source_no", "_range", "_u", "doc_id", "_key"))
    cut = cut.withColumn("again", (F.col("_upto") - peers / 2.0 <= F.col("open")).cast("int")).drop("_upto", "_before", "_range")
    out = out.where("not cut").withColumn("again", F.col("extra")).unionByName(cut)
    # The drawn slot comes first among a block's shards; a document that the cut leaves out skips it.
    has = F.col("extra") + F.col("cut").cast("int")
    shards = F.when((has == 1) & (F.col("again") == 0), F.slice("shards", 2, 1 << 20)).otherwise(F.col("shards"))
    takes = F.when(F.col("size") > 0, F.col("passes") + F.col("again")).otherwise(F.lit(0))
    return out.withColumns({"takes": takes, "shards": F.when(F.col("size") > 0, shards).otherwise(F.array().cast("array<int>"))}).drop("source_no", "passes", "extra", "cut", "open", "again", "_block")


def prepared(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, _key): what the plan needs of each document; not its text."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text", "source").alias("_key"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` once per take, with ``shard``; shuffled within each shard."""
    p = plan(prepared(docs), **options).where("takes > 0").select(F.col("doc_id").alias("_id"), "_key", "shards").distinct()
    names = [c for c in docs.columns if c.lower() not in ("copy", "shard")]
    # A row's columns travel as one, so no name of theirs meets one of the plan's.
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col("doc_id").alias("_d"), F.xxhash64("text", "source").alias("_k"))
    rows = d.join(p, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")))
    rows = rows.select("_row", "_d", F.posexplode("shards").alias("copy", "shard"))
    spread = F.pmod(F.xxhash64("_d", "copy"), F.lit(1 << 10))
    rows = rows.repartition(F.col("shard"), spread).sortWithinPartitions("shard", F.xxhash64(F.lit(SEED), "_d", "copy"))
    return rows.select("_row.*", "copy", "shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(prepared(table(spark, sf_dir, "documents")))
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("takes")).cast("long").alias("taken"), "shards")
