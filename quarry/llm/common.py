"""What the operators share: tables, the shared folder, connected components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
SPACE = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE}]+"
#: Rows of an edge table per file.
EDGES = 20_000


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from the place the driver has it.

    On a cluster the package is shipped as usual (``--py-files`` or an image);
    then this only adds a search path.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is read from the session.  Only a session on one machine (tests) may go
    without; it gets a folder that goes with the process.
    """
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        got = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/quarry/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, rows: int | None = None, per_file: int = 4096) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``rows``: a known bound of its rows; then it is written in no more files than
    ``per_file`` rows each would make, so that small tables aren't a file a partition.
    The result's ``known_rows`` is what was written, counted on the way.
    """
    spark = df.sparkSession
    path, seen = new_path(spark, what), Observation()
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // per_file)))
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    # Where the plan turned out to be empty nothing was observed.
    n = seen.get.get("n")
    out.known_rows, out.known_path = out.count() if n is None else n, path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete what ``written`` made; nothing lazy may read it any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.known_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is 0; a null id is held out, so never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def unit(*parts: Column) -> Column:
    """A seeded uniform number in [0, 1): the same for the same parts on every run."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas, where Spark shares no subexpressions."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is the least node.

    Alternates large-star and small-star steps over the edge table until it no
    longer changes, which takes O(log^2 n) rounds; each leaves no more edges than the one
    before, with lesser ends.  A hub's edges are never gathered:
    the least neighbour is a combined minimum, and it returns by a join that
    adaptive execution splits.  Every round is a written table, so a lost executor
    costs at most one round.  Null ends and loops count as no edge.
    """
    e = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("a is not null and b is not null and a <> b").distinct()
    e, last = written(e, "edges", getattr(edges, "known_rows", None), EDGES), None
    while e.known_rows:
        now = e.agg(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()[0], e.known_rows
        if now == last:
            break
        last = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = written(root.select("hi", F.col("m").alias("lo")).unionAll(small).distinct(), "edges", e.known_rows, EDGES)
        forget(e)
        e = new
    out = e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
    out.known_path = e.known_path
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, label): at most ``per_class`` rows of either class that are not held out, least hash of the id first.

    Ids are chosen from the labels alone; texts are read for the chosen ones only,
    whose number is bounded, so their ids may be broadcast.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(~held_out(F.col("doc_id"))).distinct()
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    named = named.groupBy("doc_id").agg(F.max("label").alias("label")).join(ids, "doc_id", "left_semi")
    by = F.xxhash64(F.lit(20240611), "doc_id")
    pick = lambda k: named.where(F.col("label") == k).orderBy(by, "doc_id").limit(per_class)
    chosen = pick(0).unionAll(pick(1))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
