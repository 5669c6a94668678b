"""Exact top-k inner products by multi-resolution segment statistics (operator 7).

Vectors become integers, floor(256 * x).  Their inner products don't change when
all are turned alike, so a rotation to the principal axes of the whole table
(sums of squares over all rows) brings what tells vectors apart to the front.  For a segment of L components with
means m, n and deviations s, t of two vectors, Cauchy-Schwarz gives
``dot <= L * (m * n + s * t)``; with the norms that is the segment lower bound of
the squared distance, ``L * ((m - n)^2 + (s - t)^2)``.  Summed over segments it
bounds a whole score.  From coarse to fine the leading axes' segments, of ``SEGMENT``
components, give way to single components; a pair goes on only while its bound
reaches the query's bar, and survivors get exact integer scores.

The table is dealt into chunks.  A first pass gives each query a bar, its k-th
best score within one chunk; the second sends every query with its bar past every chunk, which
holds candidates in memory and raises the bar as it goes.  Only queries are copied, and a chunk
returns what beats the bars.  The k best of that are the result.

Bounds are widened by a margin above their rounding error, and pairs that
equal the bar survive, so ties go to the smaller vec_id exactly.

Defined results: null vectors and those with null or non-finite components take
no part, nor do rows without an id; vectors of another length never meet; a
query with fewer than k others gets them all; an empty table gives no rows.  Repeated ids: a query's own id is
no candidate, each repeated row is a candidate of its own, and a repeated query
asks once, with its least vector.  Scores that no long can hold raise an error.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, table, written

#: Rows of a chunk: at most so many, but so few in small tables that there are ``CHUNKS``.
CHUNK, LEAST_CHUNK, CHUNKS = 1 << 16, 1 << 11, 64
QUERIES, COLUMNS = 256, 8192
SEGMENT = 8
#: Shares of the axes that are single components, by resolution.
FINE = (0.0, 0.5, 0.75, 0.875)
#: Below this share of survivors pairs go on one by one.
SPARSE = 0.05


def usable(vec: Column) -> Column:
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, ok)


def bounds(y: np.ndarray, fine: int, segment: int = SEGMENT) -> np.ndarray:
    """Per row ``fine`` single components, then means and deviations of segments, scaled so that a dot product of two rows bounds theirs from above."""
    n, d = y.shape
    edges = [*range(fine, d, segment), d]
    out = [y[:, :fine]]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = y[:, a:b]
        out += [part.mean(1, keepdims=True) * np.sqrt(b - a), part.std(1, keepdims=True) * np.sqrt(b - a)]
    return np.concatenate(out, axis=1)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``q`` and ``x``, pair by pair."""
    most = max(np.abs(q).max(initial=0).item(), np.abs(x).max(initial=0).item())
    if most * most * q.shape[1] < 1 << 53:  # sums that doubles hold exactly
        return np.concatenate([np.einsum("pd,pd->p", q[a : a + 8192].astype(np.float64), x[a : a + 8192].astype(np.float64)) for a in range(0, len(q), 8192)] or [np.empty(0)]).astype(np.int64)
    return np.array([sum(a * b for a, b in zip(u, v, strict=True)) for u, v in zip(q.tolist(), x.tolist(), strict=True)], object)


class Chunk:
    """Candidates in memory, with their statistics at each resolution."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, axes: np.ndarray):
        self.ids, self.x, self.axes = ids, x, axes
        y = x.astype(np.float64) @ axes
        self.fine = sorted({int(x.shape[1] * share) for share in FINE})
        self.stats = [bounds(y, f) for f in self.fine]
        self.norms = np.linalg.norm(y, axis=1)
        self.survivors = 0

    def best(self, q_ids: np.ndarray, q: np.ndarray, bars: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of each query's k best that reach its bar (-inf: none)."""
        z = q.astype(np.float64) @ self.axes
        stats, norms, bars = [bounds(z, f) for f in self.fine], np.linalg.norm(z, axis=1), bars.astype(np.float64).copy()
        rows, ids, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for a in range(0, len(self.ids), COLUMNS):
            r, c = self._reaching(q_ids, q, z, stats, norms, bars, slice(a, a + COLUMNS), k)
            rows, ids, score = np.concatenate((rows, r)), np.concatenate((ids, self.ids[c])), np.concatenate((score, exact(q[r], self.x[c])))
            self.survivors += len(r)
            order = np.lexsort((ids, -score, rows))
            rows, ids, score = rows[order], ids[order], score[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            last = place == k - 1
            bars[rows[last]] = np.maximum(bars[rows[last]], score[last].astype(np.float64))
            rows, ids, score = rows[place < k], ids[place < k], score[place < k]
        return rows, ids, score

    def _reaching(self, q_ids: np.ndarray, q: np.ndarray, z: np.ndarray, stats: list[np.ndarray], norms: np.ndarray, bars: np.ndarray, cols: slice, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose bounds reach the bars at every resolution."""
        margin = 1e-9 * (1 + norms[:, None] * self.norms[None, cols])
        alive = q_ids[:, None] != self.ids[None, cols]
        pairs: tuple[np.ndarray, np.ndarray] | None = None
        for no, (u, v) in enumerate(zip(stats, self.stats, strict=True)):
            if pairs is None:
                up = u @ v[cols].T + margin
                up[~alive] = -np.inf
                if no == 0 and up.shape[1] > k and np.isneginf(bars).any():
                    # Exact scores of the most promising give a bar where there is none.
                    best = u if len(stats) == 1 else stats[-1]
                    near = best @ self.stats[-1][cols].T
                    near[~alive] = -np.inf
                    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    got = exact(np.repeat(q, k, axis=0), self.x[cols][top.ravel()]).astype(np.float64).reshape(len(q), k)
                    got[~np.take_along_axis(alive, top, 1)] = -np.inf
                    bars[:] = np.maximum(bars, got.min(1))
                # A bar is a rounded score where scores are beyond 2 ** 53.
                alive &= up >= bars[:, None] - 1e-9 * np.abs(np.where(np.isneginf(bars), 0, bars))[:, None]
                if alive.sum() < SPARSE * alive.size:
                    pairs = np.nonzero(alive)
            else:
                r, c = pairs
                up = np.concatenate([np.einsum("pd,pd->p", u[r[i : i + 8192]], v[cols][c[i : i + 8192]]) for i in range(0, len(r), 8192)] or [np.empty(0)]) + margin[r, c]
                keep = up >= bars[r] - 1e-9 * np.abs(bars[r])
                pairs = r[keep], c[keep]
        r, c = np.nonzero(alive) if pairs is None else pairs
        return r, c + (cols.start or 0)


def principal_axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """By length of vector, the principal axes of all rows as columns, largest first; sums of fixed size reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for d, part in by_length(b):
                    x = vectors(part.column("v"), d)
                    sums[d] = sums.get(d, 0) + x.T.astype(np.float64) @ x
        yield as_batch(sums)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, g in zip(b.column("dim").to_pylist(), b.column("gram"), strict=True):
                sums[d] = sums.get(d, 0) + np.frombuffer(g.as_buffer(), np.float64)
        yield as_batch(sums)

    def as_batch(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["dim", "gram"])

    parts = rows.select(F.size("v").alias("dim"), "v").mapInArrow(partial, "dim int, gram binary")
    got = parts.repartition(16, "dim", F.spark_partition_id() % 16).mapInArrow(total, "dim int, gram binary").collect()
    grams: dict[int, np.ndarray] = {}
    for r in got:
        grams[r["dim"]] = grams.get(r["dim"], 0) + np.frombuffer(r["gram"], np.float64)
    return {d: np.linalg.eigh(g.reshape(d, d))[1][:, ::-1].copy() for d, g in grams.items()}


def vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def by_length(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = b.column("dim").to_numpy()
    cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(dims)]
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(dims[x]), b.slice(x, y - x)


def passed(candidates: DataFrame, queries: DataFrame, axes, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each chunk (dim, chunk, id, v) that reach the bars of the ``queries`` sent to it."""
    rows = candidates.select("dim", "chunk", F.lit(0).alias("turn"), "id", F.lit(None).cast("double").alias("bar"), "v").unionAll(queries.select("dim", "chunk", F.lit(1).alias("turn"), "id", "bar", "v"))
    rows = rows.repartition("dim", "chunk").sortWithinPartitions("dim", "chunk", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, chunk = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            k0, k1, turns = (b.column(c).to_numpy() for c in ("dim", "chunk", "turn"))
            cuts = [0, *(np.flatnonzero((k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1]) | (turns[1:] != turns[:-1])) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                part, now = b.slice(s, e - s), (int(k0[s]), int(k1[s]))
                if now != key:
                    key, held, chunk = now, [], None
                ids, x = part.column("id").to_numpy(), vectors(part.column("v"), now[0])
                if turns[s] == 0:
                    held.append((ids, x))
                    continue
                if chunk is None and held:
                    chunk = Chunk(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), axes.value[now[0]])
                    held = []
                bars = part.column("bar").to_numpy(zero_copy_only=False).astype(np.float64)
                bars = np.where(np.isnan(bars), -np.inf, bars)
                for i in range(0, len(ids) if chunk is not None else 0, QUERIES):
                    r, c, score = chunk.best(ids[i : i + QUERIES], x[i : i + QUERIES], bars[i : i + QUERIES], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + QUERIES][r], pa.int64()), pa.array(c, pa.int64()), pa.array(score.tolist(), pa.int64())], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors_: DataFrame, k: int = 5, query_every: int = 50, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best others of every row whose id is divisible by ``query_every``."""
    v = F.transform(F.col(vec), lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    rows = vectors_.where(usable(F.col(vec)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    # Places are fixed once they are written; they deal out equal rows as evenly as others.
    rows = written(rows.withColumns({"dim": F.size("v"), "place": F.monotonically_increasing_id()}), "vectors")
    size = min(CHUNK, max(LEAST_CHUNK, rows.known_rows // CHUNKS))
    n = max(1, -(-rows.known_rows // size))
    axes = rows.sparkSession.sparkContext.broadcast(principal_axes(rows))
    deal = lambda *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    candidates = rows.select("dim", deal("place").alias("chunk"), "id", "v")
    asked = rows.where(F.col("id") % query_every == 0).groupBy("id").agg(F.min(F.struct("v", "dim")).alias("x")).select("id", "x.v", "x.dim")
    none = F.lit(None).cast("double").alias("bar")
    first = passed(candidates, asked.select("dim", deal("id").alias("chunk"), "id", none, "v"), axes, k)
    first = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("bar")).where(F.col("n") == k).select(F.col("query_id").alias("id"), "bar")
    queries = written(asked.join(first, "id", "left"), "queries")
    everywhere = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk"), "id", "bar", "v")
    best = passed(candidates, everywhere, axes, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    out = written(best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best")
    forget(rows, queries)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
