"""Benchmark decontamination by latent semantic retrieval (operator 4).

1. Texts become 64-bit word hashes, and these fall into ``TERMS`` buckets.  A
   first pass over all documents cuts them into passages of ``PASSAGE`` words, counts
   the passages that hold a bucket (for idf) and forms the range sketch of the
   randomised SVD: each passage of the bucket-by-passage matrix goes, with a
   random sign, to one of ``SKETCH`` columns.  A second pass projects every passage on the
   sketch's orthonormal range and sums the products, of fixed size; their eigenvectors give
   ``DIMENSIONS`` left singular vectors and the singular values.
2. Every text's windows get latent vectors: of ``PASSAGE`` words for items up to that
   length, of twice as many for items up to twice that, and so on, each half a window
   after the last.  All are multiplied with their items, block by block.  An item of n
   words that lies in a window of w among unrelated ones has a cosine of about sqrt(n / w), and
   windows that reach ``COSINE`` of that are candidates.  So are, at
   any cosine, windows whose surroundings hold ``LCS`` of the item's words in whatever
   order near ``HITS`` of its rarest: words repeated beside an item drown its vector.
3. A candidate is confirmed on the words of item and surroundings:
   ``SURE`` of the item's words are a common subsequence; or ``LCS`` of them are, with
   ``ANSWER`` of the words of its answer, the item's last quarter; or, where every other word
   is replaced, ``SOME`` of them, ``RARE`` rare ones included; or, where parts have changed
   places, ``PAIRS`` of its neighbouring words are still neighbours, with ``ANSWER`` of the answer.

Items of fewer than ``LEAST`` words are found word for word only.
The benchmark is broadcast in parts of at most ``PART_BYTES``, with a pass over the
documents for each.

Defined results: null or empty texts are clean; items without words are in
no text; repeated items are reported by
each id; repeated rows each get their result, whatever their id.  An empty
benchmark leaves every document clean, an empty table has no rows.  Very long texts are
cut into stretches that overlap by more than a window's surroundings.  Only doc_id and text are read; the
filter passes all columns through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import table, written

TERMS = 1 << 14
PASSAGE = 64
SKETCH = 112
DIMENSIONS = 96
CHUNK = 256
COSINE = 0.3
LCS, ANSWER, SURE = 0.6, 0.5, 0.8
SOME, RARE = 0.45, 5
PAIRS = 0.6
#: A word is rare if its bucket is in so small a share of passages.
RARE_SHARE = 0.05
LEAST = 8
#: So many indexed words must be near each other for windows to be looked at.
HITS = 5
PART_BYTES = 32 << 20
#: Words of texts that are multiplied at once.
BLOCK = 1 << 16
#: Cells of a table of windows by items.
CELLS = 1 << 21


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(50)).astype(np.int64)


def passages(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every word, size of every passage, seed of every passage) of a batch's texts."""
    terms, seeds, sizes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()), strict=True):
        h = words.hashes(t.as_py())
        if len(h):
            n = -(-len(h) // PASSAGE)
            terms.append(bucket(h))
            # By id and text, so that rows without an id differ too.
            seed = np.uint64((i or 0) * 0x9E3779B97F4A7C15 & (2**64 - 1)) ^ np.bitwise_xor.reduce(h)
            seeds.append(np.arange(n, dtype=np.uint64) + seed)
            sizes.append(np.full(n, PASSAGE))
            sizes[-1][-1] = len(h) - PASSAGE * (n - 1)
    return np.concatenate(terms), np.concatenate(sizes), words.mixed(np.concatenate(seeds))


def with_zero(table: np.ndarray) -> np.ndarray:
    """``table`` with a last row of zeros, for ``row_sums``."""
    return np.concatenate((table, np.zeros((1, table.shape[1]), table.dtype)))


def padded(term: np.ndarray, size: np.ndarray, width: int, fill: int) -> np.ndarray:
    """The stretches of ``size`` that ``term`` consists of, a row each."""
    at = np.full(len(size) * width, fill)
    at[np.arange(len(term)) + np.repeat(np.arange(len(size)) * width - (np.cumsum(size) - size), size)] = term
    return at.reshape(len(size), width)


def row_sums(table: np.ndarray, term: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The sums of the rows of ``table`` (its last one zeros) at each of the stretches that ``term`` consists of; their sizes are at most ``width``."""
    return (np.ones((1, width), table.dtype) @ table.take(padded(term, size, width, len(table) - 1), axis=0))[:, 0]


def sketch(docs: DataFrame) -> DataFrame:
    """(chunk, sketch, df, passages): the summed range sketch and passage counts of all texts, by chunk of buckets; whole numbers, so in any order the same."""
    chunks = TERMS // CHUNK

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, df, n = np.zeros(TERMS * SKETCH), np.zeros(TERMS, np.int64), 0
        for b in batches:
            for part in (b.slice(i, 1024) for i in range(0, b.num_rows, 1024)):
                term, size, r = passages(part)
                if not len(term):
                    continue
                column, sign = (r % np.uint64(SKETCH)).astype(np.int64), np.where(r >> np.uint64(63), 1.0, -1.0)
                y += np.bincount(term * SKETCH + np.repeat(column, size), np.repeat(sign, size), TERMS * SKETCH)
                # A passage's buckets in order; the first of equal ones counts.
                held = np.sort(padded(term, size, PASSAGE, TERMS).astype(np.int16), axis=1)
                new = np.concatenate((np.ones((len(held), 1), bool), held[:, 1:] != held[:, :-1]), axis=1)
                df += np.bincount(held[new], minlength=TERMS + 1)[:TERMS]
                n += len(size)
        y = y.astype(np.int32).reshape(chunks, -1)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(chunks), pa.int32()), "sketch": [x.tobytes() for x in y], "df": [x.tobytes() for x in df.reshape(chunks, -1)], "passages": pa.array([n] * chunks, pa.int64())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for chunk, y, df, n in zip(*(b.column(c).to_pylist() for c in ("chunk", "sketch", "df", "passages")), strict=True):
                s = sums.setdefault(chunk, [np.zeros(CHUNK * SKETCH, np.int64), np.zeros(CHUNK, np.int64), 0])
                s[0] += np.frombuffer(y, np.int32)
                s[1] += np.frombuffer(df, np.int64)
                s[2] += n
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "sketch": [s[0].tobytes() for s in sums.values()], "df": [s[1].tobytes() for s in sums.values()], "passages": pa.array([s[2] for s in sums.values()], pa.int64())})

    schema = "chunk int, sketch binary, df binary, passages long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial, schema).repartition("chunk").mapInArrow(summed, schema)


def products(docs: DataFrame, basis: np.ndarray) -> np.ndarray:
    """The sum over all passages of the products of their projections on ``basis`` (buckets and a row of zeros x columns, idf within)."""
    shared, k = docs.sparkSession.sparkContext.broadcast(basis), basis.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            for part in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
                term, size, _ = passages(part)
                if len(term):
                    p = row_sums(shared.value, term, size, PASSAGE)
                    total += p.T.astype(np.float64) @ p
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = reduce(np.add, (np.frombuffer(x, np.float64) for b in batches for x in b.column("sum").to_pylist()), np.zeros(k * k))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    # Sums of fixed size, by groups of tasks and then on the driver; in a fixed order, so that reruns agree.
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial, "sum binary").withColumn("at", F.spark_partition_id())
    rows = rows.repartition(16, F.pmod("at", F.lit(16))).sortWithinPartitions("at").select("sum").mapInArrow(added, "sum binary").withColumn("at", F.spark_partition_id())
    return reduce(np.add, (np.frombuffer(r["sum"], np.float64) for r in rows.orderBy("at").collect()), np.zeros(k * k)).reshape(k, k)


@dataclass
class Space:
    rows: np.ndarray  # a bucket's latent vector, idf within
    share: np.ndarray  # share of passages that hold a bucket


def latent_space(docs: DataFrame) -> Space:
    """The randomised SVD of all passages; what reaches the driver has a fixed size."""
    got = sketch(docs).toArrow().sort_by("chunk")
    if not got.num_rows or not got.column("passages")[0].as_py():  # no documents
        return Space(np.zeros((TERMS, 1), np.float32), np.zeros(TERMS))
    y = np.frombuffer(b"".join(got.column("sketch").to_pylist()), np.int64).reshape(TERMS, SKETCH)
    df = np.frombuffer(b"".join(got.column("df").to_pylist()), np.int64)
    n = got.column("passages")[0].as_py()
    idf = np.log((1 + n) / (1 + df)) + 1
    y = y * idf[:, None]
    values, vectors = np.linalg.eigh(y.T @ y)
    keep = values > 1e-9 * max(values.max(), 1e-30)
    basis = y @ (vectors[:, keep] / np.sqrt(values[keep]))  # orthonormal columns
    gram = products(docs, with_zero((basis * idf[:, None]).astype(np.float32)))
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-9 * max(values.max(), 1e-30)
    values, vectors = values[keep][::-1][:DIMENSIONS], vectors[:, keep][:, ::-1][:, :DIMENSIONS]
    # Divided by the singular values, so that what all passages share doesn't drown the rest.
    left = basis @ (vectors / np.sqrt(values))
    return Space((left * idf[:, None] * np.sqrt(n)).astype(np.float32), df / n)


@dataclass
class Item:
    ids: list[int]
    words: np.ndarray
    vector: np.ndarray  # of unit length
    masks: dict[int, int]  # word -> its places
    rare: int = 0  # places of rare words

    def __post_init__(self) -> None:
        self.n = len(self.words)
        self.rare_words = frozenset(x for x, places in self.masks.items() if places & self.rare)
        others, least = self.n - len(self.rare_words), lambda share: int(np.ceil(share * self.n - 1e-9))
        #: Every rule asks for at least so many different ones of the rare words; the rule of pairs for so many.
        self.least_rare = min(least(LCS) - others, max(RARE, least(SOME) - others))
        self.least_paired = least(PAIRS) - others


@dataclass
class Benchmark:
    space: Space
    items: list[Item]  # those of LEAST words or more first, by length
    classes: list[tuple[int, int, int]]  # (window, from, to): items that are looked for in windows of that length
    windows: np.ndarray  # by item, up to 4/3 of its length: within two of these indexed words are near each other
    rare: np.ndarray  # sorted hashes of the words that are indexed
    first: np.ndarray  # postings of each: from first[i] to first[i + 1]
    postings: np.ndarray
    maybe: np.ndarray  # by the hash's leading 16 bits: whether it can be indexed
    short: dict[int, dict[int, int]]  # by length: hash of all words -> item

    def __post_init__(self) -> None:
        self.table = with_zero(self.space.rows)
        #: The items' rare words by number, and for each number the items that have it.
        self.words = np.unique(np.array([w for x in self.items for w in x.rare_words], np.uint64))
        self.known = np.zeros(1 << 16, bool)
        self.known[(self.words >> np.uint64(48)).astype(np.int64)] = True
        own = [np.searchsorted(self.words, np.array(sorted(x.rare_words), np.uint64)) for x in self.items]
        owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
        number = np.concatenate([np.empty(0, np.int64), *own])
        self.owners = owner[np.argsort(number, kind="stable")]
        self.first_owner = np.concatenate(([0], np.cumsum(np.bincount(number, minlength=len(self.words)))))
        self.least = np.array([min(x.least_rare, x.least_paired) for x in self.items], np.int64)
        self.vectors = np.stack([x.vector for x in self.items]).astype(np.float32) if self.items else np.zeros((0, 1), np.float32)
        self.enough = COSINE * np.sqrt([x.n for x in self.items])  # over the root of the window's length


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def runs_of(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    x = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        x = words.mixed(x + h[i : len(h) - n + 1 + i])
    return x


def prepare_items(items: list[tuple[int, str | None]], space: Space) -> Benchmark:
    by_words: dict[bytes, Item] = {}
    for no, text in items:
        h = words.hashes((text or "").encode())
        if not len(h):
            continue
        if h.tobytes() in by_words:
            by_words[h.tobytes()].ids.append(no)
            continue
        masks: dict[int, int] = {}
        for i, x in enumerate(h.tolist()):
            masks[x] = masks.get(x, 0) | 1 << i
        rare = sum(1 << i for i, x in enumerate(space.share[bucket(h)].tolist()) if x <= RARE_SHARE)
        by_words[h.tobytes()] = Item([no], h, unit_rows(space.rows[bucket(h)].sum(0)), masks, rare)
    found = sorted(by_words.values(), key=lambda x: (x.n < LEAST, x.n, x.ids[0] is None, x.ids[0] or 0))
    windows, classes, last, pairs = [], [], 0, []
    short: dict[int, dict[int, int]] = {}
    for k, item in enumerate(found):
        if item.n < LEAST:
            short.setdefault(item.n, {})[int(runs_of(item.words, item.n)[0])] = k
            continue
        # A length class reaches to 4/3 of its shortest item.
        last = last if item.n <= last else item.n * 4 // 3
        if not classes or item.n > classes[-1][0]:
            classes.append((max(PASSAGE, 1 << (item.n - 1).bit_length()), k, k))
        classes[-1] = (*classes[-1][:2], k + 1)
        windows.append(last)
        # Of the words a subsequence may miss all but HITS of these at most.
        n = item.n - int(np.ceil(LCS * item.n - 1e-9)) + HITS
        rarest = np.argsort(space.share[bucket(item.words)], kind="stable")[:n]
        # A word that is there twice can be hit once and count twice, so its places are indexed apart.
        pairs += [(x, k) for x in item.words[rarest].tolist()]
    pairs.sort()
    hashes = np.array([x for x, _ in pairs], np.uint64)
    rare, first = np.unique(hashes, return_index=True)
    maybe = np.zeros(1 << 16, bool)
    maybe[(rare >> np.uint64(48)).astype(np.int64)] = True
    return Benchmark(space, found, classes, np.array(windows, np.int64), rare, np.append(first, len(pairs)), np.array([k for _, k in pairs], np.int64), maybe, short)


def common_subsequence(item: Item, text: list[int]) -> int:
    """The item's places on a longest common subsequence with ``text``, as bits: bit-parallel."""
    masks, full = item.masks, (1 << item.n) - 1
    v = full
    for x in text:
        m = masks.get(x)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return full & ~v


def kept_pairs(item: Item, text: list[int]) -> tuple[float, float]:
    """Shares of the item's neighbouring words that are neighbours in ``text``, and of its answer's words that are there."""
    w = item.words.tolist()
    near, there, tail = set(zip(text, text[1:], strict=False)), set(text), w[item.n - max(1, item.n // 4) :]
    return sum(p in near for p in zip(w, w[1:], strict=False)) / max(1, item.n - 1), sum(x in there for x in tail) / len(tail)


def confirmed(item: Item, text: list[int]) -> float:
    """The share of the item's words that ``text`` has in sequence, if that confirms the item; else 0."""
    shared = len(item.rare_words & set(text))
    if shared < item.least_rare and shared < item.least_paired:
        return 0.0
    places = common_subsequence(item, text)
    got, n_answer = places.bit_count(), max(1, item.n // 4)
    share, answer = got / item.n, (places >> (item.n - n_answer)).bit_count() >= ANSWER * n_answer
    if share >= SURE or (share >= LCS and answer):
        return share
    if share >= SOME - 1e-9 and (places & item.rare).bit_count() >= RARE:
        return share
    if shared < item.least_paired:
        return 0.0
    pairs, tail = kept_pairs(item, text)
    return share if pairs >= PAIRS and tail >= ANSWER else 0.0


def covered(item: Item, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many of the item's words each stretch of ``text`` holds, each as often as in both: no common subsequence is longer."""
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    out = np.zeros(len(start), np.int64)
    for x, places in item.masks.items():
        a, b = np.searchsorted(ranked, np.uint64(x)), np.searchsorted(ranked, np.uint64(x), "right")
        if a < b:
            at = order[a:b]
            out += np.minimum(np.searchsorted(at, end) - np.searchsorted(at, start), places.bit_count())
    return out


def regions(h: np.ndarray, bench: Benchmark) -> list[tuple[int, int, int]]:
    """(item, from, to): where a text holds HITS of an item's indexed words within two windows, joined if they overlap."""
    at = np.flatnonzero(bench.maybe[(h >> np.uint64(48)).astype(np.int64)])
    j = np.searchsorted(bench.rare, h[at])
    j[j == len(bench.rare)] = 0
    same = bench.rare[j] == h[at]
    at, j = at[same], j[same]
    if len(at) == 0:
        return []
    n = bench.first[j + 1] - bench.first[j]
    item = bench.postings[np.repeat(bench.first[j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    place = np.repeat(at, n)
    order = np.lexsort((place, item))
    item, place = item[order], place[order]
    if len(item) < HITS:
        return []
    a, b = place[: len(item) - HITS + 1], place[HITS - 1 :]
    w = bench.windows[item[: len(a)]]
    hit = np.flatnonzero((item[: len(a)] == item[HITS - 1 :]) & (b - a < 2 * w))
    out: list[tuple[int, int, int]] = []
    for k, x, y, z in zip(item[hit].tolist(), a[hit].tolist(), b[hit].tolist(), w[hit].tolist(), strict=True):
        # The item may begin a window and a half before its last hit and end as far after its first.
        x, y = max(0, y - 3 * z // 2), min(len(h), x + 3 * z // 2 + 1)
        if out and out[-1][0] == k and x <= out[-1][2]:
            out[-1] = (k, out[-1][1], max(y, out[-1][2]))
        else:
            out.append((k, x, y))
    return out


def found_runs(h: np.ndarray, bench: Benchmark) -> list[int]:
    """The short items that a text holds word for word."""
    out = []
    for n, items in bench.short.items():
        runs = runs_of(h, n)
        out += [items[x] for x in np.unique(runs[np.isin(runs, np.array(list(items), np.uint64))]).tolist()]
    return out


def near_windows(texts: list[np.ndarray], bench: Benchmark) -> Iterator[tuple[int, int, int, int]]:
    """(text, from, to, item): windows whose latent cosine to an item is high enough, with half a window on either side, if these hold enough rare words of it."""
    size = np.array([len(h) for h in texts])
    begin, total = np.cumsum(size) - size, int(size.sum())
    whole_texts = np.concatenate(texts)
    term, (place, number) = bucket(whole_texts), known_words(whole_texts, bench)
    for w, k0, k1 in bench.classes if total else ():
        half = w // 2
        n = -(-size // half)  # halves of windows
        text = np.repeat(np.arange(len(size)), n)
        no = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = begin[text] + half * no
        last = no == n[text] - 1
        v = row_sums(bench.table, term, np.where(last, size[text] - half * no, half), half)
        v[:-1] += np.where(last[:-1, None], 0, v[1:])
        # A text's last half is a window of its own only if it is the first too.
        whole = ~last | (no == 0)
        v, text, start = v[whole], text[whole], start[whole]
        low, high = np.maximum(start - half, begin[text]), np.minimum(start + w + half, begin[text] + size[text])
        for x in range(0, len(v), step := max(1, CELLS // len(bench.items))):
            y = slice(x, x + step)
            cos = (v[y] / np.maximum(np.linalg.norm(v[y], axis=1, keepdims=True), 1e-30)) @ bench.vectors[k0:k1].T
            # Less than what any rule asks for needs no closer look.
            near = (cos >= bench.enough[k0:k1] / np.sqrt(w)) & (shared_words(place, number, low[y], high[y], bench)[:, k0:k1] >= bench.least[k0:k1])
            at, item = np.nonzero(near)
            at += x
            yield from zip(text[at].tolist(), (low[at] - begin[text[at]]).tolist(), (high[at] - begin[text[at]]).tolist(), (item + k0).tolist(), strict=True)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each of ``first`` on, ``n`` of them."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def shared_words(place: np.ndarray, number: np.ndarray, low: np.ndarray, high: np.ndarray, bench: Benchmark) -> np.ndarray:
    """By stretch and item, how many of the stretch's words are rare ones of the item."""
    a, b = np.searchsorted(place, low), np.searchsorted(place, high)
    word = number[spread(a, b - a)]
    n = bench.first_owner[word + 1] - bench.first_owner[word]
    cell = np.repeat(np.repeat(np.arange(len(low)), b - a) * len(bench.items), n) + bench.owners[spread(bench.first_owner[word], n)]
    return np.bincount(cell, minlength=len(low) * len(bench.items)).reshape(len(low), -1)


def covering_windows(h: np.ndarray, bench: Benchmark) -> Iterator[tuple[int, int, int]]:
    """(item, from, to): windows of a quarter length's step whose surroundings hold ``LCS`` of an item's words, near its rarest."""
    for k, x, y in regions(h, bench):
        item, w = bench.items[k], int(bench.windows[k])
        start = np.arange(x, max(x + 1, y - w + max(1, w // 4)), max(1, w // 4))
        low, high = np.maximum(start - w // 2, 0), np.minimum(np.minimum(start + w, y) + w // 2, len(h))
        enough = covered(item, h[low[0] : high[-1]], low - low[0], high - low[0]) >= LCS * item.n - 1e-9
        yield from ((k, a, b) for a, b in zip(low[enough].tolist(), high[enough].tolist(), strict=True))


def matches_of(texts: list[np.ndarray], bench: Benchmark) -> list[dict[int, float]]:
    """By text of word hashes, the items found in it by their numbers, with their share of words in sequence."""
    out: list[dict[int, float]] = [dict.fromkeys(found_runs(h, bench), 1.0) for h in texts]

    def check(no: int, low: int, high: int, k: int) -> None:
        if out[no].get(k) != 1.0:
            share = confirmed(bench.items[k], texts[no][low:high].tolist())
            if share:
                out[no][k] = max(out[no].get(k, 0.0), share)

    if bench.classes:
        for at in near_windows(texts, bench):
            check(*at)
        for no, h in enumerate(texts):
            for k, low, high in covering_windows(h, bench):
                check(no, low, high, k)
    return out


def known_words(h: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """Where ``h`` has one of the items' rare words, and its number."""
    at = np.flatnonzero(bench.known[(h >> np.uint64(48)).astype(np.int64)]) if len(bench.words) else np.empty(0, np.int64)
    j = np.minimum(np.searchsorted(bench.words, h[at]), max(0, len(bench.words) - 1))
    same = bench.words[j] == h[at]
    return at[same], j[same]


def matches(h: np.ndarray, bench: Benchmark) -> dict[int, float]:
    """The items found in a text, as ``matches_of`` has them."""
    return next(found([h], bench))


def found(texts: list[np.ndarray], bench: Benchmark) -> Iterator[dict[int, float]]:
    """``matches_of`` in blocks of about ``BLOCK`` words; longer texts in stretches that overlap by more than any window's surroundings."""
    lap = 2 * max((w for w, _, _ in bench.classes), default=LEAST)
    stretches = [(no, h[a : a + BLOCK + lap]) for no, h in enumerate(texts) for a in range(0, max(1, len(h)), BLOCK)]
    out: list[dict[int, float]] = [{} for _ in texts]
    group, size = [], 0
    for at, (no, h) in enumerate(stretches):
        group.append((no, h))
        size += len(h)
        if size >= BLOCK or at == len(stretches) - 1:
            for (i, _), got in zip(group, matches_of([x for _, x in group], bench), strict=True):
                for k, share in got.items():
                    out[i][k] = max(out[i].get(k, 0.0), share)
            group, size = [], 0
    yield from out


def parts_of(docs: DataFrame, benchmark: DataFrame) -> Iterator[Benchmark]:
    """The benchmark in parts of about ``PART_BYTES``, one at a time on the driver; all with the same latent space."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n = -(-size // PART_BYTES)
    space = latent_space(docs) if n else None
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        yield prepare_items([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()], space)


def _hashes(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
        yield part, [words.hashes(t.as_py()) for t in part.column("text").cast(pa.binary())]


def flagged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, items, lcs) of every row: the ids of the items found, sorted, and their highest share in sequence."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(False).alias("contaminated"), F.array().cast("array<long>").alias("items"), F.lit(0.0).alias("lcs"))
    for no, bench in enumerate(parts_of(docs, benchmark)):
        rows = _flagged(rows if no == 0 else written(rows, "flagged"), bench)
    return rows.drop("text")


def _flagged(rows: DataFrame, bench: Benchmark) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(bench)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for b in batches:
            for part, texts in _hashes(b):
                got = list(found(texts, bench))
                before = [part.column(c).to_pylist() for c in ("contaminated", "items", "lcs")]
                ids = [sorted({*i, *(x for k in g for x in bench.items[k].ids if x is not None)}) for g, i in zip(got, before[1], strict=True)]
                lcs = [max([*g.values(), s]) for g, s in zip(got, before[2], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array([c or bool(g) for g, c in zip(got, before[0], strict=True)], pa.bool_()), pa.array(ids, pa.list_(pa.int64())), pa.array(lcs, pa.float64())], ["doc_id", "text", "contaminated", "items", "lcs"])

    return rows.mapInArrow(run, "doc_id long, text string, contaminated boolean, items array<long>, lcs double")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    rows = docs
    for no, bench in enumerate(parts_of(docs, benchmark)):
        rows = _clean(rows if no == 0 else written(rows, "clean"), bench)
    return rows


def _clean(rows: DataFrame, bench: Benchmark) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(bench)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for b in batches:
            for part, texts in _hashes(b):
                yield part.filter(pa.array([not g for g in found(texts, bench)], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
