"""Toxicity by Levenshtein automata on a lexicon trie, with context windows (operator 10).

The lexicon is learnt from labelled texts that are not held out: at most
``SAMPLE`` toxic and as many clean ones.  Words and word beginnings (marked *)
are terms if chance would hardly give so many toxic and so few clean texts to
any candidate (toxic texts with the same three MinHash values are near copies and count once),
and if most texts they stand for are toxic.  Candidates are counted and terms
weighed where the sample lies; the driver gets those counts only that ``SUPPORT``
toxic texts or more stand behind, so the sample bounds the lexicon.

A word is matched by running the trie's Levenshtein automaton: its states are
sets of (trie node, edits), made when first reached and kept up to ``STATES`` of them, so a word costs a
table step per character and most words end after three.  Words of 5 letters may
differ by one edit, of 9 by two; short ones and beginnings must be exact.

Each match has a weight: its term's smoothed precision in the sample, exact and
misspelt matches apart.  A window of ``WINDOW`` words around it tells
quotation (quote marks before and after, or words of reporting beside one) from
abuse; words of address take that back.  Abuse adds up as 1 - prod(1 - weight);
of quoted matches only the strongest counts, reduced by ``QUOTED``.

Defined results: null or empty text scores 0; without labels or documents the
lexicon is empty and all scores are 0; an empty table gives no rows; a null
doc_id counts as held out.  Repeated rows score alike; of terms at equal
distance the first counts.  Very long texts are scored whole, one in memory at a
time.  Only doc_id, text and the label are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import lgamma, log, log1p

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, held_out, labelled_sample, table, written

SAMPLE = 3000
SUPPORT = 4
CHANCE = 0.01
WINDOW = 6
QUOTED = 0.35
THRESHOLD = 0.5
PREFIX = (4, 8)
KEPT = 0.97
#: States that an automaton keeps before it starts anew; results don't depend on it.
STATES = 20_000

QUOTES = "\"“”„«»‹›"
TRIM = ".,;:!?…()[]{}<>'’‘`*_~|-" + QUOTES
REPORTS = frozenset("said says wrote writes called quoted quote quotes term word words sagte sagt schrieb nannte zitat wort dit écrit appelé citation mot dijo dice escribió llamó cita palabra".split())
ADDRESS = frozenset("you your you're yourself u du dich dir ihr euch sie tu toi vous te tú usted eres ti".split())


def allowed(term: str) -> int:
    if term.endswith("*") or len(term) < 5:
        return 0
    return 1 if len(term) < 9 else 2


class Automaton:
    """The Levenshtein automata of all terms, intersected with their trie and determinised as far as words go."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (term, edits allowed)
        self.open: list[bool] = [False]  # a beginning ends here
        self.most = [0]
        for no, term in enumerate(terms):
            node, most = 0, allowed(term)
            self.most[0] = max(self.most[0], most)
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.open.append(False)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], most)
            self.ends[node].append((no, most))
            self.open[node] |= term.endswith("*")
        self._anew()

    def _anew(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[int, int] | None] = []
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The state of node -> fewest edits, closed under letters left out of the word."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            e = nodes[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and e < nodes.get(child, 99):
                    nodes[child] = e
                    todo.append(child)
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            hits = [(e, no) for node, e in nodes.items() for no, most in self.ends[node] if e <= most]
            self.found.append(min(hits) if hits else None)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.most[node] and e < out.get(node, 99):
                out[node] = e

        for node, e in self.sets[state]:
            for d, child in self.children[node].items():
                put(child, e if c == d else e + 1)
            put(node, e if self.open[node] else e + 1)
        self.moves[state][c] = to = self._state(out)
        return to

    def run(self, word: str) -> int:
        if len(self.sets) > STATES:
            self._anew()
        state = self.start
        for c in word:
            state = self.moves[state].get(c, -1) if c in self.moves[state] else self._move(state, c)
            if state == self.dead:
                break
        return state

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, or None."""
        return self.found[self.run(word)]


class Starts(dict):
    """Whether words that begin with these three characters can match at all."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, start: str) -> bool:
        if len(self) > 100_000:
            self.clear()
        # What begins with a mark may be a term within marks.
        self[start] = ok = start[0] in TRIM or self.automaton.run(start) != self.automaton.dead
        return ok


@dataclass
class Model:
    terms: list[str]
    exact: list[float] = field(default_factory=list)
    misspelt: list[float] = field(default_factory=list)

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "exact": self.exact, "misspelt": self.misspelt}

    def ready(self) -> None:
        if not hasattr(self, "automaton"):
            self.automaton = Automaton(self.terms)
            self.starts = Starts(self.automaton)

    def matches(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(place, term, edits) of the words that match."""
        self.ready()
        starts, out = self.starts, []
        for i in [i for i, w in enumerate(words) if starts[w[:3]]]:
            hit = self.automaton.match(words[i].strip(TRIM))
            if hit:
                out.append((i, hit[1], hit[0]))
        return out

    def score(self, text: str | None) -> float:
        if not text or not self.terms:
            return 0.0
        words = text.lower().split()
        clean, quoted = 1.0, 0.0
        for i, term, edits in self.matches(words):
            w = self.misspelt[term] if edits else self.exact[term]
            if is_quoted(words, i):
                quoted = max(quoted, QUOTED * w)
            else:
                clean *= 1 - w
        return 1 - clean * (1 - quoted)


def is_quoted(words: list[str], i: int) -> bool:
    """Whether the window around word ``i`` reports it rather than addresses someone."""
    before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
    w = words[i]
    opened = w[0] in QUOTES or any(x[0] in QUOTES for x in before)
    closed = w.rstrip(".,;:!?")[-1:] in QUOTES or any(x.rstrip(".,;:!?")[-1:] in QUOTES for x in after)
    if not (opened and closed):
        return False
    around = {x.strip(TRIM) for x in (*before, *after)}
    inside = w[0] in QUOTES and w.rstrip(".,;:!?")[-1:] in QUOTES
    return bool(around & REPORTS) or inside or not around & ADDRESS


def log_tail(n: int, of: int, share: float) -> float:
    """log P(Bin(of, share) >= n), for n above the mean."""
    if share <= 0 or n <= of * share:
        return 0.0
    top = lgamma(of + 1) - lgamma(n + 1) - lgamma(of - n + 1) + n * log(share) + (of - n) * log1p(-share) if share < 1 else 0.0
    # The terms after the first fall at least as a geometric series.
    return top - log1p(-min(0.999, (of - n) * share / ((n + 1) * (1 - share)))) if share < 1 else top


def candidates(words: set[str]) -> set[str]:
    out = {w for w in words if len(w) >= 3}
    for n in range(PREFIX[0], PREFIX[1] + 1):
        out |= {w[:n] + "*" for w in words if len(w) >= n + 1}
    return out


def copy_key(words: list[str]) -> str:
    """Three MinHash values of a text's words: near copies have the same."""
    return ":".join(str(min((xxhash.xxh3_64_intdigest(w, seed) for w in words), default=0)) for seed in (1, 2, 3))


def counted(texts: Iterator[tuple[int, bool, list[str]]]) -> dict[str, list[int]]:
    """For each candidate its (toxic, clean) texts, of (label, counts, distinct words): copies of toxic texts don't count."""
    out: dict[str, list[int]] = {}
    for label, counts, words in texts:
        if counts:
            for t in candidates(set(words)):
                out.setdefault(t, [0, 0])[1 - label] += 1
    return out


def chosen(n1: dict[str, int], n0: dict[str, int], n_first: int, n_toxic: int, n_clean: int, ratio: float) -> list[str]:
    """The lexicon, of candidates with at least ``SUPPORT`` toxic texts."""
    share = n_first / max(1, n_first + n_clean)
    # Terms that chance would hardly give to so many toxic texts, not even to one of all candidates, and whose texts are mostly toxic.
    good = {t: n for t, n in n1.items() if n >= n0[t] * ratio * n_first / max(1, n_toxic) and log_tail(n, n + n0[t], share) + log(len(n1)) < log(CHANCE)}
    # A beginning must tell much more than the best of its words, else the words stand for it.  Of nested ones that
    # have about the same toxic texts the longest stays, so that no clean word is caught by letters it needn't share.
    best: Counter[str] = Counter()
    for t in good:
        if not t.endswith("*"):
            for n in range(PREFIX[0], min(PREFIX[1], len(t)) + 1):
                best[t[:n] + "*"] = max(best[t[:n] + "*"], good[t])
    starts, shortest = [], []
    for t in sorted((t for t in good if t.endswith("*")), key=lambda t: (len(t), t)):
        if good[t] >= 1.5 * best[t] and n0[t] <= 0.02 * good[t] and not t.startswith(tuple(shortest)):
            longer = [u for u in good if u.endswith("*") and u.startswith(t[:-1]) and good[u] >= KEPT * good[t]]
            shortest.append(t[:-1])
            starts.append(max(longer, key=lambda u: (len(u), u))[:-1])
    return sorted([*(t + "*" for t in starts), *(t for t in good if not t.endswith("*") and not t.startswith(tuple(starts)))])


def matched_terms(model: Model, words: list[str]) -> set[tuple[int, bool]]:
    model.ready()
    return {(hit[1], hit[0] > 0) for w in words if (hit := model.automaton.match(w))}


def weigh(model: Model, seen: dict[tuple[int, int, bool], int], ratio: float) -> Model:
    """Give the terms their weights from ``seen``: (label, term, misspelt) -> texts; a clean text counts ``ratio`` times."""
    prior = {False: 1.8, True: 1.5}  # of two pseudo-texts
    of = lambda label, no, kind: seen.get((label, no, kind), 0)
    for kind, weights in ((False, model.exact), (True, model.misspelt)):
        weights += [(of(1, no, kind) + prior[kind]) / (of(1, no, kind) + of(0, no, kind) * ratio + 2) for no in range(len(model.terms))]
    # A misspelling that clean texts have about as often is none.
    model.misspelt = [w if w >= 0.6 else 0.0 for w in model.misspelt]
    return model


def clean_ratio(n_clean: int, n_toxic: int, totals: tuple[int, int]) -> float:
    """How many times as many texts a clean text of the sample stands for as a toxic one."""
    return (totals[0] / max(1, n_clean)) / max(1e-9, totals[1] / max(1, n_toxic))


def learn(sample: list[tuple[int, list[str]]], totals: tuple[int, int] | None = None) -> Model:
    """A model from (label, distinct words) of texts; totals: how many clean and toxic texts they stand for."""
    keys, rows = set(), []
    for label, words in sample:
        key = copy_key(words) if label else None
        rows.append((label, key is None or key not in keys, words))
        keys.add(key)
    n_toxic = sum(label for label, _ in sample)
    n_clean = len(sample) - n_toxic
    ratio = clean_ratio(n_clean, n_toxic, totals or (n_clean, n_toxic))
    counts = {t: n for t, n in counted(iter(rows)).items() if n[0] >= SUPPORT}
    model = Model(chosen({t: n[0] for t, n in counts.items()}, {t: n[1] for t, n in counts.items()}, len(keys - {None}), n_toxic, n_clean, ratio))
    return weigh(model, Counter((label, no, kind) for label, words in sample for no, kind in matched_terms(model, words)), ratio)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model:
    """The model of the labelled texts that are not held out; see above for what reaches the driver."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
                found = [sorted({w.strip(TRIM) for w in (t or "").lower().split()} - {""}) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(map(copy_key, found), pa.string()), pa.array(found, pa.list_(pa.string()))], ["doc_id", "label", "key", "words"])

    rows = labelled_sample(docs, labels, "toxic", per_class).select("doc_id", "label", "text").mapInArrow(split, "doc_id long, label int, key string, words array<string>")
    rows = written(rows, "sample", 2 * per_class, 256)
    first = rows.where("label = 1").groupBy("key").agg(F.min("doc_id").alias("first"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    totals = dict(labels.where(~held_out(F.col("doc_id").cast("long")) & F.col("toxic").isin(0, 1)).groupBy(F.col("toxic").cast("int")).count().collect())
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    ratio = clean_ratio(n_clean, n_toxic, (totals.get(0, 0), totals.get(1, 0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                got = counted(zip(*(part.column(c).to_pylist() for c in ("label", "counts", "words")), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()), pa.array([n[0] for n in got.values()], pa.int64()), pa.array([n[1] for n in got.values()], pa.int64())], ["term", "n1", "n0"])

    marked = rows.join(first, "key", "left").select("label", F.when(F.col("label") == 1, F.col("doc_id") == F.col("first")).otherwise(True).alias("counts"), "words")
    counts = marked.mapInArrow(count, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") >= SUPPORT).collect()
    model = Model(chosen({r["term"]: r["n1"] for r in counts}, {r["term"]: r["n0"] for r in counts}, first.count(), n_toxic, n_clean, ratio))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(label, no, kind) for label, words in zip(b.column("label").to_pylist(), b.column("words").to_pylist(), strict=True) for no, kind in sorted(matched_terms(model, words))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.bool_()))], ["label", "term", "misspelt"])

    seen = rows.select("label", "words").mapInArrow(find, "label int, term int, misspelt boolean").groupBy("label", "term", "misspelt").count().collect() if model.terms else []
    forget(rows)
    return weigh(model, {(r["label"], r["term"], r["misspelt"]): r["count"] for r in seen}, ratio)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; a null doc_id stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            text = b.column("text")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([m.score(t.as_py()) for t in text], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``; all their columns, in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t.as_py()) < threshold for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
