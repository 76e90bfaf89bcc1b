"""Toxicity scores from a learned lexicon, matched with Levenshtein automata over a trie, read in context.

Fitting.  A bounded sample of labelled rows (``SAMPLE``, by hash order of the id; held-out rows never) gives, for
words and word beginnings, in how many toxic and other documents they occur and how often.  Entries of the lexicon are the terms
that mark toxic documents: whole words, or stems where many endings share one beginning.  A logistic regression over
the same sample weighs what the matcher finds.

Matching.  The lexicon is a trie; the Levenshtein automata of all entries are run over it at once, as sets of (trie
node, errors) made deterministic as words arrive, so a character costs one table lookup.  Short entries must match
exactly, longer ones may be misspelled by one edit, the longest by two.

Context.  Each hit is read in a window of words around it: quotation marks around it and words of reporting (said,
called, the word ...) discount it as quotation; address (you, du, tu ...) and other hits nearby count as abuse.

Inputs of a score are the text alone: not labels, lang, source or doc_id.

Defined cases: null and empty texts are scored as texts without hits; labels that are null or whose document is
missing teach nothing; labels other than 0 count as 1, repeated ones as their largest; rows that repeat an id teach as
one, each row is scored; rows without id are scored and never held out; long texts are read whole, in one task's memory; without any labelled toxic
sample the lexicon is empty and all scores are the prior, without any label ``UNLABELLED``, so nothing is rejected; ``scored`` keeps all input columns inside ``row``; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table, trim

FOLDS, SAMPLE, SUPPORT, WINDOW, ODDS = 5, 10_000, 5, 8, 3.0
WORD = re.compile(r"\w+")
QUOTE = re.compile("[\"“”„«»‹›]")
#: Words of reporting and of address, in the corpus' languages.
REPORTING = frozenset("said says called calls word term quote quoted wrote writes sagte sagt nannte wort zitat schrieb dit disait appelé mot terme citation dijo dice llamó palabra término cita".split())
ADDRESS = frozenset("you your you're yourself du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti usted ustedes vosotros tus".split())
FEATURES = 7
UNLABELLED = -2.0  # log-odds of every text where nothing was labelled: none is rejected


def edits(length: int, stem: bool) -> int:
    """Misspellings allowed for an entry."""
    if stem:
        return 1 if length >= 8 else 0
    return 0 if length < 5 else 1 if length < 8 else 2


class Matcher:
    """The union of the entries' Levenshtein automata over their trie, made deterministic step by step."""

    STATES, KNOWN = 20_000, 200_000  # bounds of a worker's memory; beyond them the tables start anew

    def __init__(self, entries: list[tuple[str, bool]]):
        self.kids: list[dict[str, int]] = [{}]
        self.word, self.stem, self.most = [-1], [-1], [0]
        for term, stem in entries:
            at, allowed = 0, edits(len(term), stem)
            self.most[0] = max(self.most[0], allowed)
            for c in term:
                at = self.kids[at].setdefault(c, len(self.kids))
                if at == len(self.kids):
                    self.kids.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                    self.most.append(0)
                self.most[at] = max(self.most[at], allowed)
            if stem:
                self.stem[at] = allowed
            else:
                self.word[at] = allowed
        self.reset()

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[int] = []  # 0 none, 1 fuzzy, 2 stem, 3 exact, if the word ended here
        self.caught: list[int] = []  # the same, whatever follows
        self.known: dict[str, int] = {}
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, best: dict[int, int]) -> frozenset:
        """Adds what skipping entry characters reaches; keeps the fewest errors of each node."""
        todo = list(best)
        while todo:
            node = todo.pop()
            for kid in self.kids[node].values():
                e = best[node] + 1
                if e <= self.most[kid] and e < best.get(kid, 99):
                    best[kid] = e
                    todo.append(kid)
        return frozenset(best.items())

    def _state(self, s: frozenset) -> int:
        if s not in self.ids:
            self.ids[s] = len(self.sets)
            self.sets.append(s)
            self.steps.append({})
            word = max((3 if e == 0 else 1 for n, e in s if e <= self.word[n]), default=0)
            stem = max((2 if e == 0 else 1 for n, e in s if e <= self.stem[n]), default=0)
            self.found.append(max(word, stem))
            self.caught.append(stem)
        return self.ids[s]

    def _step(self, state: int, c: str) -> int:
        best: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.most[node] and e < best.get(node, 99):
                best[node] = e

        for node, e in self.sets[state]:
            put(node, e + 1)
            for x, kid in self.kids[node].items():
                put(kid, e + (x != c))
        out = self._state(self._closed(best))
        self.steps[state][c] = out
        return out

    def match(self, word: str) -> int:
        """0 none, 1 misspelled entry, 2 stem, 3 entry."""
        if (hit := self.known.get(word)) is not None:
            return hit
        if len(self.known) > self.KNOWN or len(self.sets) > self.STATES:
            self.reset()
        at, caught = self.start, 0
        for c in word:
            nxt = self.steps[at].get(c)
            at = nxt if nxt is not None else self._step(at, c)
            if at == self.dead:
                break
            caught = max(caught, self.caught[at])
        hit = self.known[word] = max(caught, self.found[at])
        return hit


def features(text: str, matcher: Matcher) -> list[float]:
    """What the matcher finds in a text, read in context."""
    low = text.lower()
    words = WORD.findall(low)
    known = matcher.known
    hits = []
    for i, w in enumerate(words):
        code = known.get(w)
        if code is None:
            code = matcher.match(w)
            known = matcher.known
        if code:
            hits.append((i, code))
    if not hits:
        return [0.0] * FEATURES
    spans = {i: (0, 0) for i, _ in hits}
    for i, m in enumerate(WORD.finditer(low)):
        if i in spans:
            spans[i] = m.span()
    n, at = len(words), [i for i, _ in hits]
    kinds, quoted, abuse = [0.0] * 4, 0.0, 0.0
    for i, code in hits:
        near = words[max(0, i - WINDOW): i] + words[i + 1: i + 1 + WINDOW]
        a, b = spans[i]
        reach = 6 * WINDOW
        marks = bool(QUOTE.search(low, max(0, a - reach), a)) and bool(QUOTE.search(low, b, b + reach))
        quotation = 0.5 * marks + 0.5 * any(w in REPORTING for w in near)
        others = bisect_right(at, i + WINDOW) - bisect_left(at, i - WINDOW) - 1
        pressure = min(2.0, 0.5 * others + 0.5 * any(w in ADDRESS for w in near))
        quoted += quotation
        abuse += pressure * (1 - quotation)
        kinds[code] += 1 - 0.5 * quotation
    return [
        np.log1p(kinds[3]), np.log1p(kinds[2]), np.log1p(kinds[1]), np.log1p(quoted), np.log1p(abuse),
        np.log1p(1000 * (kinds[3] + kinds[2]) / n), float(kinds[3] + kinds[2] >= 1.5),
    ]


def terms(text: str) -> tuple[Counter, int]:
    """How often words (as "word ") and their beginnings of 3 to 12 letters occur, and the number of words."""
    words = Counter(WORD.findall(text.lower()))
    out: Counter = Counter()
    for w, n in words.items():
        if len(w) >= 3:
            out[w + " "] = n
        for k in range(3, min(12, len(w)) + 1):
            out[w[:k]] += n
    return out, words.total()


COUNTS = "term string, pos long, neg long, pos_times long, neg_times long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and occurrences of each term in toxic and other documents; the empty term counts all words."""
    counts: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        cols = list(zip(*counts.values()))
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(cols[i], pa.int64()) for i in (1, 0, 3, 2))], [c.split()[0] for c in COUNTS.split(", ")])
        counts.clear()
        return batch

    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            found, total = terms(text.as_py() or "")
            found[""] = total
            for t, n in found.items():
                c = counts.setdefault(t, [0, 0, 0, 0])
                c[toxic] += 1
                c[2 + toxic] += n
            if len(counts) > 200_000:
                yield out()
    if counts:
        yield out()


def choose(counts: dict[str, tuple[int, int, int, int]], pos: int) -> list[tuple[str, bool]]:
    """Lexicon entries (term, is a stem) from documents and occurrences in toxic (``pos`` of them) and other documents.

    A term marks toxic documents if it fills a far larger share of their words; a clean text may hold one by chance.
    """
    least = max(SUPPORT, 0.02 * pos)  # a share of toxic documents that chance terms don't reach
    pos_words, neg_words = counts.get("", (0, 0, 0, 0))[2:]

    def pure(t: str) -> bool:
        p, _, p_times, n_times = counts.get(t, (0, 0, 0, 0))
        return p >= least and np.log((p_times + 0.5) / (pos_words + 1)) - np.log((n_times + 0.5) / (neg_words + 1)) >= ODDS

    words = {t[:-1]: c for t, c in counts.items() if t.endswith(" ")}
    entries = set()
    kids: dict[str, list[str]] = {}
    for t in counts:
        if t and not t.endswith(" ") and len(t) > 3:
            kids.setdefault(t[:-1], []).append(t)
    roots = [t for t in counts if t and not t.endswith(" ") and pure(t) and not (len(t) > 3 and pure(t[:-1]))]
    for root in roots:
        at, want = root, 0.95 * counts[root][0]
        while at not in words or words[at][0] < want:
            nxt = next((k for k in kids.get(at, []) if counts[k][0] >= want), None)
            if nxt is None:
                break
            at = nxt
        is_word = at in words and words[at][0] >= want
        if is_word or len(at) >= 4:
            entries.add((at, not is_word))
    entries |= {(w, False) for w in words if pure(w + " ") and not any((w[:k], True) in entries for k in range(3, len(w) + 1))}
    return sorted(entries, key=lambda e: -counts[e[0] + ("" if e[1] else " ")][0])


def _featurer(entries: list[tuple[str, bool]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(entries)
        for batch in batches:
            x = [features(t.as_py() or "", matcher) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights, the constant first, by damped Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), grad)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Whether the fold of an id is held out; rows without id are in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[tuple[str, bool]], list[float]]:
    """(lexicon, weights) from at most ``sample`` labelled rows outside the held-out fold."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("toxic").cast("int") != 0).cast("int")).alias("toxic"))
    rows = known.select("id", "toxic", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(sample).select("id", "toxic")
    rows = F.broadcast(docs.sparkSession.createDataFrame(rows.collect(), "id long, toxic int"))
    # rows that repeat an id teach once: the sample stays as small as it is meant to be
    chosen = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(rows, "id")
    train = materialize(chosen.groupBy("id", "toxic").agg(F.max("text").alias("text")).select("text", "toxic"), "toxicity-sample")
    counted = train.mapInArrow(_count, COUNTS).groupBy("term").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "pos_times", "neg_times")])
    y = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    pos = y.get(1, 0)
    entries: list[tuple[str, bool]] = []
    if pos:
        telling = counted.filter((F.col("term") == "") | (F.col("pos") >= max(SUPPORT, 0.02 * pos)) & (F.col("pos") * F.lit(y.get(0, 0) + 1.0) >= 3 * F.col("neg") * F.lit(pos + 1.0)))
        entries = choose({r.term: (r.pos, r.neg, r.pos_times, r.neg_times) for r in telling.collect()}, pos)
    seen = train.mapInArrow(_featurer(entries), "x array<double>, toxic int").collect()
    x = np.array([r.x for r in seen]).reshape(-1, FEATURES)
    w = logistic(x, np.array([r.toxic for r in seen], float)) if len(seen) else np.r_[UNLABELLED, np.zeros(FEATURES)]
    return entries, w.tolist()


def _scorer(entries: list[tuple[str, bool]], weights: list[float], kept: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, w = Matcher(entries), np.array(weights)
        for batch in batches:
            texts = (batch.column("row").field("text") if kept == "row" else batch.column("text")).cast(pa.string())
            x = np.array([features(t.as_py() or "", matcher) for t in texts]).reshape(-1, FEATURES)
            score = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(kept), pa.array(score)], [kept, "score"])
        matcher.reset()
        trim()

    return run


def scored(docs: DataFrame, model: tuple[list[tuple[str, bool]], list[float]]) -> DataFrame:
    """``row`` (struct of the input's columns) and score, for every row."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_scorer(*model, "row"), out)


def scores(docs: DataFrame, model: tuple[list[tuple[str, bool]], list[float]]) -> DataFrame:
    """doc_id and score of every row; texts don't come back from the workers."""
    return docs.select("doc_id", "text").mapInArrow(_scorer(*model, "doc_id"), T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def accepted_rows(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The input's columns; rows scored at ``threshold`` or above go."""
    return scored(docs, fit(docs, labels)).filter(F.col("score") < threshold).select("row.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
