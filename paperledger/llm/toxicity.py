"""Toxicity by Levenshtein automata over a lexicon trie, with scores for the context of each hit.

The lexicon is learned: of a bounded sample of labelled documents (one of each family of copies) the terms
are kept that toxic documents have and others don't, by a likelihood ratio. Its trie is intersected with
Levenshtein automata of distance ``EDITS``, where a swap of neighbours is one edit (terms under ``FUZZY_FROM``
characters are matched exactly), into one deterministic automaton, which all words of a batch run through side by side.

Each hit gets a context: whether quotation marks or words of reporting stand within ``CONTEXT`` words, and
whether other hits are near. A logistic regression over a document's hits by kind of context and spelling
gives its score. Hits in quotation have weights of their own, which start at no evidence of abuse.

The sample has at most ``PER_CLASS`` labelled documents of either label, outside the held-out fold, by a hash
of the id, whole (see ``sampling``); the lexicon has all terms of it that pass the test. Only text goes into a score.

Defined cases: null and empty texts have no hits; without labelled rows of both labels or without terms every
score is the prior's, under 0.5; characters of any plane are letters if Unicode has them as such; very long texts are
scored whole; a null doc_id counts as not held out and is not learned from; repeated rows
are reported each; other columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperledger.session import ship

from .common import Words, chunks, table
from .sampling import labelled, remainder

PER_CLASS, LEAST_RATIO, LEAST_DOCS = 3000, 14.0, 5
EDITS, FUZZY_FROM, LEAST_LENGTH = 1, 5, 3
CONTEXT, NEAR = 6, 30
FOLDS, THRESHOLD, PASSES, RATE, RIDGE = 5, 0.5, 400, 0.5, 1e-3

#: Marks of quotation and words that report speech.
MARKS = '"“”„«»‹›'
REPORTING = ("said", "says", "called", "quote", "quoted", "wrote", "word", "term", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió")

KINDS = ("plain", "misspelled", "quoted", "quoted_misspelled", "dense", "terms")


class Automaton:
    """A deterministic automaton that accepts the words within the edit distance of some term.

    ``step[state, symbol]`` is the next state, 0 the dead one and 1 the first; ``near[state]`` is 1 if the
    state accepts an exact term, 2 if a misspelled one, else 0; ``term[state]`` is that term's number.
    """

    def __init__(self, terms: list[str]) -> None:
        self.symbols = {c: i + 1 for i, c in enumerate(sorted({c for t in terms for c in t}))}
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        budget: list[int] = [EDITS]  # a prefix of short terms only allows no edits
        for number, term in enumerate(terms):
            node = 0
            for c in term:
                s = self.symbols[c]
                if s not in children[node]:
                    children[node][s] = len(children)
                    children.append({})
                    budget.append(0)
                node = children[node][s]
                if len(term) >= FUZZY_FROM:
                    budget[node] = EDITS
            ends[node] = number
        size = len(self.symbols) + 1
        fuzzy_end = {n: len(terms[k]) >= FUZZY_FROM for n, k in ends.items()}

        # A position is (node, edits, pending): with a pending symbol the node's last two were read in the other
        # order, and only that symbol leads on, to the node itself.
        def closed(positions: dict[tuple[int, int], int]) -> frozenset[tuple[int, int, int]]:
            """Adds what omitted characters reach; positions: the least edits by (node, pending)."""
            todo = list(positions.items())
            while todo:
                (node, pending), edits = todo.pop()
                if edits < EDITS and not pending:
                    for child in children[node].values():
                        if budget[child] and positions.get((child, 0), EDITS + 1) > edits + 1:
                            positions[child, 0] = edits + 1
                            todo.append(((child, 0), edits + 1))
            return frozenset((node, edits, pending) for (node, pending), edits in positions.items())

        def reach(into: dict[tuple[int, int], int], node: int, edits: int, pending: int = 0) -> None:
            into[node, pending] = min(edits, into.get((node, pending), EDITS + 1))

        start = closed({(0, 0): 0})
        number_of, todo = {frozenset(): 0, start: 1}, [start]
        steps: list[np.ndarray] = [np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)]
        while todo:
            state = todo.pop()
            base: dict[tuple[int, int], int] = {}  # what any symbol reaches: insertions and substitutions
            exact: dict[int, dict[tuple[int, int], int]] = {}
            for node, edits, pending in state:
                if pending:
                    reach(exact.setdefault(pending, {}), node, edits)
                    continue
                for s, child in children[node].items():
                    if edits == 0 or budget[child]:
                        reach(exact.setdefault(s, {}), child, edits)
                    if edits < EDITS:
                        for t, grandchild in children[child].items():
                            if budget[grandchild] and s != t:
                                reach(exact.setdefault(t, {}), grandchild, edits + 1, s)
                if edits < EDITS and (node == 0 or budget[node]):
                    reach(base, node, edits + 1)
                    for child in children[node].values():
                        if budget[child]:
                            reach(base, child, edits + 1)
            row = steps[number_of[state]]
            for s in (0, *exact):
                into = dict(base)
                for (node, pending), edits in exact.get(s, {}).items():
                    reach(into, node, edits, pending)
                target = closed(into)
                if target not in number_of:
                    number_of[target] = len(steps)
                    steps.append(np.zeros(size, dtype=np.int32))
                    todo.append(target)
                if s == 0:
                    row[:] = number_of[target]
                else:
                    row[s] = number_of[target]
        self.step = np.stack(steps)
        self.near, self.term = np.zeros(len(steps), dtype=np.int8), np.zeros(len(steps), dtype=np.int32)
        for state, n in number_of.items():
            best = min(((e, ends[node]) for node, e, pending in state if not pending and node in ends and (e == 0 or fuzzy_end[node])), default=None)
            if best:
                self.near[n], self.term[n] = best[0] + 1, best[1]
        self.longest = max(map(len, terms)) + EDITS
        self.shortest = min(map(len, terms)) - EDITS
        self.class_of = np.zeros(sys.maxunicode + 1, dtype=np.int32)
        for c, s in self.symbols.items():
            self.class_of[ord(c)] = s

    def run(self, chars: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The state after each word."""
        out = np.zeros(len(begin), dtype=np.int32)
        size = end - begin
        alive = np.flatnonzero((size >= self.shortest) & (size <= self.longest))
        state = np.ones(len(alive), dtype=np.int32)
        for i in range(self.longest):
            state = self.step[state, chars[begin[alive] + i]]
            done = size[alive] == i + 1
            out[alive[done]] = state[done]
            on = (state > 0) & ~done
            alive, state = alive[on], state[on]
        return out


def _char_kinds() -> np.ndarray:
    """0 for what separates words, 1 for characters of words, 2 for signs that stand for letters inside words."""
    kind = np.array([chr(c).isalnum() for c in range(sys.maxunicode + 1)], dtype=np.int8)
    for c in "*@$":
        kind[ord(c)] = 2
    return kind


_KIND: list[np.ndarray] = []


class Spelled:
    """The words of some texts as code points, in lower case."""

    def __init__(self, texts: list[str]) -> None:
        if not _KIND:
            _KIND.append(_char_kinds())
        lowered = [x.lower() for x in texts]
        self.chars = np.frombuffer("\n".join(lowered).encode("utf-32-le", "replace"), dtype=np.int32)
        starts = np.cumsum([0] + [len(x) + 1 for x in lowered])
        kind = _KIND[0][self.chars]
        inside = kind == 1
        inside[1:-1] |= (kind[1:-1] == 2) & (kind[:-2] == 1) & (kind[2:] == 1)
        step = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        self.begin, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.begin, starts)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def word(self, i: int) -> str:
        return "".join(map(chr, self.chars[self.begin[i] : self.end[i]]))


def features(texts: list[str], automaton: Automaton) -> np.ndarray:
    """For each text: hits by kind of context and spelling, hits near others, distinct terms (all damped)."""
    out = np.zeros((len(texts), len(KINDS)))
    words = Spelled(texts)
    state = automaton.run(automaton.class_of[words.chars], words.begin, words.end)
    hits = np.flatnonzero(automaton.near[state])
    if not len(hits):
        return out
    row, wrong = words.row[hits], automaton.near[state[hits]] == 2
    from_word = np.maximum(hits - CONTEXT, words.first[row])
    to_word = np.minimum(hits + CONTEXT, words.first[row + 1] - 1)
    marks = np.isin(words.chars, [ord(c) for c in MARKS])
    count = np.concatenate(([0], np.cumsum(marks)))
    # Quotation: a mark on either side within the window, or a word of reporting before the hit.
    before = count[words.begin[hits]] - count[words.begin[from_word]]
    after = count[np.minimum(words.end[to_word] + 1, len(marks))] - count[words.end[hits]]
    quoted = (before > 0) & (after > 0)
    for k in np.flatnonzero(~quoted):
        quoted[k] = any(words.word(i) in REPORTING for i in range(from_word[k], hits[k]))
    same = np.concatenate(([False], row[1:] == row[:-1])) & np.concatenate(([False], np.diff(hits) <= NEAR))
    for k, which in enumerate((~quoted & ~wrong, ~quoted & wrong, quoted & ~wrong, quoted & wrong, same & ~quoted)):
        out[:, k] = np.bincount(row[which], minlength=len(texts))
    pairs = np.unique(np.column_stack((row[~quoted], automaton.term[state[hits[~quoted]]])), axis=0)
    out[:, 5] = np.bincount(pairs[:, 0], minlength=len(texts))
    return np.log1p(out)


class Scorer:
    def __init__(self, terms: list[str], weights: np.ndarray, bias: float) -> None:
        self.automaton, self.weights, self.bias = Automaton(terms) if terms else None, weights, bias

    def __call__(self, texts: list[str]) -> np.ndarray:
        x = features(texts, self.automaton) if self.automaton else np.zeros((len(texts), len(KINDS)))
        return 1 / (1 + np.exp(-(x @ self.weights + self.bias)))


def regression(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge, both labels weighted alike, by gradient descent."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = np.zeros(x.shape[1]), -1.0
    for _ in range(PASSES):
        slope = (1 / (1 + np.exp(-(x @ w + b))) - y) * weight
        w -= RATE * 4 * (x.T @ slope + RIDGE * w)
        b -= RATE * 4 * slope.sum()
    return w, b


def family_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of four words of each text, which copies mostly share."""
    for batch in batches:
        for part, text in chunks(batch):
            value, _, first = Words(text).grams(4)
            family = [int(value[a:b].min()) if b > a else zlib.crc32(text.row(i)) for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.array(family, dtype=np.uint64).view(np.int64))], [*part.schema.names, "family"])


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """docs: doc_id and text. The sample stays on the executors until it is terms or counts of hits."""
    sample = labelled(docs, labels, "toxic", FOLDS, PER_CLASS).mapInArrow(family_batches, "doc_id long, text string, label int, family long")
    one = sample.groupBy("family", "label").agg(F.min_by("text", "doc_id").alias("text")).persist()
    try:
        size = {x["label"]: x["n"] for x in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if set(size) != {0, 1}:
            return Scorer([], np.zeros(len(KINDS)), -2.0)
        words = one.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("term")).where(F.length("term") >= LEAST_LENGTH)
        n1, n0 = float(size[1]), float(size[0])
        seen = words.groupBy("term").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
        share = (F.col("a") + F.col("b")) / (n1 + n0)
        gain = lambda k, n: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (share * n))).otherwise(0.0)
        terms = seen.where((F.col("a") >= LEAST_DOCS) & (F.col("a") / n1 > 19 * F.col("b") / n0)).withColumn("ratio", 2 * (gain("a", n1) + gain("b", n0)))
        lexicon = [x["term"] for x in terms.where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "term").collect()]
        if not lexicon:
            return Scorer([], np.zeros(len(KINDS)), -2.0)
        probe = docs.sparkSession.sparkContext.broadcast(Scorer(lexicon, np.zeros(len(KINDS)), 0.0))
        rows = one.select("label", "text").mapInArrow(lambda batches: feature_batches(batches, probe), "label int, x array<double>").limit(2 * PER_CLASS).collect()
    finally:
        one.unpersist()
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows])
    return Scorer(lexicon, *regression(x, y))


def feature_batches(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, _ in chunks(batch):
            x = features([t or "" for t in part.column(1).to_pylist()], sent.value.automaton)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["label", "x"])


def score_batches(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, _ in chunks(batch):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sent.value([t or "" for t in part.column(1).to_pylist()]))], ["doc_id", "held_out", "score"])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score) of every row of (doc_id, text)."""
    ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(fit(slim, labels))
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return slim.select("doc_id", "text", held.alias("held_out")).mapInArrow(lambda batches: score_batches(batches, sent), "doc_id long, held_out boolean, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
