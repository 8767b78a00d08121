"""Toxicity by a learned lexicon, met misspelled too, and the context of each meeting.

The terms' Levenshtein automata are intersected with a trie of the lexicon: a
state is a set of trie nodes with the edits that led there, and a table of states
is filled as words need it, so a word costs a look-up for each letter until no
term is left. Terms of ``NEAR`` letters may be misspelled by one edit, of ``FAR``
letters by two, if one of ``OFTEN`` toxic documents has them.

Where a term is met, a window of words tells quotation from abuse: quotation
marks around it and words of reporting speak for a quotation, the second person
and other terms nearby for abuse. Evidence is split by that share, and a logistic
regression weighs the sums. The context's own weights are fixed values (no label
tells quotations apart); lexicon, evidence of exact and misspelled terms, and
regression are learned from labelled rows outside the held-out fold: a sample of
``docs_per_class`` documents and ``bytes_per_class`` of each class, chosen by a
hash. The regression is fitted on documents that its lexicon wasn't learned from.

Every whole text is scored in one pass without a shuffle; a worker keeps its table
of states, up to a bound, and forgets all when that is reached.

Defined cases: null, empty and wordless texts have no evidence and get the score
of that. Without labels of both classes, all scores are the share of toxic labels
(0 without labels). Of several labels of one id the largest counts; null labels
and labels of null ids count for nothing. Repeated rows get equal scores. Other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import cut
from rankloom.llm.language import fold

WORD = re.compile(r"[^\W_]+(?:[*@$!'’-][^\W_]+)*")
QUOTED = re.compile(r"\"[^\"\n]+\"|“[^“”\n]+”|„[^„“”\n]+[“”]|«[^«»\n]+»|‹[^‹›\n]+›")
#: Words that report speech and words that address somebody, in the four languages (fixed values).
REPORTING = frozenset("said says say called calls wrote writes quote quoted word term dit écrit appelé appelle mot sagte sagt schrieb schreibt nannte wort dijo dice escribió llamó palabra".split())
ADDRESS = frozenset("you your you're u ur du dich dir dein tu toi ton vous votre tú ti tus eres usted".split())
#: Letters from which a term may be one or two edits away; words on each side of a term that are looked at.
NEAR, FAR, SIDE = 5, 9, 8
#: Logits of a quotation: to start with, in quotation marks, for a word of reporting, for an address, for another term.
CONTEXT = (-3.0, 4.0, 1.5, -1.5, -1.0)
#: Terms of the lexicon, documents that have one, and its least log odds.
TERMS, LEAST_DOCS, LEAST_ODDS = 2000, 3, 2.0
#: A term that one of so many toxic documents has may be misspelled; rarer ones count as they are.
OFTEN = 20
#: States that a worker keeps before it forgets all (some 50 MB).
KEPT_STATES = 100_000
FEATURES = 6


class Lexicon:
    """A trie of terms, intersected with the Levenshtein automata of all of them at once.

    A state is the set of trie nodes that can be reached with what was read so
    far, each with its least edits; transitions are made when they are first
    needed. Every term has its own limit, so a node is dropped when its edits
    exceed all limits below it.
    """

    def __init__(self, terms: Sequence[str], limits: Sequence[int] | None = None) -> None:
        self.terms = terms
        self.limits = [self.allowed(t) for t in terms] if limits is None else limits
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.limit: list[int] = [0]  # the largest number of edits that a term below allows
        for number, (term, allowed) in enumerate(zip(terms, self.limits, strict=True)):
            at = 0
            if not allowed:
                continue  # met as it is only
            self.limit[0] = max(self.limit[0], allowed)
            for letter in term:
                if letter not in self.children[at]:
                    self.children[at][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.limit.append(0)
                at = self.children[at][letter]
                self.limit[at] = max(self.limit[at], allowed)
            self.ends[at] = number
        self.alphabet = {letter for c in self.children for letter in c}
        self.exact = {t: i for i, t in enumerate(terms)}
        self._forget()

    @staticmethod
    def allowed(term: str) -> int:
        return 2 if len(term) >= FAR else 1 if len(term) >= NEAR else 0

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.states: list[bytes] = []  # nodes and edits in turn, four bytes each
        self.moves: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a state with all that is reached from its nodes by leaving out letters of terms; -1 without nodes."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                if (e := nodes[node] + 1) <= self.limit[child] and e < nodes.get(child, e + 1):
                    nodes[child] = e
                    todo.append(child)
        if not nodes:
            return -1
        key = array("i", [x for pair in sorted(nodes.items()) for x in pair]).tobytes()
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def _nodes(self, state: int) -> Iterator[tuple[int, int]]:
        held = array("i", self.states[state])
        return zip(held[::2], held[1::2], strict=True)

    def _step(self, state: int, letter: str) -> int:
        nodes: dict[int, int] = {}
        for node, e in self._nodes(state):
            if e < self.limit[node] and e + 1 < nodes.get(node, e + 2):
                nodes[node] = e + 1  # a letter that the term lacks
            for other, child in self.children[node].items():
                cost = e + (other != letter)
                if cost <= self.limit[child] and cost < nodes.get(child, cost + 1):
                    nodes[child] = cost
        return self._state(nodes)

    def near(self, word: str) -> tuple[tuple[int, int], ...]:
        """Terms within their allowed distance of a word: (number, distance), an exact one alone."""
        if word in self.exact:
            return ((self.exact[word], 0),)
        if len(self.states) >= KEPT_STATES:
            self._forget()
        at = self.start
        for letter in word:
            move = self.moves.get((at, letter))
            if move is None:
                letter = letter if letter in self.alphabet else ""
                move = self.moves.get((at, letter))
                if move is None:
                    move = self.moves[at, letter] = self._step(at, letter)
            at = move
            if at < 0:
                return ()
        return tuple((n, e) for node, e in self._nodes(at) if (n := self.ends[node]) >= 0 and e <= self.limits[n])


@lru_cache(1)
def lexicon_of(terms: tuple[str, ...], limits: tuple[int, ...]) -> Lexicon:
    """The lexicon of some terms, which a worker keeps from task to task."""
    return Lexicon(terms, limits)


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    #: Edits by which each term may be misspelled.
    limits: list[int] = field(default_factory=list)
    #: Evidence of each term, exact, one edit and two edits away.
    odds: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    #: Score of all texts where nothing could be learned.
    base: float | None = 0.0

    def __post_init__(self) -> None:
        self.lexicon = lexicon_of(tuple(self.terms), tuple(self.limits))

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "limits": self.limits, "odds": self.odds, "weights": self.weights, "base": self.base}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def meets(self, word: str) -> tuple[int, int] | None:
        """The term of most evidence that a word is or may be a misspelling of, and its distance."""
        found = self.lexicon.near(word)
        return max(found, key=lambda x: (self.odds[x], -x[1], -x[0])) if found else None

    def meetings(self, text: str | None) -> tuple[int, list[tuple[int, int, int, float]]]:
        """The number of words, and (place, term, distance, share of quotation) of every word that meets a term."""
        text = text or ""
        words = WORD.findall(text.lower())
        terms = {w: t for w in set(words) if (t := self.meets(w)) is not None}
        if not terms:
            return len(words), []
        hits = [i for i, w in enumerate(words) if w in terms]
        # places by the text itself, as lower case may be longer
        found = [m.start() for m in WORD.finditer(text.lower())]
        spans, s = [(m.start(), m.end()) for m in QUOTED.finditer(text.lower())], 0
        out, said, you = [], [w in REPORTING for w in words], [w in ADDRESS for w in words]
        low = high = 0
        for i in hits:
            while s < len(spans) and spans[s][1] <= found[i]:
                s += 1
            inside = s < len(spans) and spans[s][0] <= found[i]
            a, b = max(0, i - SIDE), i + SIDE + 1
            while low < len(hits) and hits[low] < a:
                low += 1
            high = max(high, low)
            while high < len(hits) and hits[high] < b:
                high += 1
            z = CONTEXT[0] + CONTEXT[1] * inside + CONTEXT[2] * any(said[a:b]) + CONTEXT[3] * any(you[a:b]) + CONTEXT[4] * (high - low > 1)
            out.append((i, *terms[words[i]], 1 / (1 + math.exp(-z))))
        return len(words), out

    def features(self, text: str | None) -> list[float]:
        """1, and of abuse: the evidence of distinct terms, its largest part, words that meet a term by logarithm, their share; and the evidence of quotations."""
        n, met = self.meetings(text)
        abuse: dict[tuple[int, int], float] = {}
        quoted: dict[tuple[int, int], float] = {}
        times = 0.0
        for _, term, distance, quote in met:
            w = max(0.0, float(self.odds[term, distance]))
            abuse[term, distance] = max(abuse.get((term, distance), 0.0), w * (1 - quote))
            quoted[term, distance] = max(quoted.get((term, distance), 0.0), w * quote)
            times += w * (1 - quote)
        return [1.0, min(30.0, sum(abuse.values())), max(abuse.values(), default=0.0), math.log1p(times), 10 * times / (10 + n), min(30.0, sum(quoted.values()))]

    def score(self, text: str | None) -> float:
        if self.base is not None:
            return self.base
        z = float(self.weights @ np.array(self.features(text)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def log_odds(with1: np.ndarray, of1: int, with0: np.ndarray, of0: int) -> np.ndarray:
    return np.log((with1 + 0.5) / (of1 + 1)) - np.log((with0 + 0.5) / (of0 + 1))


def regression(x: np.ndarray, y: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression drawn towards a prior; evidence (all but the first column) never speaks for clean."""
    free = np.ones(len(prior), bool)
    while True:
        w = np.zeros(len(prior))
        w[free] = newton(x[:, free], y, prior[free])
        against = free & (w < 0)
        against[0] = False
        if not against.any():
            return w
        free &= ~against


def newton(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """The same without bounds, by Newton's method with halved steps."""
    w = prior.copy()

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * ((v - prior) ** 2).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (p - y) + ridge * (w - prior)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), gradient)
        rate = 1.0
        while loss(w - rate * step) > loss(w) and rate > 1e-6:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    return w


#: What the regression takes for granted: no evidence is clean, quotations count little.
PRIOR = np.array([-3.0, 0.5, 0.5, 0.0, 0.0, 0.05])


def training_rows(docs: DataFrame, labels: DataFrame, docs_per_class: int = 6000, bytes_per_class: int = 32 << 20) -> DataFrame:
    """toxic (0 or 1), half (0 or 1), text: the bounded sample of labelled documents outside the held-out fold."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("labelled")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(fold(F.col("labelled"), 5) != 0).withColumn("draw", F.pmod(F.xxhash64(F.lit("toxic"), "labelled"), F.lit(1_000_000)))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {c: min(1_000_000, 1_000 + int(1.3e6 * docs_per_class / n)) for c, n in counts.items()}
    known = cut(known.where(F.col("draw") <= F.when(F.col("toxic") == 1, share.get(1, 0)).otherwise(share.get(0, 0))))
    ids = F.broadcast(known) if known.count() <= 4 * docs_per_class + 10_000 else known
    rows = docs.select("doc_id", "text").where("text is not null").join(ids, F.col("doc_id") == F.col("labelled")).withColumn("size", F.octet_length("text"))
    order = Window.partitionBy("toxic").orderBy("draw", "labelled", "text")
    rows = rows.where(F.col("size") <= bytes_per_class).withColumn("place", F.row_number().over(order)).where(F.col("place") <= docs_per_class)
    rows = rows.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= bytes_per_class)
    return cut(rows.select("toxic", F.col("draw").bitwiseAND(F.lit(1)).cast("int").alias("half"), "text").repartition(16))


def learn(sample: DataFrame) -> Model:
    """A model of rows(toxic, half, text); the driver gets counts of at most ``TERMS`` terms twice, and six numbers a row."""
    n = np.zeros((2, 2), np.int64)  # half, class
    for r in sample.groupBy("half", "toxic").count().collect():
        n[r["half"], r["toxic"]] = r["count"]
    of = n.sum(axis=0)
    if not of.all():
        return Model(base=float(of[1] > 0))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, half, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = sorted(set(WORD.findall((text or "").lower())))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32()), pa.array([half] * len(found), pa.int32())], names=["word", "toxic", "half"])

    cells = {(h, c): F.count_if((F.col("half") == h) & (F.col("toxic") == c)).alias(f"n{h}{c}") for h in (0, 1) for c in (0, 1)}
    counted = sample.select("toxic", "half", "text").mapInArrow(words, "word string, toxic int, half int").groupBy("word").agg(*cells.values())

    def lexicon(halves: tuple[int, ...]) -> list[tuple[str, int]]:
        with1, with0 = (sum(F.col(f"n{h}{c}") for h in halves) for c in (1, 0))
        of1, of0 = (int(sum(n[h, c] for h in halves)) for c in (1, 0))
        odds = F.log((with1 + 0.5) / (of1 + 1)) - F.log((with0 + 0.5) / (of0 + 1))
        best = counted.select("word", odds.alias("odds"), with1.alias("docs")).where((F.col("docs") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS) & (F.length("word") >= 3))
        found = best.orderBy(F.col("odds").desc(), "word").limit(TERMS).collect()
        return [(r["word"], Lexicon.allowed(r["word"]) if OFTEN * r["docs"] >= of1 else 0) for r in found]

    def with_evidence(found: list[tuple[str, int]], halves: tuple[int, ...]) -> Model:
        """Evidence by how many documents of each class have a term, exact or misspelled; of rare misspellings half of the exact one."""
        terms, limits = [t for t, _ in found], [edits for _, edits in found]
        model = Model(terms, limits, np.ones((len(terms), 3)), base=None)

        def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(t, d, toxic) for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t, d in sorted({x[1:3] for x in model.meetings(text)[1]})]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int32())] * 3, names=["term", "distance", "toxic"])

        have = np.zeros((2, len(terms), 3))
        rows = sample.where(F.col("half").isin(*halves)).select("toxic", "text").mapInArrow(meetings, "term int, distance int, toxic int").groupBy("term", "distance", "toxic").count()
        for r in rows.collect():
            have[r["toxic"], r["term"], r["distance"]] = r["count"]
        odds = log_odds(have[1], int(sum(n[h, 1] for h in halves)), have[0], int(sum(n[h, 0] for h in halves)))
        seldom = have.sum(axis=0) < LEAST_DOCS
        seldom[:, 0] = False
        model.odds = np.where(seldom, odds[:, :1] / 2, odds)
        return Model(terms, limits, model.odds, base=None)

    def features(model: Model, half: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [model.features(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

        rows = sample.where(F.col("half") == half).select("toxic", "text").mapInArrow(run, "toxic int, x array<double>").collect()
        return np.array([[r["toxic"], *r["x"]] for r in rows]).reshape(-1, FEATURES + 1)

    crossed = np.concatenate([features(with_evidence(lexicon((h,)), (h,)), 1 - h) for h in (0, 1) if n[h].all()] or [np.zeros((0, FEATURES + 1))])
    whole = with_evidence(lexicon((0, 1)), (0, 1))
    whole.weights = regression(crossed[:, 1:], crossed[:, 0], PRIOR)
    return whole


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def rate(docs: DataFrame, labels: DataFrame, docs_per_class: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from labels outside the held-out fold, for all documents."""
    model = learn(training_rows(docs, labels, docs_per_class))
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
