"""Models that live in workers: loaded once a worker, fed in batches of like length across Arrow batches.

A model is an object with ``encode(texts)`` or ``score(questions, passages)``
that takes lists and returns as many vectors or numbers. ``load`` makes it; a
worker calls that when it first needs the model and keeps it from task to task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import text as T

#: Rows that wait to be sorted by length, and rows that a model gets at once.
WINDOW, BATCH = 4096, 64
_loaded: dict[str, object] = {}


def resident(name: str, load: Callable[[], object]) -> object:
    """The worker's model of a name."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def by_length(columns: list[pd.Series], call: Callable[..., list], batch: int) -> list:
    """What a model says of rows, in their order; it gets rows of like length together."""
    sizes = sum(c.str.len().fillna(0).to_numpy() for c in columns)
    order = np.argsort(sizes, kind="stable")
    out: list = [None] * len(order)
    for low in range(0, len(order), batch):
        at = order[low : low + batch]
        for i, value in zip(at.tolist(), call(*(c.iloc[at].fillna("").tolist() for c in columns)), strict=True):
            out[i] = value
    return out


def across(batches: Iterator[tuple[pd.Series, ...]], call: Callable[..., list], window: int, batch: int) -> Iterator[pd.Series]:
    """Results for every Arrow batch in turn; small ones wait until a window of rows is there."""
    waiting: list[tuple[pd.Series, ...]] = []

    def out() -> Iterator[pd.Series]:
        whole = by_length([pd.concat(c, ignore_index=True) for c in zip(*waiting, strict=True)], call, batch)
        at = 0
        for columns in waiting:
            yield pd.Series(whole[at : at + len(columns[0])])
            at += len(columns[0])
        waiting.clear()

    for columns in batches:
        waiting.append(columns)
        if sum(len(c[0]) for c in waiting) >= window:
            yield from out()
    if waiting:
        yield from out()


def pair_scorer(name: str, load: Callable[[], object], window: int = WINDOW, batch: int = BATCH):
    """A scorer of (question, passage) for ``retrieval.rerank``."""

    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from across(pairs, resident(name, load).score, window, batch)

    return score


def encoder(name: str, load: Callable[[], object], window: int = WINDOW, batch: int = BATCH) -> Callable[[DataFrame], DataFrame]:
    """An encoder of (id, text) for an index."""

    @F.pandas_udf("array<double>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from across(((t,) for t in texts), resident(name, load).encode, window, batch)

    return lambda rows: rows.select("id", encode("text").alias("vec"))


class TermShare:
    """A made model: the share of a question's distinct terms that a passage has."""

    def __init__(self) -> None:
        self.word, self.stop = re.compile("[a-z0-9]+"), frozenset(T.SEARCH_STOPWORDS)

    def terms(self, text: str) -> set[str]:
        return set(self.word.findall(text.lower())) - self.stop

    def score(self, questions: list[str], passages: list[str]) -> list[float]:
        asked = list(map(self.terms, questions))
        return [len(a & self.terms(p)) / max(len(a), 1) for a, p in zip(asked, passages, strict=True)]

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(len(self.terms(t)))] for t in texts]

