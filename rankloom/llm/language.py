"""Language identification by a linear-chain conditional random field.

The model labels every word of a text with a language, so that code-switched
text gets a label for each run of words. A word's features are its affixes, its
character trigrams and the set of languages whose lexicon holds it; transition
weights between neighbouring words' labels are learned with them. Training
maximizes the likelihood of label sequences by gradient steps, whose expected
counts come from forward-backward; the sequences switch languages, being made
of pieces of labelled documents. A text's language is the one with the largest
mean posterior over its words, and that mean is the score.

Training reads a sample of labelled documents of bounded size: whole documents
of each language, chosen by a hash of their ids, ``docs_per_language`` and
``bytes_per_language`` at most, and ``most_bytes`` of all languages; a document
that alone exceeds a language's bytes is not in the sample. Every feature that
three of the sample's words have is kept. The model goes to the workers with
the task. Everything else runs over all documents, whole texts, without a
shuffle.

Defined cases: a text that is null or has no letters (by Unicode;
fractions, superscripts and the like are none) is ``und`` with score 0, as is every text
if no document is labelled. Repeated rows get equal results. Very long texts
and words are labelled whole (runs of over 40 letters in consecutive pieces);
forward-backward runs over fixed blocks of words whose transition products are
combined, so its work is linear, and over a very long text a segment at a time,
so that its memory is bounded.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words: runs of letters; longer runs (scripts without spaces, joined words) are consecutive words of 40 letters.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]{0,39}")
UNKNOWN = "und"
BLOCK = 32
#: Steps after which vectors are scaled anew; weights are clipped so that none vanishes before.
RESCALE = 4
FLOOR = 1e-30
#: Words whose weights a worker keeps, and words in one forward-backward run.
MOST_WORDS, WORDS_AT_ONCE = 400_000, 200_000
#: Texts of more characters are labelled by themselves, so many words at a time.
LONG, SEGMENT = 1 << 20, 20_000


def features_of(word: str) -> list[str]:
    framed = f"^{word}$"
    found = [f"a{framed[:k]}" for k in (2, 3, 4) if k < len(framed)]
    found += [f"z{framed[-k:]}" for k in (2, 3, 4) if k < len(framed)]
    found += [f"g{framed[i : i + 3]}" for i in range(len(framed) - 2)]
    return found


@dataclass
class Model:
    languages: list[str]
    features: dict[str, int]
    lexicon: dict[str, int]  # word: bits of the languages that know it
    weights: np.ndarray
    transitions: np.ndarray  # from, to; logarithms
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "table": None}

    def ids(self, word: str) -> list[int]:
        get = self.features.get
        found = [i for f in features_of(word) if (i := get(f)) is not None]
        if (i := get(f"x{self.lexicon.get(word, 0)}")) is not None:
            found.append(i)
        return found

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp of the words' summed weights, each row scaled to a maximum of 1."""
        flat, starts = [], np.zeros(len(words) + 1, np.int64)
        for k, w in enumerate(words):
            flat += self.ids(w)
            starts[k + 1] = len(flat)
        scores = np.zeros((len(words), len(self.languages)), np.float64)
        if flat:
            sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self.weights[np.array(flat)], axis=0, dtype=np.float64)])
            scores = sums[starts[1:]] - sums[starts[:-1]]
        return np.maximum(np.exp(scores - scores.max(axis=1, keepdims=True)), FLOOR).astype(np.float32)

    def look_up(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers in ``table`` for all words, and the texts' lengths."""
        if self.table is None or len(self.known) > MOST_WORDS:
            self.known, self.table = {}, np.zeros((0, len(self.languages)), np.float32)
        known, before = self.known, len(self.known)
        rows = [known.setdefault(w, len(known)) for t in texts for w in t]
        if len(known) > before:
            fresh = list(islice(reversed(known), len(known) - before))[::-1]
            self.table = np.concatenate([self.table, self.emissions(fresh)])
        return np.array(rows, np.int64), np.array([len(t) for t in texts], np.int64)

    def posteriors(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        rows, lengths = self.look_up(texts)
        return forward_backward(self.table[rows], lengths, np.exp(self.transitions).astype(np.float64)), lengths

    def chain(self, words: Callable[[], Iterator[str]], segment: int = SEGMENT) -> Iterator[np.ndarray]:
        """Posteriors of one text's words, a segment at a time. The words are read twice: first for each segment's product of matrices."""
        a = np.exp(self.transitions).astype(np.float64)

        def emitted() -> Iterator[np.ndarray]:
            read = words()
            while held := list(islice(read, segment)):
                rows, _ = self.look_up([held])
                yield self.table[rows]

        products = [product_of(e, a) for e in emitted()]
        behind = [np.ones(len(a))]
        for m in products[:0:-1]:
            v = m @ behind[-1]
            behind.append(v / v.sum())
        ahead = np.full(len(a), 1.0 / len(a))
        for e, m, after in zip(emitted(), products, reversed(behind), strict=True):
            yield forward_backward(e, np.array([len(e)]), a, ahead[None], after[None])
            ahead = ahead @ m
            ahead /= ahead.sum()

    def means(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The mean posterior over each text's words, and how many it has."""
        out, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        group: list[list[str]] = []
        places: list[int] = []

        def label() -> None:
            p, lengths = self.posteriors(group)
            sums = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
            ends = np.cumsum(lengths)
            out[places], n[places] = (sums[ends] - sums[ends - lengths]) / np.maximum(lengths, 1)[:, None], lengths
            group.clear()
            places.clear()

        held = 0
        for i, t in enumerate(texts):
            if t and len(t) > LONG:
                low = t.lower()
                for p in self.chain(lambda low=low: (m[0] for m in LETTERS.finditer(low))):
                    out[i] += p.sum(axis=0)
                    n[i] += len(p)
                out[i] /= max(1, n[i])
                continue
            group.append(LETTERS.findall(t.lower()) if t else [])
            places.append(i)
            held += len(group[-1])
            if held >= WORDS_AT_ONCE:
                label()
                held = 0
        if group:
            label()
        return out, n


def product_of(e: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The product of transition and emission matrices over words, scaled."""
    m = a[None] * e[:, None, :].astype(np.float64)
    while len(m) > 1:
        if len(m) % 2:
            m = np.concatenate([m, np.eye(len(a))[None]])
        m = m[0::2] @ m[1::2]
        m /= m.max(axis=(1, 2), keepdims=True)
    return m[0]


def forward_backward(e: np.ndarray, lengths: np.ndarray, a: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Posteriors (words, labels) of chains that lie one after another in e.

    ``before`` and ``after`` (chains, labels) are the forward vectors before and
    the backward vectors behind the chains; without them all labels are alike.
    Chains are cut into blocks of ``BLOCK`` words. A block's product of
    transition and emission matrices carries the forward vector over it, so
    only blocks are walked chain by chain; inside, all blocks move together.
    """
    n, k = e.shape
    if not n:
        return e.astype(np.float64)
    blocks = -(-lengths // BLOCK)
    chain = np.repeat(np.arange(len(lengths)), blocks)
    first = np.cumsum(blocks) - blocks
    inside = np.arange(len(chain)) - first[chain]
    start = (np.cumsum(lengths) - lengths)[chain] + inside * BLOCK
    size = np.minimum(BLOCK, lengths[chain] - inside * BLOCK)
    at = start[:, None] + np.arange(BLOCK)
    real = np.arange(BLOCK) < size[:, None]
    x = np.ascontiguousarray(e[np.where(real, at, 0)].astype(np.float64))
    b = len(chain)
    product = np.broadcast_to(np.eye(k), (b, k, k)).copy()
    whole = np.empty_like(product)
    for t in range(BLOCK):
        product = (product.reshape(-1, k) @ a).reshape(b, k, k) * x[:, t, None, :]
        if t % RESCALE == RESCALE - 1:
            product /= product.max(axis=(1, 2), keepdims=True)
        ends = size == t + 1  # a chain's last block may have room left
        whole[ends] = product[ends]
    product = whole
    ahead, behind = np.full((b, k), 1.0 / k), np.ones((b, k))
    if before is not None:
        ahead[inside == 0] = before[lengths > 0]
    if after is not None:
        behind[inside == blocks[chain] - 1] = after[lengths > 0]
    order = np.argsort(inside, kind="stable")
    bounds = np.searchsorted(inside[order], np.arange(int(blocks.max(initial=0)) + 1))
    for j in range(1, len(bounds) - 1):
        i = order[bounds[j] : bounds[j + 1]]
        v = np.einsum("bk,bkl->bl", ahead[i - 1], product[i - 1])
        ahead[i] = v / v.sum(axis=1, keepdims=True)
    from_end = (blocks[chain] - 1) - inside
    order = np.argsort(from_end, kind="stable")
    bounds = np.searchsorted(from_end[order], np.arange(int(blocks.max(initial=0)) + 1))
    for j in range(1, len(bounds) - 1):
        i = order[bounds[j] : bounds[j + 1]]
        v = np.einsum("bkl,bl->bk", product[i + 1], behind[i + 1])
        behind[i] = v / v.sum(axis=1, keepdims=True)
    forward = np.empty((BLOCK, b, k))
    v = ahead
    for t in range(BLOCK):
        v = (v @ a) * x[:, t]
        if t % RESCALE == 0:
            v /= v.sum(axis=1, keepdims=True)
        forward[t] = v
    v = behind
    for t in range(BLOCK - 1, -1, -1):
        forward[t] *= v
        v = (v * x[:, t]) @ a.T
        if t % RESCALE == 0:
            v /= v.sum(axis=1, keepdims=True)
        ends = size == t
        if ends.any():
            v[ends] = behind[ends]
    out = forward.transpose(1, 0, 2)[real]
    return out / out.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], *, sequences: int = 1500, length: int = 64, steps: int = 40, rate: float = 0.25, decay: float = 1e-5, seed: int = 7) -> Model | None:
    """A model from (language, text) rows; None if there are none with letters."""
    texts = [(lang, LETTERS.findall(t.lower())) for lang, t in rows]
    texts = [(lang, w) for lang, w in texts if w]
    languages = sorted({lang for lang, _ in texts})
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    uses = [Counter() for _ in languages]
    for lang, words in texts:
        uses[number[lang]].update(set(words))
    lexicon: dict[str, int] = {}
    for i, c in enumerate(uses):
        for w, n in c.items():
            if n >= 4:
                lexicon[w] = lexicon.get(w, 0) | 1 << i
    counted = Counter(f for c in uses for w in c for f in features_of(w))
    kept = sorted(f for f, n in counted.items() if n >= 3)
    kept += [f"x{b}" for b in sorted({0, *lexicon.values()})]
    k = len(languages)
    model = Model(languages, {f: i for i, f in enumerate(kept)}, lexicon, np.zeros((len(kept), k)), np.zeros((k, k)))

    rng = np.random.default_rng(seed)
    by = [[w for lang, w in texts if lang == x] for x in languages]
    words: list[str] = []
    gold: list[int] = []
    for _ in range(sequences):  # code-switched: pieces of documents, one after another
        made = 0
        while made < length:
            i = int(rng.integers(k))
            doc = by[i][int(rng.integers(len(by[i])))]
            take = min(int(rng.integers(3, 41)), length - made)
            at = int(rng.integers(max(1, len(doc) - take + 1)))
            piece = doc[at : at + take]
            words += piece
            gold += [i] * len(piece)
            made += len(piece)
    batch = Batch(model, words, np.array(gold), sequences)
    params = [model.weights, model.transitions]
    squares = [np.full_like(p, 1e-8) for p in params]
    for _ in range(steps):
        for q, s, d in zip(params, squares, batch.gradient(*params), strict=True):
            d = d / sequences + decay * q
            s += d * d
            q -= rate * d / np.sqrt(s)
    model.weights = model.weights.astype(np.float32)
    return model


class Batch:
    """Labelled sequences of equal length, one after another."""

    def __init__(self, model: Model, words: list[str], gold: np.ndarray, sequences: int) -> None:
        self.sequences, self.length, self.k = sequences, len(words) // sequences, len(model.languages)
        distinct: dict[str, int] = {}
        self.rows = np.array([distinct.setdefault(w, len(distinct)) for w in words])
        ids = [model.ids(w) for w in distinct]
        self.n, self.flat = len(ids), np.array([i for x in ids for i in x], np.int64)
        self.owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        self.gold = gold.reshape(sequences, self.length)
        self.one = np.eye(self.k)[gold]
        self.seen = np.zeros((self.k, self.k))
        np.add.at(self.seen, (self.gold[:, :-1].ravel(), self.gold[:, 1:].ravel()), 1)

    def gradient(self, weights: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the sequences' negative log-likelihood, by weights and transitions: expected counts less those seen."""
        k = self.k
        sums = np.stack([np.bincount(self.owner, weights[self.flat, c], self.n) for c in range(k)], axis=1)
        a = np.exp(transitions)
        x = np.exp(sums - sums.max(axis=1, keepdims=True))[self.rows]
        p = forward_backward(x, np.full(self.sequences, self.length), a)
        excess = np.stack([np.bincount(self.rows, (p - self.one)[:, c], self.n) for c in range(k)], axis=1)
        # Any label may stand before a sequence; of a labelled one, those that the first label follows.
        first = (a / a.sum(axis=0)) * np.bincount(self.gold[:, 0], minlength=k)
        by_weight = np.stack([np.bincount(self.flat, excess[self.owner, c], len(weights)) for c in range(k)], axis=1)
        return by_weight, expected_pairs(x.reshape(self.sequences, self.length, k), a) - self.seen - first


def expected_pairs(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Expected label pairs of neighbouring words in chains of equal length (chains, words, labels), and of the label before a chain and its first."""
    n, length, k = x.shape
    ahead = np.empty((length + 1, n, k))
    ahead[0] = 1.0 / k
    for t in range(length):
        v = (ahead[t] @ a) * x[:, t]
        ahead[t + 1] = v / v.sum(axis=1, keepdims=True)
    total, v = np.zeros((k, k)), np.ones((n, k))
    for t in range(length - 1, -1, -1):
        after = v * x[:, t]
        joint = ahead[t][:, :, None] * a[None] * after[:, None, :]
        total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        v = after @ a.T
        v /= v.sum(axis=1, keepdims=True)
    return total


def fold(doc_id: Column, folds: int = 3) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, docs_per_language: int = 300, bytes_per_language: int = 4 << 20, most_bytes: int = 64 << 20) -> list[tuple[str, str]]:
    """A sample of labelled texts of each language, chosen by a hash of doc_id: whole, bounded in number and in bytes."""
    labelled = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null and doc_id is not null")
    draw = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1_000_000))
    counts = labelled.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return []
    room = min(bytes_per_language, most_bytes // len(counts))
    enough = F.coalesce(*(F.when(F.col("lang") == r["lang"], min(1_000_000, 1_000 + int(1.3e6 * docs_per_language / r["count"]))) for r in counts))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    sample = labelled.withColumns({"draw": draw, "size": F.octet_length("text")}).where((F.col("draw") <= enough) & (F.col("size") <= room))
    sample = sample.withColumn("place", F.row_number().over(order)).where(F.col("place") <= docs_per_language)
    sample = sample.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= room)
    return sorted((r["lang"], r["text"]) for r in sample.select("lang", "text").collect())


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            if model:
                mean, n = model.means(batch.column(1).to_pylist())
                for i in np.flatnonzero(n).tolist():
                    best = int(mean[i].argmax())
                    languages[i], scores[i] = model.languages[best], min(1.0, max(0.0, float(mean[i, best])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def keep_known(docs: DataFrame, docs_per_language: int = 300, least: float = 0.35) -> DataFrame:
    """The documents, all columns, whose language the model can tell: not ``und``, and a score of ``least`` or more."""
    model = fit(training_rows(docs.where(~F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))), docs_per_language))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if model:
                mean, n = model.means(texts)
                keep = ((mean.max(axis=1) >= least) & (n > 0)).tolist()
            else:
                keep = [bool(t and LETTERS.search(t)) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def label_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and spans, the runs of equally labelled words: array of (start, end, lang) in characters."""

    def spans(text: str | None) -> list[dict]:
        labels = (i for p in model.chain(lambda: (m[0].lower() for m in LETTERS.finditer(text or ""))) for i in p.argmax(axis=1).tolist())
        out: list[dict] = []
        for m, i in zip(LETTERS.finditer(text or ""), labels, strict=True):
            if out and out[-1]["lang"] == model.languages[i]:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end(), "lang": model.languages[i]})
        return out

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spans(t) for t in batch.column(1).to_pylist()], kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<struct<start:int,end:int,lang:string>>")


def identify(docs: DataFrame, docs_per_language: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from documents outside fold 1, predicted for all."""
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    model = fit(training_rows(docs.where(~held_out), docs_per_language))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
