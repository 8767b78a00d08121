"""Byte-level BPE by a compiled tokenization automaton.

``Automaton`` reads a tokenizers file and compiles its merges in rank order,
one merge gadget each. The automaton's arcs carry tokens and at any time all
arcs of one label enter the same state, so a state is known by the label that
enters it. The gadget for the merge of a and b clones the state that a enters,
without its b arc, and lets a enter the clone; the new label ab leaves every
state that still has an a arc and enters what b enters. A state therefore is
the state it was cloned from minus one arc: compilation stores, for every
state, its origin, and for every cut arc the rank of its gadget. A transition
looks the arc up along this chain, once; the answer stays in a table.

A token sequence is accepted if it is what the merges make of its bytes, so
each prefix of a word has one accepted path. A merge whose parts no accepted
path has side by side gets no gadget, and its label no arc. Files whose merges
use labels before they are made, or make a label twice, are refused (training
doesn't make them). Encoding walks the
table from the start state, longest label first; where a word's accepted path
takes a shorter label, the walk turns back. A position that it turned back from
is never tried again, so it makes at most one step for each position and label
that fits there: length of the word times length of the longest label.
Decoding emits the bytes of the arcs' labels.

Defined cases: null text is empty, and empty text has no tokens. Special tokens
of the file are found in the text first, as the library does. Long words are
walked iteratively. Ids and other columns pass untouched; repeated rows stay.
"""

from __future__ import annotations

import gc
import hashlib
import json
from array import array
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: How the byte-level pre-tokenizer splits text (fixed values of the format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words of a full table (the one before it is kept too), and arcs, whose table starts anew beyond that. A task's end empties them, as the worker stays.
MOST_WORDS = 150_000
MOST_ARCS = 250_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable bytes for themselves, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = (b for b in range(256) if b not in set(own))
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    START = 0

    def __init__(self, spec: dict) -> None:
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.labels = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.specials}
        self.labels |= {i: t.encode() for t, i in self.specials.items()}
        self.ids = {t: i for i, t in self.labels.items() if t.decode("utf-8", "replace") not in self.specials}
        self._compile([(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])])
        #: Labels that an arc has, by their bytes: a dict for each byte, the label itself at -1.
        self.trie: dict = {}
        for t, i in self.ids.items():
            if len(t) > 1 and i not in self.made:
                continue
            node = self.trie
            for byte in t:
                node = node.setdefault(byte, {})
            node[-1] = i
        self.longest = max(map(len, self.ids), default=1)
        self.length = {i: len(t) for t, i in self.ids.items()}
        self.arcs: dict[int, int] = {}
        self.words = _Words(self)
        import regex

        self.split = regex.compile(SPLIT).findall
        self.at_specials = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.specials, key=len, reverse=True)) + ")").split if self.specials else None

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        self.enters: dict[int, int] = dict.fromkeys(self.labels, self.START)  # label to state
        self.clone_of: list[int] = [self.START]
        self.without: list[tuple[int, int]] = [(-1, -1)]  # the label whose arc was cut, and the gadget's rank
        self.made: dict[int, tuple[int, int]] = {}  # merged label: its left part, and its rank
        self.cuts: dict[tuple[int, int], int] = {}  # (owner, label): rank
        self.owner: list[int] = [-1]
        self.base: list[int] = [self.START]  # what the owner entered before its first gadget
        later = Counter(ab for _, _, ab in merges)
        for rank, (a, b, ab) in enumerate(merges):
            later[ab] -= 1
            entered = self.enters[b]
            old = self.enters[a]
            if any(len(self.labels[x]) > 1 and x not in self.made for x in (a, b)) or not self.has_arc(old, b):
                if any(x not in self.made and later[x] > 0 for x in (a, b)):
                    raise ValueError(f"merge {rank} needs a label that a later merge makes")
                continue  # earlier merges never leave a and b side by side
            if ab in self.made:
                raise ValueError(f"merge {rank} makes a label that an earlier merge makes of other parts")
            state = len(self.owner)
            self.clone_of.append(old)
            self.without.append((b, rank))
            self.base.append(self.base[old] if self.owner[old] == a else old)
            self.owner.append(a)
            self.cuts[a, b] = rank
            self.enters[a] = state
            self.made[ab] = (a, rank)
            self.enters[ab] = entered

    def has_arc(self, state: int, label: int) -> bool:
        """Whether the label leaves the state: no gadget along the chain of clones cut it or, while it was what the label starts with, a part of it."""
        while state != self.START:
            owner, upto = self.owner[state], self.without[state][1]
            part = label
            while True:
                rank = self.cuts.get((owner, part))
                if rank is not None and rank <= upto:
                    return False
                if part not in self.made:
                    break
                part, made_at = self.made[part]
                upto = min(upto, made_at)
            state = self.base[state]
        return True

    def step(self, state: int, label: int) -> int:
        """The state that the arc enters, or -1."""
        to = self.arcs.get(state << 32 | label)
        if to is None:
            if len(self.arcs) >= MOST_ARCS:
                self.arcs.clear()
            to = self.arcs[state << 32 | label] = self.enters[label] if self.has_arc(state, label) else -1
        return to

    def labels_at(self, word: bytes, at: int) -> list[int]:
        """The labels that the bytes from here on start with, longest last."""
        found, node = [], self.trie
        for byte in word[at : at + self.longest]:
            node = node.get(byte)
            if node is None:
                break
            if -1 in node:
                found.append(node[-1])
        return found

    def encode_word(self, word: bytes) -> list[int]:
        n, at, state, arcs, length = len(word), 0, self.START, self.arcs, self.length
        dead: set[int] = set()
        path: list[tuple[int, int, list[int]]] = []  # position, label, labels still to try there
        tries = self.labels_at(word, 0)
        while at < n:
            while tries:
                label = tries.pop()
                end = at + length[label]
                if end in dead:
                    continue
                to = arcs.get(state << 32 | label)
                if to is None:
                    to = self.step(state, label)
                if to >= 0:
                    path.append((at, label, tries))
                    at, state = end, to
                    if at < n:
                        tries = self.labels_at(word, at)
                    break
            else:
                dead.add(at)
                if not path:
                    raise ValueError("no path: the vocabulary lacks a byte")
                at, _, tries = path.pop()
                state = self.enters[path[-1][1]] if path else self.START
        return [label for _, label, _ in path]

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian 32-bit numbers."""
        get = self.words.__getitem__
        if not any(x in text for x in self.specials):
            return b"".join(map(get, self.split(text)))
        out = []
        for i, piece in enumerate(self.at_specials(text)):
            out.append(self.specials[piece].to_bytes(4, "little") if i % 2 else b"".join(map(get, self.split(piece))))
        return b"".join(out)

    def forget(self) -> None:
        """Empty the tables that grow with the texts."""
        self.words.forget()
        self.arcs.clear()

    def decode(self, ids: bytes) -> str:
        labels = memoryview(ids).cast("I")
        return b"".join(map(self.labels.__getitem__, labels)).decode("utf-8", "replace")


class _Words(dict):
    """word: its ids, made when first asked for; words of the full table before come over when they are met again, so frequent ones stay."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = array("I", self.automaton.encode_word(word.encode("utf-8"))).tobytes()
        if len(word) <= 64:
            if len(self) >= MOST_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def forget(self) -> None:
        self.before = {}
        self.clear()


@contextmanager
def loaded(path: str) -> Iterator[Automaton]:
    """The worker's automaton, for a task: what it learned of the task's texts doesn't stay in the worker, which goes on to other stages."""
    bpe = load(path)
    try:
        yield bpe
    finally:
        bpe.forget()


@lru_cache(maxsize=2)
def load(path: str) -> Automaton:
    """Compiled once in each Python worker."""
    with open(path, encoding="utf-8") as f:
        compiled = Automaton(json.load(f))
    gc.freeze()  # the tables stay; the collector needn't visit them again and again
    return compiled


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids (binary, 32-bit little-endian), n_tokens and the decoded text of every document."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with loaded(path) as bpe:
            for batch in batches:
                for rows in _pieces(batch):
                    ids = [bpe.encode(t or "") for t in rows.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([bpe.decode(x) for x in ids], pa.string())],
                        names=["doc_id", "ids", "n_tokens", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary, n_tokens long, decoded string")


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of ids and of the decoded text; hashed where they are made, so that ids don't travel."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with loaded(path) as bpe:
            for batch in batches:
                n, of_ids, of_text = [], [], []
                for text in batch.column(1):
                    ids = bpe.encode(text.as_py() or "")
                    n.append(len(ids) // 4)
                    of_ids.append(hashlib.sha256(ids).hexdigest())
                    of_text.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _pieces(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
