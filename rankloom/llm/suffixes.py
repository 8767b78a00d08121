"""Removal of repeated byte strings by hash-compared suffix sorting.

Every byte covered by a string of ``LENGTH`` bytes that also starts in a
document with a smaller doc_id is removed; strings are judged on the input.

Sorting all suffixes of a corpus would move every byte many times. Equal
strings of LENGTH bytes hold equal anchors, though: the least hashed GRAM-byte
substring of the string. So only suffixes around anchors that occur twice are
sorted, each where its anchor's other places are:

1. Documents go to chunks of about ``CHUNK`` bytes by their id, and stay there.
   Exact copies of a smaller document are known by their text's hash: their
   results follow, and they take no further part. A chunk sends its anchors'
   hashes, four bytes each, to hash ranges.
2. A range tells each chunk which anchors occur again. The chunk sends these
   anchors' surroundings (all strings of LENGTH bytes that hold the anchor),
   each distinct one once, with the smallest document that has it. Of anchors
   at ``HOT`` places and more it sends the single strings instead, by their own
   hash, so that a passage in a third of all documents is dealt out as well.
3. A range sorts the suffixes of an anchor's distinct surroundings by a merge
   sort that compares two suffixes by binary search over polynomial prefix
   hashes for their common extension. Neighbours that share LENGTH bytes are
   verified byte by byte. Each run of equal strings yields its smallest
   document, and chunks learn which of their strings repeat it.

What doesn't need the sort, and why its results are the same: a copy of a
smaller document is covered by that document's strings from end to end, so
nothing is left to compare. Equal surroundings have equal suffixes, so one of
them is sorted for all. A hot anchor's strings are dealt out whole, and a string
that is as long as LENGTH is the only suffix of it that counts: those of equal
hash are verified by their bytes, and others differ.

Memory: a chunk and a range hold a few tens of MB; a longer document is read in
blocks. The shuffled text is exchanged once and read by all three steps.
Numbers travel as planes of equal bytes (all low bytes first), which compress.

Defined cases: null and short texts lose nothing; a null doc_id neither
removes nor loses bytes; rows of equal doc_id don't count against each other.
Repeated rows get equal results. Other columns of the input are kept apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import cut, join_by_key, text_bytes

LENGTH, GRAM = 50, 24
WINDOW = LENGTH - GRAM + 1
#: An anchor's surroundings: the strings that hold it.
REACH = WINDOW - 1 + LENGTH
CHUNK, RANGE = 2 << 20, 4 << 20
HOT = 1024
BLOCK = 1 << 18
#: Pairs of suffixes that are compared at once.
PAIRS = 1 << 14
BASE = 0x9E3779B97F4A7C15
KEYS, STATE, COPY = 0, 1, 2

FORWARD = "r long, chunk int, kind int, blob binary"
BACK = "home int, kind int, r long, blob binary"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWER = _powers(BASE, BLOCK + REACH + 1)
INVERSE = _powers(pow(BASE, -1, 1 << 64), BLOCK + REACH + 1)


def mixed(h: np.ndarray, turn: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(turn)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


class Chunk:
    """Documents of a chunk in a fixed order, as one array of bytes."""

    def __init__(self, table: pa.Table) -> None:
        ids, texts = table["doc_id"].to_pylist(), [t or b"" for t in table["body"].to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in self.order]
        self.texts = [texts[i] for i in self.order]
        self.rank = np.array([-1 if i is None else i for i in self.ids], np.int64)

    def lay_out(self, part: np.ndarray) -> None:
        """Concatenate the documents that take part."""
        self.part = np.flatnonzero(part)
        texts = [self.texts[i] for i in self.part]
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the anchors are, and their hashes."""
        n = len(self.data)
        good = np.zeros(n, bool)
        for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            good[a : max(a, b - LENGTH + 1)] = True
        at, hashes = [], []
        low = np.uint64((1 << 21) - 1)
        for a in range(0, max(0, n - LENGTH + 1), BLOCK):
            b = min(a + BLOCK, n - LENGTH + 1)
            piece = self.data[a : b + LENGTH - 1]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(piece * POWER[: len(piece)], out=sums[1:])
            h = mixed((sums[GRAM:] - sums[:-GRAM]) * INVERSE[: len(piece) - GRAM + 1])
            m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while 2 * width <= WINDOW:
                m = np.minimum(m[:-width], m[width:])
                width *= 2
            if width < WINDOW:
                m = np.minimum(m[: -(WINDOW - width)], m[WINDOW - width :])
            m = (m & low)[good[a:b]].astype(np.int64)
            if len(m):
                m = m[np.flatnonzero(np.r_[True, m[1:] != m[:-1]])]
                at.append(m + a)
                hashes.append(h[m])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        p, first = np.unique(np.concatenate(at), return_index=True)
        return p, mixed(np.concatenate(hashes)[first], 0xD6E8FEB86659FD93)


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays in planes behind a head of five bytes each (kind and length): with many ranges a chunk sends few numbers to each."""
    head = bytes([len(arrays)]) + b"".join(a.dtype.char.encode() + len(a).to_bytes(4, "little") for a in arrays)
    return head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)


def _arrays(blob: bytes) -> list[np.ndarray]:
    """What ``_blob`` packed."""
    out, at = [], 1 + 5 * blob[0]
    for k in range(1, at, 5):
        kind, n = np.dtype(chr(blob[k])), int.from_bytes(blob[k + 1 : k + 5], "little")
        planes = np.frombuffer(blob, np.uint8, n * kind.itemsize, at)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += n * kind.itemsize
    return out


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    kinds = {"r": pa.int64(), "chunk": pa.int32(), "home": pa.int32(), "kind": pa.int32(), "blob": pa.binary()}
    return pa.table([pa.array([x[i] for x in rows], kinds[n]) for i, n in enumerate(names)], names=list(names))


def _by_range(r: np.ndarray) -> list[tuple[int, int, int]]:
    """range, from, to of an ascending array of ranges."""
    edges = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True]) if len(r) else np.zeros(1, np.int64)
    return [(int(r[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


# ---- step 1: anchors to ranges, and back which occur again


def send_anchors(ranges: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, docs: pa.Table, copies: pa.Table) -> pa.Table:
        number = key[0].as_py()
        chunk = Chunk(docs)
        known: dict[int, set[bytes]] = {}
        for i, digest in zip(copies["r"].to_pylist(), copies["blob"].to_pylist(), strict=True):
            known.setdefault(i, set()).add(digest)
        part = np.array([i is not None and len(t) >= LENGTH and not (i in known and hashlib.sha256(t).digest() in known[i]) for i, t in zip(chunk.ids, chunk.texts, strict=True)], bool)
        copy = np.array([i is not None and i in known and hashlib.sha256(t).digest() in known[i] for i, t in zip(chunk.ids, chunk.texts, strict=True)], bool)
        chunk.lay_out(part)
        _, h = chunk.anchors()
        h, n = np.unique(h, return_counts=True)
        rows = [(number % ranges, number, STATE, _blob(part, copy))]
        for r, a, b in _by_range(range_of(h, ranges)):
            rows.append((r, number, KEYS, _blob((h[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(n[a:b], 255).astype(np.uint8))))
        return _table(rows, ("r", "chunk", "kind", "blob"))

    return run


def find_shared(hot: int) -> Callable[[pa.Table], pa.Table]:
    """0 for an anchor at a single place, 1 for others, 2 for those at ``hot`` places and more."""
    return lambda table: _shared(table, hot)


def _shared(table: pa.Table, hot: int) -> pa.Table:
    rows = sorted(zip(table["chunk"].to_pylist(), table["kind"].to_pylist(), table["r"].to_pylist(), table["blob"].to_pylist(), strict=True), key=lambda x: x[:2])
    out = [x for x in rows if x[1] == STATE]
    rows = [x for x in rows if x[1] == KEYS]
    if rows:
        parts = [_arrays(x[3]) for x in rows]
        key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        total = np.add.reduceat(n[order].astype(np.int64), edges)
        code = np.empty(len(key), np.uint8)
        code[order] = np.repeat((total > 1).astype(np.uint8) + (total >= hot), np.diff(np.r_[edges, len(key)]))
        at = 0
        for (chunk, kind, r, _), p in zip(rows, parts, strict=True):
            out.append((chunk, kind, r, _blob(code[at : at + len(p[0])])))
            at += len(p[0])
    return _table(out, ("home", "kind", "r", "blob"))


# ---- step 2: surroundings to ranges


def _received(back: pa.Table) -> tuple[tuple, np.ndarray]:
    rows = list(zip(back["kind"].to_pylist(), back["r"].to_pylist(), back["blob"].to_pylist(), strict=True))
    state = next(_arrays(b) for k, _, b in rows if k == STATE)
    parts = [_arrays(b)[0] for k, r, b in sorted(((k, r, b) for k, r, b in rows if k == KEYS), key=lambda x: x[1])]
    return state, np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def surroundings(chunk: Chunk, p: np.ndarray, h: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, reach to the left of the anchor, length, key and document of what is sent, single strings for hot anchors."""
    doc = np.searchsorted(chunk.ends, p, side="right")
    low, high = np.maximum(chunk.starts[doc], p - WINDOW + 1), np.minimum(chunk.ends[doc], p + LENGTH)
    hot = code == 2
    plain = np.flatnonzero(~hot)
    start, left, length, key, owner = low[plain], (p - low)[plain], (high - low)[plain], h[plain], doc[plain]
    if hot.any():
        i = np.flatnonzero(hot)
        count = np.minimum(p[i], high[i] - LENGTH) - low[i] + 1
        each = np.repeat(low[i], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        each = np.unique(each)
        own = np.searchsorted(chunk.ends, each, side="right")
        key_of = np.zeros(len(each), np.uint64)
        for j in range(LENGTH):
            key_of += chunk.data[each + j] * POWER[j]
        start, left, length = np.r_[start, each], np.r_[left, np.zeros_like(each)], np.r_[length, np.full_like(each, LENGTH)]
        key, owner = np.r_[key, mixed(key_of, 0xC2B2AE3D27D4EB4F)], np.r_[owner, own]
    return start, left, length, key, owner


def rows_of(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bytes as a matrix of REACH columns, zeros behind."""
    columns, out = np.arange(REACH), np.zeros((len(start), REACH), np.uint8)
    for a in range(0, len(start), 4096):  # index matrices are eight times the bytes: a block at a time
        i = np.minimum(start[a : a + 4096, None] + columns, len(data) - 1)
        out[a : a + 4096] = np.where(columns < length[a : a + 4096, None], data[i], 0)
    return out


def whole_hash(matrix: np.ndarray, left: np.ndarray, length: np.ndarray) -> np.ndarray:
    h = left.astype(np.uint64) * np.uint64(256) + length.astype(np.uint64)
    for j in range(matrix.shape[1]):
        h = h * np.uint64(BASE) + matrix[:, j]
    return mixed(h)


def distinct(order: np.ndarray, matrix: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Along an order, True where a row differs from the one before; rows of equal hash are verified by their bytes."""
    head = np.ones(len(order), bool)
    a, b = order[:-1], order[1:]
    maybe = np.ones(len(a), bool)
    for s in same:
        maybe &= s[a] == s[b]
    i = np.flatnonzero(maybe)
    head[i + 1] = (matrix[a[i]] != matrix[b[i]]).any(axis=1)
    return head


def send_surroundings(ranges: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, docs: pa.Table, back: pa.Table) -> pa.Table:
        number = key[0].as_py()
        chunk = Chunk(docs)
        (part, copy), code = _received(back)
        chunk.lay_out(part)
        p, h = chunk.anchors()
        sorted_h, inverse = np.unique(h, return_inverse=True)
        # Codes came back range by range, which is the order of the hashes.
        code = code[inverse] if len(sorted_h) else code
        again = np.flatnonzero(code)
        start, left, length, k, owner = surroundings(chunk, p[again], h[again], code[again])
        matrix = rows_of(chunk.data, start, length)
        doc = chunk.rank[chunk.part[owner]] if len(owner) else np.zeros(0, np.int64)
        whole = whole_hash(matrix, left, length)
        order = np.lexsort((start, doc, whole))
        head = distinct(order, matrix, whole, left, length, k)
        group = np.cumsum(head) - 1
        first = order[head]
        by = np.argsort(range_of(k[first], ranges), kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        item, later = np.empty(len(order), np.uint32), np.empty(len(order), bool)
        item[order] = place[group]
        later[order] = doc[order] > doc[first][group]
        rows = [(number % ranges, number, STATE, _blob(part, copy, np.diff(start, prepend=0).astype(np.int32), item, later, (np.minimum(left, length - LENGTH) + 1).astype(np.uint8)))]
        first = first[by]
        for r, a, b in _by_range(range_of(k[first], ranges)):
            i = first[a:b]
            body = matrix[i][np.arange(REACH) < length[i][:, None]]
            rows.append((r, number, KEYS, _blob((k[i] & np.uint64(0xFFFFFFFF)).astype(np.uint32), doc[i], left[i].astype(np.uint8), length[i].astype(np.uint8), body)))
        return _table(rows, ("r", "chunk", "kind", "blob"))

    return run


# ---- step 3: the suffix sort


class Suffixes:
    """Rows of bytes with polynomial prefix hashes; a suffix is a number row * (REACH + 1) + offset."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.width = matrix.shape[1] + 1
        self.bytes = np.concatenate([matrix, np.zeros((len(matrix), 1), np.uint8)], axis=1).ravel()
        prefix = np.zeros((len(matrix), self.width), np.uint64)
        for j in range(matrix.shape[1]):
            prefix[:, j + 1] = prefix[:, j] * np.uint64(BASE) + matrix[:, j]
        self.prefix = prefix.ravel()

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The lengths of common extensions, LENGTH at most, by binary search over prefix hashes; pairs in blocks that stay in cache."""
        if len(x) <= PAIRS:
            return self._common(x, y)
        return np.concatenate([self._common(x[i : i + PAIRS], y[i : i + PAIRS]) for i in range(0, len(x), PAIRS)])

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whole strings are compared first; only the others are searched, all by the same steps, each from where the last equal one ended."""
        prefix, power = self.prefix, POWER[LENGTH]
        px, py = prefix.take(x), prefix.take(y)
        out = np.full(len(x), LENGTH)
        rest = np.flatnonzero(prefix.take(x + LENGTH) - px * power != prefix.take(y + LENGTH) - py * power)
        x, y, px, py = x[rest], y[rest], px[rest], py[rest]
        start, left = x, LENGTH
        while left:
            step = (left + 1) // 2
            left -= step
            qx, qy = prefix.take(x + step), prefix.take(y + step)
            same = qx - px * POWER[step] == qy - py * POWER[step]
            x, y = x + same * step, y + same * step
            px, py = np.where(same, qx, px), np.where(same, qy, py)
        out[rest] = x - start
        return out

    def before(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(x, y)
        return np.where(n >= LENGTH, or_equal, self.bytes[x + n] < self.bytes[y + n])

    def sort(self, suffix: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The order of suffixes inside segments (ascending, contiguous): a merge sort, all segments level by level."""
        n = len(suffix)
        order = np.arange(n)
        if not n:
            return order
        edges = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1], True])
        length = np.diff(edges)
        begin, end = np.repeat(edges[:-1], length), np.repeat(edges[1:], length)
        width = 1
        while width < length.max():
            at = np.flatnonzero(end - begin > width)
            local = at - begin[at]
            base = begin[at] + local // (2 * width) * (2 * width)
            right = (at - base) >= width
            low = np.where(right, base, np.minimum(base + width, end[at]))
            high = np.where(right, base + width, np.minimum(base + 2 * width, end[at]))
            start = low.copy()
            mine = suffix[order[at]]
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) >> 1
                less = self.before(suffix[order[mid]], mine[open_], right[open_])
                low[open_] = np.where(less, mid + 1, low[open_])
                high[open_] = np.where(less, high[open_], mid)
            own = np.where(right, at - base - width, at - base)
            merged = order.copy()
            merged[base + own + (low - start)] = order[at]
            order = merged
            width *= 2
        return order

    def strings(self, suffix: np.ndarray) -> np.ndarray:
        return self.bytes[suffix[:, None] + np.arange(LENGTH)]

    def runs(self, suffix: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order, and True along it where a run of equal strings of LENGTH bytes begins."""
        order = self.sort(suffix, segment)
        a, b = order[:-1], order[1:]
        head = np.ones(len(order), bool)
        i = np.flatnonzero(segment[a] == segment[b])
        i = i[self.common(suffix[a[i]], suffix[b[i]]) >= LENGTH]
        for at in range(0, len(i), 100_000):
            j = i[at : at + 100_000]
            if (self.strings(suffix[a[j]]) != self.strings(suffix[b[j]])).any():
                return self.exact_runs(suffix, segment)  # hashes collided: sort by the bytes
        head[i + 1] = False
        return order, head

    def exact_runs(self, suffix: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = self.bytes.tobytes()
        order = np.array(sorted(range(len(suffix)), key=lambda i: (segment[i], text[suffix[i] : suffix[i] + LENGTH])), np.int64)
        head = np.ones(len(order), bool)
        for i in range(1, len(order)):
            x, y = order[i - 1], order[i]
            head[i] = segment[x] != segment[y] or text[suffix[x] : suffix[x] + LENGTH] != text[suffix[y] : suffix[y] + LENGTH]
        return order, head


def repeated(key: np.ndarray, doc: np.ndarray, left: np.ndarray, length: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """For each row, a bit for each of its strings: 1 if a smaller document has it."""
    left, length = left.astype(np.int64), length.astype(np.int64)
    whole = whole_hash(matrix, left, length)
    order = np.lexsort((whole, key))
    head = distinct(order, matrix, key, whole, left, length)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    first = order[at]  # a row for each distinct surrounding, ordered by key
    least = np.minimum.reduceat(doc[order], at)
    strings = np.minimum(left, length - LENGTH)[first] + 1
    # smallest[i, o]: the smallest document with the string at offset o of surrounding i
    smallest = np.repeat(least[:, None], WINDOW, axis=1)
    k = key[first]
    alone = np.r_[True, k[1:] != k[:-1]] & np.r_[k[1:] != k[:-1], True]
    shared = np.flatnonzero(~alone)
    if len(shared):
        n = strings[shared]
        row = np.repeat(np.arange(len(shared)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = left[first[shared]][row] - offset  # of the anchor in the string; equal strings agree on it
        segment = np.unique(k[shared], return_inverse=True)[1][row] * WINDOW + place
        by = np.argsort(segment, kind="stable")
        row, offset, segment = row[by], offset[by], segment[by]
        size = np.diff(np.flatnonzero(np.r_[True, segment[1:] != segment[:-1], True]))
        several = np.repeat(size, size) > 1
        row, offset, segment = row[several], offset[several], segment[several]
        sorter = Suffixes(matrix[first[shared]])
        run_order, run_head = sorter.runs(row * sorter.width + offset, segment)
        if len(run_order):
            edges = np.flatnonzero(run_head)
            of_run = np.minimum.reduceat(least[shared][row[run_order]], edges)
            smallest[shared[row[run_order]], offset[run_order]] = np.repeat(of_run, np.diff(np.r_[edges, len(run_order)]))
    bits = smallest[group] < doc[:, None]
    bits &= np.arange(WINDOW) < strings[group][:, None]
    return (bits * (np.uint32(1) << np.arange(WINDOW, dtype=np.uint32))).sum(axis=1, dtype=np.uint32)


def find_repeated(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table["chunk"].to_pylist(), table["kind"].to_pylist(), table["r"].to_pylist(), table["blob"].to_pylist(), strict=True), key=lambda x: x[:2])
    out = [x for x in rows if x[1] == STATE]
    rows = [x for x in rows if x[1] == KEYS]
    if rows:
        parts = [_arrays(x[3]) for x in rows]
        key, doc, left, length, body = (np.concatenate([p[i] for p in parts]) for i in range(5))
        ends = np.cumsum(length, dtype=np.int64)
        masks = repeated(key, doc, left, length, rows_of(body, ends - length, length.astype(np.int64)))
        at = 0
        for (chunk, kind, r, _), p in zip(rows, parts, strict=True):
            out.append((chunk, kind, r, _blob(masks[at : at + len(p[0])])))
            at += len(p[0])
    return _table(out, ("home", "kind", "r", "blob"))


def covered(chunk: Chunk, state: tuple, masks: np.ndarray) -> list[np.ndarray]:
    """For every document of a chunk, True for each byte to remove."""
    part, copy, start, item, later, n = state
    chunk.lay_out(part)
    start = np.cumsum(start, dtype=np.int64)
    change = np.zeros(len(chunk.data) + LENGTH + 1, np.int32)
    if len(start):
        bits = np.where(later, np.uint32((1 << WINDOW) - 1), masks[item])
        for o in range(WINDOW):
            s = start[(bits >> np.uint32(o) & np.uint32(1) == 1) & (o < n)] + o
            np.add.at(change, s, 1)
            np.add.at(change, s + LENGTH, -1)
    gone = np.cumsum(change)[: len(chunk.data)] > 0
    out = [np.full(len(t), c and len(t) >= LENGTH, bool) for t, c in zip(chunk.texts, copy, strict=True)]
    for i, a, b in zip(chunk.part, chunk.starts, chunk.ends, strict=True):
        out[i] = gone[a:b]
    return out


def spans(gone: np.ndarray) -> np.ndarray:
    """Start and end of the maximal removed runs."""
    change = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    return change.reshape(-1, 2)


def cut_out(docs: DataFrame, finish: Callable[[Chunk, pa.Table, list[np.ndarray]], pa.Table], schema: str, keep: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """Runs the three steps; ``finish`` makes a chunk's result of its documents and what is removed of them."""
    size = text_bytes(docs)
    chunks, ranges = max(24, -(-size // CHUNK)), max(12, -(-size // RANGE))
    body = F.coalesce("text", F.lit("")).cast("binary")
    # Rows of one id, or of none, are dealt out by their texts as well.
    rows = docs.select("doc_id", body.alias("body"), *keep, F.pmod(F.xxhash64(F.lit("chunk"), "doc_id", body), F.lit(chunks)).cast("int").alias("chunk"))
    placed = rows.repartition(max(12, chunks // 4), "chunk")
    ids = cut(rows.where("doc_id is not null").select("doc_id", "chunk", F.unhex(F.sha2("body", 256)).alias("digest")))
    first = ids.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("last > first").drop("last")
    copies = join_by_key(ids, first, "digest", "n", ids.count()).where("doc_id > first")
    back = copies.select(F.col("chunk").alias("home"), F.lit(COPY).alias("kind"), F.col("doc_id").alias("r"), F.col("digest").alias("blob"))

    def end(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        state, masks = _received(back)
        return finish(chunk, table, covered(chunk, state, masks))

    for send, find in ((send_anchors(ranges), find_shared(hot)), (send_surroundings(ranges), find_repeated)):
        sent = placed.groupBy("chunk").cogroup(back.groupBy("home")).applyInArrow(send, FORWARD)
        back = sent.groupBy("r").applyInArrow(find, BACK)
    return placed.groupBy("chunk").cogroup(back.groupBy("home")).applyInArrow(end, schema)


def digests(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is kept."""

    def finish(chunk: Chunk, _: pa.Table, gone: list[np.ndarray]) -> pa.Table:
        kept = [np.frombuffer(t, np.uint8)[~g].tobytes() for t, g in zip(chunk.texts, gone, strict=True)]
        return pa.table({
            "doc_id": pa.array(chunk.ids, pa.int64()), "n_bytes": pa.array([len(t) for t in chunk.texts], pa.int64()),
            "n_removed": pa.array([int(g.sum()) for g in gone], pa.int64()), "n_spans": pa.array([len(spans(g)) for g in gone], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})

    return cut_out(docs.withColumn("doc_id", F.col("doc_id").cast("long")), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", hot=hot)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with repeated strings taken out of ``text`` (n_chars follows).

    A character that loses some of its bytes is dropped whole.
    """
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    kinds = dict(docs.dtypes)

    def finish(chunk: Chunk, table: pa.Table, gone: list[np.ndarray]) -> pa.Table:
        table = table.take(pa.array(chunk.order))
        texts = [np.frombuffer(t, np.uint8)[~g].tobytes().decode("utf-8", "ignore") for t, g in zip(chunk.texts, gone, strict=True)]
        out = {"doc_id": pa.array(chunk.ids, pa.int64()), "text": pa.array(texts, pa.string())}
        for c in names:
            out[c] = table[f"kept_{c}"]
        if "n_chars" in out:
            out["n_chars"] = pa.array([len(t) for t in texts], pa.int64())
        return pa.table({c: out[c] for c in ("doc_id", "text", *names)})

    renamed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(f"`{c}`").alias(f"kept_{c}") for c in names))
    schema = "doc_id long, text string" + "".join(f", `{c}` {'long' if c == 'n_chars' else kinds[c]}" for c in names)
    return cut_out(renamed, finish, schema, tuple(f"kept_{c}" for c in names)).select(*docs.columns)
