"""License scans by patience alignment of texts with license templates.

Words that are unique in both the text and the template anchor the alignment:
their longest increasing subsequence is matched, and the gaps between anchors
are aligned in the same way. In a gap without unique common words, equal words
at its edges are matched, then what is left by the longest common subsequence.
A template's coverage is the share of its words matched inside the best stretch
of the text: of all stretches of up to twice the template's words, the one
with the longest common subsequence, and of those the shortest. A patience
alignment of the whole template to consecutive words can't be bettered; any
other (repeated notices have no unique words) gives way to the exact search
over all stretches, whose work is stretch by template, without a limit.

A template is only aligned if the text holds enough of its words: how many of
its distinct words there are, and then the multiset intersection, are upper
bounds of what any alignment can match, so skipping below the threshold loses
nothing. Templates go with the task (they are a
fixed, small table); documents are scanned whole and without a shuffle.

What tells licenses apart is not left to coverage: a sentence that does no more
than name a license must stand there word for word, and a stretch that names
another version, or another of the family (lesser, affero, neither), isn't the
template's however many words they share.

Every template at or over the threshold is told with its best stretch, the best
template first; the columns of the single license are those of the first.

Defined cases: null and empty texts, and texts under every threshold, get no
license: license null, coverage 0, span null, no licenses. Ties go to the
longer template, then the name; a license whose words another holds in order is
told beside it. Repeated rows get equal results.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.license_texts import FAMILIES, NAMING, TEMPLATES

THRESHOLD = 0.8
NONE = (None, 0.0, 0, None, None)
NUMBER = re.compile(r"\d+(?:\.\d+)*")
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words_of(text: str) -> tuple[list[str], list[int], list[int]]:
    """Lower-cased words, and where each begins and ends."""
    found = list(WORD.finditer(text))
    return [m[0].lower() for m in found], [m.start() for m in found], [m.end() for m in found]


def versions(words: Sequence[str]) -> set[str]:
    """The numbers that follow the word version, or v."""
    return {b for a, b in zip(words, words[1:], strict=False) if a in ("version", "v") and NUMBER.fullmatch(b)}


def increasing(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (ordered by the first) that increases in the second, by patience piles."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back[i] = last[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(y)
            last.append(i)
        else:
            tops[pile], last[pile] = y, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def subsequence(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence: bit j of a row is 0 where word j of b adds a match."""
    at: dict[str, int] = {}
    for j, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << j
    whole = (1 << len(b)) - 1
    rows = [whole]
    for w in a:
        row = rows[-1]
        hit = row & at.get(w, 0)
        rows.append(((row + hit) | (row - hit)) & whole if hit else row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif rows[i - 1] >> (j - 1) & 1:
            i, j = i - 1, j - 1
            out.append((i, j))
        else:
            i -= 1
    return out[::-1]


def best_stretch(a: Sequence[str], b: Sequence[str], most: int) -> tuple[int, int, int]:
    """Of all stretches of up to ``most`` words of a, the first of the shortest with the longest common subsequence with b: its length, start and end.

    Semi-local comparison: word i of a adds no match to stretches that begin at
    or before ``lost[i]``, so a stretch's subsequence is its length without the
    words in it that are lost to it.
    """
    at: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        at.setdefault(w, []).append(j)
    strands, lost = [-1 - j for j in range(len(b))], []
    for i, w in enumerate(a):
        h = i
        if w in at:
            j = at[w][0]  # i is the largest strand: nothing turns before its first match
            h, strands[j] = strands[j], h
            for j in range(j + 1, len(b)):
                if h < strands[j] or b[j] == w:
                    h, strands[j] = strands[j], h
        lost.append(h)
    where = {h: i for i, h in enumerate(lost) if h >= 0}

    def without(start: int, end: int) -> bool:
        """Whether the stretch keeps its matches without its first word."""
        return where.get(start, end) < end

    best, s, n = 0, 0, 0
    for e in range(len(a)):
        n += lost[e] < s
        if e + 1 - s > most:
            n -= not without(s, e + 1)
            s += 1
        best = max(best, n)
    found, s, n = (len(a) + 1, 0, 0), 0, 0
    for e in range(len(a)):
        n += lost[e] < s
        while s <= e and (n > best or without(s, e + 1)):
            n -= not without(s, e + 1)
            s += 1
        if n == best and e + 1 - s < found[0]:
            found = (e + 1 - s, s, e + 1)
    return best, found[1], found[2]


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Matched index pairs of two word sequences, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        in_a, in_b = Counter(a[i:k]), Counter(b[j:m])
        at = {b[y]: y for y in range(j, m) if in_b[b[y]] == 1}
        anchors = increasing([(x, at[a[x]]) for x in range(i, k) if in_a[a[x]] == 1 and a[x] in at])
        if anchors:
            out += anchors
            for (x, y), (x2, y2) in zip([(i - 1, j - 1), *anchors], [*anchors, (k, m)], strict=True):
                todo.append((x + 1, x2, y + 1, y2))
        else:
            out += [(i + x, j + y) for x, y in subsequence(a[i:k], b[j:m])]
    return sorted(out)


def densest(pairs: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """The largest set of matches within ``most`` words of the text."""
    best, low = (0, 0), 0
    for high in range(len(pairs)):
        while pairs[high][0] - pairs[low][0] >= most:
            low += 1
        if high + 1 - low > best[1] - best[0]:
            best = (low, high + 1)
    return pairs[best[0] : best[1]]


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        self.templates = [(name, words, counts, counts.keys()) for name, t in sorted((templates or TEMPLATES).items()) if (counts := Counter(words := words_of(t)[0]))]
        self.vocabulary = {w for _, words, _, _ in self.templates for w in words}

    def every(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """All licenses, the best first: name, coverage, words matched, and the stretch in characters."""
        out: list[tuple[int, tuple]] = []
        words, starts, ends = words_of(text or "")
        here = Counter(w for w in words if w in self.vocabulary)
        for name, template, counts, distinct in self.templates:
            need = len(template) if name in NAMING else self.threshold * len(template)
            # A distinct word that the text lacks is one match less at least.
            if len(template) - len(distinct) + len(distinct & here.keys()) < need or sum(min(n, here[w]) for w, n in counts.items()) < need:
                continue
            best, span = 0, (0, 0)
            for low, high in self.windows(words, counts, len(template), need):
                n, first, end = self.verbatim(words[low:high], template) if name in NAMING else self.stretch(words[low:high], template)
                if n > best and not self.another(words[low + first : low + end + 1], template):
                    best, span = n, (starts[low + first], ends[low + end - 1])
            if best and best / len(template) >= self.threshold:
                out.append((len(template), (name, best / len(template), best, *span)))
        return [x for _, x in sorted(out, key=lambda x: (-x[1][1], -x[0], x[1][0]))]

    def scan(self, text: str | None) -> tuple[str | None, float, int, int | None, int | None]:
        """The best license: name, coverage, words matched, and the stretch in characters."""
        return next(iter(self.every(text)), NONE)

    @staticmethod
    def verbatim(words: list[str], template: list[str]) -> tuple[int, int, int]:
        """The first place where the template's words stand one after another."""
        n = len(template)
        at = next((i for i, w in enumerate(words) if w == template[0] and words[i : i + n] == template), None)
        return (0, 0, 0) if at is None else (n, at, at + n)

    @staticmethod
    def another(stretch: list[str], template: list[str]) -> bool:
        """Whether a stretch, with the word behind it, names another version or family than the template."""
        named = versions(template)
        return bool(named and versions(stretch) - named) or FAMILIES & set(stretch) != FAMILIES & set(template)

    @staticmethod
    def stretch(words: list[str], template: list[str]) -> tuple[int, int, int]:
        """How many template words the best stretch matches, and where it begins and ends."""
        n = len(template)
        matched = densest(align(words, template), 2 * n)
        if len(matched) == n and matched[-1][0] - matched[0][0] == n - 1:
            return n, matched[0][0], matched[-1][0] + 1
        return best_stretch(words, template, 2 * n)

    def windows(self, words: list[str], counts: Counter, n: int, need: float) -> Iterator[tuple[int, int]]:
        """Merged stretches that hold enough template words in some window of 2 n words: words outside can't be in a match that counts."""
        span, here, held = 2 * n, Counter(), 0
        open_: tuple[int, int] | None = None
        for i, w in enumerate(words):
            if w in counts:
                here[w] += 1
                held += here[w] <= counts[w]
            if i >= span and (old := words[i - span]) in counts:
                held -= here[old] <= counts[old]
                here[old] -= 1
            if held >= need:
                low = max(0, i + 1 - span)
                if open_ and low <= open_[1]:
                    open_ = (open_[0], i + 1)
                else:
                    if open_:
                        yield open_
                    open_ = (low, i + 1)
        if open_:
            yield open_


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, coverage, n_matched, span_start, span_end and all licenses (an array of these five) for every document."""
    names = ["license", "coverage", "n_matched", "span_start", "span_end"]
    kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    kinds.append(pa.list_(pa.struct(list(zip(names, kinds, strict=True)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            found = [scanner.every(t.as_py()) for t in batch.column(1)]
            rows = [(*next(iter(x), NONE), [dict(zip(names, y, strict=True)) for y in x]) for x in found]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *names, "licenses"])

    one = "license string, coverage double, n_matched long, span_start long, span_end long"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {one}, licenses array<struct<{one.replace(' ', ':').replace(',:', ',')}>>")
