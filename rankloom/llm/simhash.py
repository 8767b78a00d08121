"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; bit i is 1 if it is set in over half of the hashes
of a text's shingles. Fingerprints that differ in at most ``distance`` bits
link. They are cut into so few segments (distance // 2 + 1) that one segment
differs in one bit at most; each segment is indexed once for each of its bits,
with that bit deleted. Linked fingerprints share a variant, found by equality,
and every candidate is verified on the whole fingerprint.

Documents of equal fingerprints form a class and only classes are indexed.
Rows of a variant meet in one run; runs emit the links of a spanning forest,
never all pairs, and components are contracted over these. Short runs are
compared in whole, all runs of a batch at once. Long runs are searched from
member to member: a member takes what it links to out of the rest, so a dense
group costs a few passes over it, and no pair that could join two groups is
skipped. Runs beyond ``SPLIT`` members are cut anew by the bits outside the
segment that they share, by the same signatures, before they are searched: a
pair that links has one of these in common too.

Texts are hashed ``PIECE`` bytes at a time, so a very long one needs little
memory besides its own.

Defined cases: null, empty and blank texts have fingerprint 0 and link like
others. Fewer words than a shingle are one shingle. Repeated rows are in one
class. Fingerprints are the nodes, so rows of one id and different texts are
linked by nothing but their fingerprints. A null id gets its class's component
and names none; components of null ids only are null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import cut, fresh, join_by_key
from rankloom.llm.components import components

SEED = 42
#: Bytes of a text that are cut into words at once; a longer word is whole.
PIECE = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Runs longer than this are searched member by member.
SHORT = 24
#: Runs longer than this are cut anew by the bits that their variant doesn't tell.
SPLIT = 4096
#: Rows of whole runs that are compared at once.
ROWS = 400_000


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """Lower-cased (A-Z) runs of non-blank bytes, those of a piece of the text at a time."""
    raw, at = (text or "").encode("utf-8", "replace"), 0
    while at < len(raw):
        to = len(raw)
        if at + PIECE < to and (blank := BLANK.search(raw, at + PIECE)):
            to = blank.end()
        yield raw[at:to].lower().split()
        at = to


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, those of a piece of the text at a time."""
    digest, held, made = xxhash.xxh64_intdigest, [], False
    for words in words_of(text):
        words = held + words
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = [0, *(ends[: len(words) - size] + 1).tolist()]
            yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts))
            made = True
        held = words[len(words) - size + 1 :] if len(words) >= size else words
    if held and not made:
        yield np.array([digest(b" ".join(held), SEED)], np.uint64)


def majority(pieces: Iterator[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes, as an unsigned number."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in pieces:
        for at in range(0, len(hashes), ROWS):
            part = np.ascontiguousarray(hashes[at : at + ROWS], "<u8")
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (64 bits as a long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def variants(fp: Column, distance: int) -> Column:
    """The signatures of a fingerprint: every segment with one of its bits deleted."""
    parts = distance // 2 + 1
    edges = [64 * i // parts for i in range(parts + 1)]
    found = []
    for low, high in zip(edges, edges[1:], strict=False):
        segment = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1)) if high - low < 64 else fp
        for bit in range(high - low):
            rest = segment.bitwiseAND(F.lit(~(1 << bit)))
            found.append(rest.bitwiseXOR(F.lit((low + bit) << 44)) if high - low <= 44 else F.xxhash64(F.lit(low + bit), rest))
    return F.array(*found)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class _Forest:
    """Union-find over nodes of a task; tells which links joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        if len(self.up) > 2_000_000:
            self.up.clear()  # links may repeat from here on; none is lost
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links(key: np.ndarray, node: np.ndarray, marks: list[np.ndarray], limits: list[tuple[int, int]], forest: _Forest) -> tuple[list[int], list[int]]:
    """Forest links among rows of equal key (sorted by it, runs whole).

    Rows link if, for each (columns, bits) of limits, that many mark columns
    differ in so many bits at most.
    """
    from_, to = [], []

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok, at = None, 0
        for width, most in limits:
            d = sum(_popcount(marks[c][i] ^ marks[c][j]).astype(np.int32) for c in range(at, at + width))
            ok = (d <= most) if ok is None else ok & (d <= most)
            at += width
        return ok

    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    length = np.diff(edges)
    size = np.repeat(length, length)
    short = np.flatnonzero((size > 1) & (size <= SHORT))
    for k in range(1, SHORT):
        i = short[short + k < len(key)]
        i = i[key[i] == key[i + k]]
        if not len(i):
            break
        i = i[near(i, i + k)]
        for a, b in zip(node[i].tolist(), node[i + k].tolist(), strict=True):
            if a != b and forest.join(a, b):
                from_.append(a)
                to.append(b)
    def search(rest: np.ndarray) -> None:
        while len(rest):
            waiting, rest = [rest[0]], rest[1:]
            while waiting and len(rest):
                x = waiting.pop()
                found = near(np.full(len(rest), x), rest)
                hit, rest = rest[found], rest[~found]
                waiting += hit.tolist()
                for b in node[hit].tolist():
                    if b != node[x] and forest.join(int(node[x]), b):
                        from_.append(int(node[x]))
                        to.append(b)

    for r in np.flatnonzero(length > SHORT):
        run = np.arange(edges[r], edges[r + 1])
        for part in [run] if len(run) <= SPLIT or len(limits) > 1 else cut_anew(run, marks[0], limits[0][1]):
            search(part)
    return from_, to


def cut_anew(run: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """Parts of a run of one variant such that any two members within the distance share one.

    Members differ by at most one bit in the segment that their variant is of;
    the bits in which any of them differ from the first make up the rest. These
    are cut into segments like whole fingerprints are.
    """
    fps = fp[run]
    differing = np.bitwise_or.reduce(fps ^ fps[0])
    bits = [i for i in range(64) if int(differing) >> i & 1]
    parts = distance // 2 + 1
    for segment in (bits[len(bits) * i // parts : len(bits) * (i + 1) // parts] for i in range(parts)):
        for gone in segment or [None]:
            mask = np.uint64(sum(1 << i for i in segment if i != gone))
            key = fps & mask
            order = np.argsort(key, kind="stable")
            ends = np.flatnonzero(np.r_[key[order][1:] != key[order][:-1], True]) + 1
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if b - a > 1:
                    yield run[order[a:b]]


def links(rows: DataFrame, limits: list[tuple[int, int]], partitions: int) -> DataFrame:
    """Links (a, b) between nodes of rows(key, node, marks...) that share a key and pass the limits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, parts, waiting, enough = _Forest(), [], 0, ROWS

        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _links(rows[0], rows[1], [x.view(np.uint64) for x in rows[2:]], limits, forest)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def joined() -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*parts, strict=True)]

        for batch in batches:
            parts.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            waiting += batch.num_rows
            if waiting < enough:
                continue
            held = joined()
            whole = int(np.searchsorted(held[0], held[0][-1]))  # the last run may go on
            if whole:
                yield out([x[:whole] for x in held])
            parts = [[x[whole:].copy() for x in held]]
            waiting -= whole
            enough = max(ROWS, 2 * waiting)  # a run of many batches is put together a few times, not for each
        if waiting:
            yield out(joined())

    return rows.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def partitions_for(rows: int, each: int = 500_000) -> int:
    return max(8, -(-rows // each))


#: Rows that a component's name is copied to, so that the classes of a large one don't meet in one task.
COPIES = 32


def near_fingerprints(fps: DataFrame, n: int, distance: int = 4) -> DataFrame:
    """node, component (a name for all that are reachable) of each of n distinct fingerprints (a column fp) that links to another."""
    indexed = fps.select(F.explode(variants(F.col("fp"), distance)).alias("key"), F.col("fp").alias("node"), "fp")
    return components(links(indexed, [(1, distance)], partitions_for(n * 64)))


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) for every document."""
    fps = cut(fingerprints(docs, shingle))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = near_fingerprints(classes, classes.count(), distance)
    joined = cut(classes.join(found.withColumnRenamed("node", "fp"), "fp", "left"))
    several = joined.where("component is not null")
    names = several.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    named = several.withColumn("copy", F.pmod(F.xxhash64("fp"), F.lit(COPIES)).cast("int")).join(names, ["component", "copy"]).select("fp", "component_id", "n")
    labelled = cut(named.unionByName(joined.where("component is null").select("fp", F.col("least").alias("component_id"), "n")))
    return join_by_key(fps, labelled, "fp", "n", fps.count()).select("doc_id", "fp", "component_id")


#: Of ``one_of_each``: a shared part of all shingles of two texts that makes them near copies; least hashes of a band,
#: and bands (a pair of 0.8 shares none with a probability of 3e-6); bits of 128 in which sketches of a candidate may
#: differ (a similarity of 0.8 gives 13 on average, with a deviation of 3.4).
SIMILAR, WIDTH, BANDS, SKETCH_BITS = (4, 5), 5, 32, 34
_random = np.random.default_rng(SEED)
_FLIP = _random.integers(0, 2**64, (WIDTH * BANDS, 1), np.uint64)
_TIMES = _random.integers(0, 2**64, (WIDTH * BANDS, 1), np.uint64) | np.uint64(1)
_MIX = _random.integers(0, 2**64, (BANDS, WIDTH), np.uint64) | np.uint64(1)
#: Slots of shingles that bound the number two sets share; shingles that are hashed at once.
SLOTS, AT_ONCE = 1 << 20, 1024
#: Shingles of a block of candidates; a task that verifies them holds about two blocks.
BLOCK = 1 << 21


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(x) for x in shingle_hashes(text, size))]))


def set_digest(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least of each of WIDTH * BANDS other hashes of a set."""
    least = np.full(WIDTH * BANDS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), AT_ONCE):
        np.minimum(least, ((hashes[at : at + AT_ONCE] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    return least


def sketches(docs: DataFrame, shingle: int = 5, fingerprinted: int = 4) -> DataFrame:
    """doc_id, the text's fingerprint fp, and of its distinct shingles: a digest d, their number, a key for each band, and two sketches of 64 bits (a bit each of 128 least hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, d, sizes, bands, bits = [], [], [], [], []
            for t in batch.column(1):
                text = t.as_py()
                fps.append(majority(shingle_hashes(text, fingerprinted)))
                hashes = shingle_set(text, shingle)
                least = min_hashes(hashes)
                mixed = (least.reshape(BANDS, WIDTH) * _MIX).sum(axis=1, dtype=np.uint64)
                d.append(set_digest(hashes))
                sizes.append(len(hashes))
                bands.append(mixed ^ (mixed >> np.uint64(31)))
                bits.append(np.packbits((least[:128] >> np.uint64(31) & np.uint64(1)).astype(bool), bitorder="little").view("<u8"))
            keys = pa.array(np.concatenate(bands or [np.zeros(0, np.uint64)]).view(np.int64))
            k1, k2 = np.array(bits, np.uint64).reshape(-1, 2).T
            offsets = pa.array(np.arange(len(d) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed(fps), _signed(d), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, keys), _signed(k1), _signed(k2)], names=["doc_id", "fp", "d", "size", "bands", "k1", "k2"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long, d long, size long, bands array<long>, k1 long, k2 long")


def connected(sets: list[np.ndarray]) -> np.ndarray:
    """A group number for each of some sorted sets: groups are connected by pairs of at least the similarity, all exactly compared.

    Sets are searched from member to member, as long runs are: each takes what
    it links to out of the rest. Slots give an upper bound of what two sets
    share, so only pairs that may reach the similarity are intersected.
    """
    part, of = SIMILAR
    sizes = np.array([len(x) for x in sets], np.int64)
    group = np.full(len(sets), -1, np.int64)
    slots = [(x & np.uint64(SLOTS - 1)).astype(np.int32) for x in sets]
    flat, owner = np.concatenate(slots), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    marked, rest, number = np.zeros(SLOTS, bool), np.arange(len(sets)), 0
    while len(rest):
        waiting, rest = [int(rest[0])], rest[1:]
        group[waiting[0]] = number
        while waiting and len(rest):
            x = waiting.pop()
            marked[slots[x]] = True
            shared = np.bincount(owner[marked[flat]], minlength=len(sets))[rest]
            marked[slots[x]] = False
            found = []
            for y in rest[(of + part) * shared >= part * (sizes[x] + sizes[rest])].tolist():
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if of * both >= part * (len(sets[x]) + len(sets[y]) - both):
                    found.append(y)
            if found:
                group[found] = number
                waiting += found
                rest = rest[group[rest] < 0]
                left = group[owner] < 0
                flat, owner = flat[left], owner[left]
        number += 1
    return group


def verified(members: DataFrame, by: list[str], shingle: int, partitions: int) -> DataFrame:
    """d, keeper, lead (the smallest node of its group, and the digest of that) of members(by..., d, node, text); rows equal in ``by`` are compared in whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
            group = connected([x for _, x in held.values()]).tolist()
            least: dict[int, tuple[int, int]] = {}
            for g, (d, (node, _)) in zip(group, held.items(), strict=True):
                least[g] = min((node, d), least.get(g, (node, d)))
            keepers, leads = zip(*(least[g] for g in group), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(held), keepers, leads)], names=["d", "keeper", "lead"])

        at, held = None, {}
        for batch in batches:
            for *group, d, node, text in zip(*batch.columns, strict=True):
                group, d = [x.as_py() for x in group], d.as_py()
                if group != at:
                    if held:
                        yield out(held)
                    at, held = group, {}
                if d not in held:
                    hashes = shingle_set(text.as_py(), shingle)
                    if set_digest(hashes) == d % 2**64:  # else another row of the same doc_id
                        held[d] = node.as_py(), hashes
        if held:
            yield out(held)

    rows = members.select(*by, "d", "node", "text").repartition(partitions, *by).sortWithinPartitions(*by)
    return rows.mapInArrow(run, "d long, keeper long, lead long")


def in_pairs_of_blocks(dealt: DataFrame) -> DataFrame:
    """component, i, j, d, node of dealt(component, d, node, blocks): a row for each pair of blocks (i, j) that a member is in.

    Members are dealt to blocks by hash, and any two meet in a pair of blocks.
    """
    own = F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int")
    paired = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other")
    return paired.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "d", "node")


def keepers(members: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """d, keeper (the smallest node of its group) of candidates, members(component, d, node, size), compared by the texts of docs.

    A component of up to two blocks of shingles is compared in one task. A
    larger one is dealt into blocks, whose pairs are compared, each in a task,
    and what they link is connected anew: the same groups, as every two members
    meet in a pair.
    """

    def with_text(rows: DataFrame) -> DataFrame:
        return rows.join(docs.select("doc_id", "text"), F.col("node") == F.col("doc_id"))

    n = members.count()
    blocks = F.when(F.sum("size") > 2 * BLOCK, F.ceil(F.sum("size") / BLOCK)).otherwise(1).cast("int")
    blocks = cut(members.groupBy("component").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("n")))
    if not blocks.where("blocks > 1").head(1):
        return verified(with_text(members), ["component"], shingle, partitions_for(n, 20_000)).select("d", "keeper")
    dealt = cut(join_by_key(members, blocks, "component", "n", n))
    small, large = dealt.where("blocks = 1"), dealt.where("blocks > 1")
    pairs = cut(in_pairs_of_blocks(large))
    linked = verified(with_text(pairs), ["component", "i", "j"], shingle, partitions_for(pairs.count(), 20_000))
    found = components(linked.select(F.col("d").alias("a"), F.col("lead").alias("b"))).withColumnRenamed("node", "d")
    found = cut(found.join(large.select("d", "node"), "d"))
    least = found.groupBy("component").agg(F.min("node").alias("keeper"), F.count(F.lit(1)).alias("n"))
    named = join_by_key(found, least, "component", "n", found.count()).select("d", "keeper")
    return named.unionByName(verified(with_text(small), ["component"], shingle, partitions_for(n, 20_000)).select("d", "keeper"))


def by_fingerprints(rows: DataFrame) -> DataFrame:
    """Links (a, b) between digests d of rows(d, fp) whose fingerprints are equal or reach one another by links, as ``near_duplicates`` finds them: stars."""
    held = cut(rows.groupBy("fp", "d").agg(F.count(F.lit(1)).alias("n")))
    fps = cut(held.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    found = near_fingerprints(fps, fps.count()).withColumnRenamed("node", "fp")
    named = join_by_key(held.select("fp", "d"), cut(fps.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "n")), "fp", "n", held.count())
    named = cut(named.select("component", "d").distinct())
    centres = cut(named.groupBy("component").agg(F.min("d").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return join_by_key(named, centres, "component", "n", named.count()).where("d <> b").select(F.col("d").alias("a"), "b")


def candidates(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """node, component: digests that links of fingerprints or of bands of least hashes, whose sketches are alike, connect."""
    indexed = classes.select(F.explode("bands").alias("key"), F.col("d").alias("node"), "k1", "k2")
    banded = links(indexed, [(2, SKETCH_BITS)], partitions_for(classes.count() * BANDS))
    return components(by_fingerprints(rows.where("doc_id is not null").select("d", "fp")).unionByName(banded))


def one_of_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The documents, all columns, without near copies: the smallest doc_id of each group stays.

    Texts are near copies if the Jaccard similarity of their distinct shingles
    is 0.8 or more; groups are connected by such pairs. Texts of equal shingles
    are one class. SimHash finds candidates, as in ``near_duplicates``: all that
    reach one another by fingerprints of four-word shingles. Texts of the
    similarity whose fingerprints differ in more bits (a passage put in) are
    found by bands of least hashes, whose sketches drop unlike ones.
    Components of both are then compared by their whole shingle
    sets, at most about two blocks in a task, so no document goes without a
    pair of the similarity.
    Rows of equal doc_id stay or go together; null ids stay.
    """
    rows = cut(sketches(docs.select("doc_id", "text"), shingle))
    classes = cut(rows.groupBy("d").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"), *(F.any_value(c).alias(c) for c in ("size", "bands", "k1", "k2"))).where("node is not null"))
    loose = candidates(rows, classes)
    members = cut(classes.select("d", "node", "size").join(loose.withColumnRenamed("node", "d"), "d").select("component", "d", "node", "size"))
    labelled = cut(classes.select("d", "node", "n").join(keepers(members, docs, shingle), "d", "left").select("d", F.coalesce("keeper", "node").alias("keeper"), "n"))
    gone = fresh("gone", docs)
    going = join_by_key(rows.select("doc_id", "d"), labelled, "d", "n", rows.count()).where("doc_id <> keeper").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(cut(going), F.col("doc_id") == F.col(gone), "left_anti")


def digests(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
