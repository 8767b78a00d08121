"""Document fingerprints by one-permutation MinHash, as DataFrame functions.

The shingles of a text are hashed once; a hash's low bits name its bin and the
rest is its value, and each bin keeps its least value. An empty bin borrows
from another by optimal densification: it follows its own random order of the
bins, which depends on nothing but the bin, to the first one that is filled.
The fingerprint packs the low ``BITS`` bits of all bins as hexadecimal.

Two fingerprints' share of equal bins, E, overstates the likeness because low
bits also agree by chance; ``likeness`` corrects it: (E - c) / (1 - c) with
c = 2^-BITS, 0 at least.

Defined cases: words are lower-cased runs of non-blanks and shingles have five
words; a text of fewer words is one shingle, and one of none (null, empty,
blank) is the shingle of no words, so all such texts are alike and nothing
else is like them. Null and repeated ids keep their rows; ids may be anywhere
in the range of long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import BLANKS, cut, let

BINS, BITS, SHINGLE = 256, 8, 5
#: A bin's number stands above its value, so that sorting groups hashes by bin.
SHIFT = 55
EMPTY = (1 << SHIFT) - 1
PROBES = 8
#: Quantiles of the ids, and parts that each is cut into at most; their product bounds the table that is broadcast (some 50 MB).
QUANTILES, PARTS = 1000, 1000


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    words = F.filter(F.split(F.lower(text), BLANKS), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def over(h: Column) -> Column:
        n = F.size(h)
        one = F.transform(F.array(n), lambda k: F.xxhash64(k, h))
        many = F.transform(F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(shingle))))
        return F.when(n >= shingle, many).otherwise(one)

    return let(hashes, over)


def signature(text: Column) -> Column:
    """The low bits of all bins, array<int>."""
    placed = F.transform(shingle_hashes(text), lambda h: h.bitwiseAND(F.lit(BINS - 1)) * F.lit(1 << SHIFT) + F.shiftrightunsigned(h, 64 - SHIFT + 1))
    empties = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: i.cast("long") * F.lit(1 << SHIFT) + F.lit(EMPTY))
    ordered = F.sort_array(F.concat(placed, empties))

    def bin_of(x: Column) -> Column:
        return F.shiftrightunsigned(x, SHIFT)

    def value_of(x: Column) -> Column:
        return x.bitwiseAND(F.lit(EMPTY))

    def least(all_: Column) -> Column:
        return F.filter(all_, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(all_, i - 1))))

    def filled(d: Column, at: Column) -> Column:
        return F.when(value_of(F.get(d, at)) != EMPTY, value_of(F.get(d, at)))

    def dense(d: Column) -> Column:
        present = F.filter(d, lambda x: value_of(x) != EMPTY)

        def fill(p: Column) -> Column:
            def borrowed(i: Column) -> Column:
                probes = [filled(d, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
                last = F.array_min(F.transform(p, lambda x: F.struct(F.xxhash64(i, bin_of(x)).alias("turn"), value_of(x).alias("value"))))["value"]
                return F.coalesce(filled(d, i), *probes, last)

            return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: borrowed(i).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))

        return let(present, fill)

    return let(ordered, lambda a: let(least(a), dense))


def packed(bins: Column) -> Column:
    """Lower-case hexadecimal of the bins' low bits."""
    digits = F.array(*(F.lit(format(i, f"0{BITS // 4}x")) for i in range(1 << BITS)))
    return F.array_join(F.transform(bins, lambda v: F.get(digits, v)), "")


def likeness(a: Column, b: Column) -> Column:
    """An unbiased estimate of the Jaccard similarity of two texts' shingles, 0 to 1."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / float(BINS)
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, a row for each document."""
    return docs.select("doc_id", packed(signature(F.coalesce("text", F.lit("")))).alias("fingerprint"))


def last_not_above(bounds: Column, most: int, value: Column) -> Column:
    """Where the last of some rising bounds (``most`` at most) that isn't above a value is, 0 if there is none, by binary search."""
    steps, step = [], 1
    while step < most:
        steps.append(step)
        step *= 2
    n = F.size(bounds)
    return F.aggregate(F.lit([*reversed(steps), 0]), F.lit(0), lambda i, k: F.when((i + k < n) & (F.get(bounds, i + k) <= value), i + k).otherwise(i))


def grouping(docs: DataFrame, rows_per_group: int, tie: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A function that adds long columns ``turn`` and ``group`` to rows of docs, whose groups never fall as (doc_id, turn) grows.

    A group has about ``rows_per_group`` rows. Ids are cut at their quantiles,
    and each of these ranges at its own, so ids that lie close together or far
    off don't throw others together. Rows of null ids are cut evenly by
    ``turn``, a hash of ``tie``, into groups below 0; other rows' turn is 0.
    """
    n, known = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    cuts = max(1, min(QUANTILES, known // rows_per_group))
    parts = max(1, min(PARTS, known // (rows_per_group * cuts)))
    unknown = max(1, min(QUANTILES * PARTS, -(-(n - known) // rows_per_group)))
    # Without null ids the text isn't read for their turn.
    turn = F.when(F.col("doc_id").isNull(), F.xxhash64(*tie)).otherwise(F.lit(0).cast("long")) if known < n else F.lit(0).cast("long")
    share = F.col("turn").cast("double") / 2.0**64 + 0.5
    nulls = (F.least(F.floor(share * unknown), F.lit(unknown - 1)) - unknown).cast("long")
    if not known:
        return lambda rows: rows.withColumn("turn", turn).withColumn("group", nulls)
    ids = F.col("doc_id").cast("long")
    lows = sorted(set(docs.agg(F.percentile_approx(ids, [i / cuts for i in range(cuts + 1)], 10 * QUANTILES)).first()[0]))
    of = last_not_above(F.lit(lows), len(lows), ids)
    if parts == 1:
        return lambda rows: rows.withColumn("turn", turn).withColumn("group", F.when(F.col("doc_id").isNull(), nulls).otherwise(of.cast("long")))
    inner = docs.where("doc_id is not null").groupBy(of.alias("range")).agg(F.percentile_approx(ids, [i / parts for i in range(parts + 1)], 10 * PARTS).alias("bounds"))
    inner = cut(inner)

    def add(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("turn", turn).withColumn("of", F.when(F.col("doc_id").isNotNull(), of)).join(F.broadcast(inner), F.col("of") == F.col("range"), "left")
        place = F.col("of").cast("long") * (parts + 1) + last_not_above(F.col("bounds"), parts + 1, ids)
        return rows.withColumn("group", F.coalesce(place, nulls)).drop("of", "range", "bounds")

    return add


def with_next(docs: DataFrame, rows_per_group: int = 500) -> DataFrame:
    """docs(doc_id, ...) with struct column ``next``: the row that follows by descending doc_id, the first after the last.

    Neighbours are found within a group of ids; the first row of a group also
    goes, as a copy, to the group that it follows on, so no window spans the
    table. Only tables of groups are broadcast; ``QUANTILES`` and ``PARTS``
    bound them. Null ids come last, by a hash of the next column (the text) and
    then by it; rows of one id, and null ids of one text, share a group.
    """
    kept = [c for c in docs.columns]
    tie = [c for c in kept if c != "doc_id"][:1]
    add = grouping(docs, rows_per_group, tie)
    rows = add(docs)
    ids = add(docs.select("doc_id", *tie))
    ends = ids.groupBy("group").agg(F.max(F.struct("doc_id", "turn")).alias("first_row"))
    everywhere = Window.partitionBy()
    wanted = F.coalesce(F.lead("group").over(Window.orderBy("group")), F.min("group").over(everywhere))
    ends = ends.select(F.col("group").alias("g"), F.col("first_row.doc_id").alias("first_id"), F.col("first_row.turn").alias("first_turn"), wanted.alias("wanted_by"))
    # A row that repeats the first one's place is copied as well; the window below takes the first copy only.
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("turn") == F.col("first_turn"))
    rows = rows.join(F.broadcast(ends), (F.col("group") == F.col("g")) & first, "left")
    own = F.struct(F.col("group").alias("at"), F.lit(False).alias("copy"))
    lent = F.struct(F.col("wanted_by").alias("at"), F.lit(True).alias("copy"))
    rows = rows.select(*kept, "turn", F.explode(F.when(F.isnull("g"), F.array(own)).otherwise(F.array(own, lent))).alias("to"))
    order = Window.partitionBy("to.at").orderBy("to.copy", F.col("doc_id").desc_nulls_last(), F.col("turn").desc(), *tie)
    rows = rows.withColumn("next", F.lead(F.struct(*kept)).over(order))
    return rows.where(~F.col("to.copy")).drop("to", "turn")


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """The digest rows: every text, its edited text, and how alike their fingerprints are."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(base.withColumn("bins", signature(F.col("text"))))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "bins", F.col("next.bins").alias("next_bins"), edited.alias("edited"))
    rows = rows.withColumn("edited_bins", signature(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"))
