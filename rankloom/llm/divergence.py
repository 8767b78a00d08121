"""Source divergence audit: how far the term shares of each source are from those of the other sources of its language.

Every document's distinct terms leave it with their counts, so partial sums by
(language, source, term) precede the first shuffle. Each kept term then becomes
one wide row: a source-indexed array of the counts in the sources that have it.
Higher-order functions turn such an array into shares and emit what it adds to
each pair of sources; the pairs are summed on the map side, so the shuffle
carries a row for each pair and task.

Sources without a term have a share too, the same for all their missing terms.
So a pair's sum over all kept terms is taken apart exactly: what it would be if
no source had any term, what changes by the terms of one source (these depend on
the count alone, so a histogram of counts is enough), and what changes by the
terms that both have, the only part that is emitted term by term. The work is
the square of the sources that *have* a term, not of all sources.

Shares are whole numbers of billionths, computed in decimals; all sums are longs
and exact for up to 2 x 10^9 kept terms of a language.

Defined cases: null text, lang and source are ''. Rows are documents, whether or
not ids are null or repeated. A language without kept terms has pairs of value 0
and no terms; a language of one source has no pairs. Ties go by the bytes of the
item. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import cut, let

TERM, BETWEEN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, BILLION, MOST_TERMS = 3, 10**9, 200
#: Groups (language, source) whose table is broadcast; with more it is joined by a shuffle.
BROADCAST_GROUPS = 100_000


def term_counts(text: Column) -> Column:
    """array<struct<term, n>> of a text's distinct terms: sorted, then told apart where neighbours differ."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    words = F.sort_array(F.split(lowered, BETWEEN))  # several times faster than extracting the terms

    def runs(w: Column) -> Column:
        firsts = F.filter(F.transform(w, lambda x, i: F.when((x != "") & ((i == 0) | (x != F.get(w, i - 1))), i)), lambda i: i.isNotNull())
        return let(firsts, lambda f: F.transform(f, lambda i, k: F.struct(F.get(w, i).alias("term"), (F.coalesce(F.get(f, k + 1), F.size(w)) - i).cast("long").alias("n"))))

    return let(words, runs)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total), null for a total of 0."""
    return 1 + _div((count + 1).cast("decimal(20,0)") * F.lit(BILLION).cast("decimal(10,0)"), F.nullif(total, F.lit(0)).cast("decimal(20,0)"))


def gain(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: sources by divergence, and the terms that set a source apart."""
    blank = {c: F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")}
    rows = docs.select(*blank.values())
    index = rows.select("lang", "source").distinct().withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    index = cut(index)
    sized = F.broadcast if index.count() <= BROADCAST_GROUPS else lambda df: df

    counts = rows.select("lang", "source", F.explode(term_counts(F.col("text"))).alias("t")).groupBy("lang", "source", "t.term").agg(F.sum("t.n").alias("n"), F.count(F.lit(1)).alias("docs"))
    indexed = counts.join(sized(index), ["lang", "source"]).select("lang", "term", "docs", F.struct("i", "n").alias("cell"))
    wide = indexed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list("cell")).alias("cells"))
    wide = cut(wide.where(F.col("docs") >= least_docs).select("lang", "term", "cells"))

    cells = wide.select("lang", F.explode("cells").alias("cell")).select("lang", "cell.i", "cell.n")
    histogram = cells.groupBy("lang", "i", "n").agg(F.count(F.lit(1)).alias("m"))
    totals = cells.groupBy("lang", "i").agg(F.sum("n").alias("total"))
    kept = wide.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = index.join(totals, ["lang", "i"], "left").select("lang", F.struct("i", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total")).alias("g"))
    shape = groups.groupBy("lang").agg(F.array_sort(F.collect_list("g")).alias("groups")).join(kept, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    total = F.aggregate("groups", F.lit(0).cast("long"), lambda a, g: a + g["total"])
    shape = cut(shape.select("lang", "v", "groups", total.alias("total"), F.transform("groups", lambda g: share(F.lit(0), g["total"] + F.col("v"))).alias("none")))

    def in_lang(df: DataFrame) -> DataFrame:
        return df.join(sized(shape), "lang")

    def group(i: Column) -> Column:
        return F.get("groups", i)

    def none(i: Column) -> Column:
        return F.get("none", i)

    shares = F.transform("cells", lambda c: F.struct(c["i"].alias("i"), share(c["n"], group(c["i"])["total"] + F.col("v")).alias("p"), none(c["i"]).alias("z")))
    priced = in_lang(wide).select("lang", "term", shares.alias("ps"), share(F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["n"]), F.col("total") + F.col("v")).alias("q"))

    # what the terms of both add beyond what the terms of each add
    first = priced.select("lang", "ps", F.explode("ps").alias("x"))
    shared = first.select("lang", "x", F.explode(F.filter("ps", lambda y: y["i"] != F.col("x.i"))).alias("y")).select("lang", *(F.col(f"{e}.{c}").alias(f"{e}{c}") for e in "xy" for c in "ipz"))
    beyond = gain(F.col("xp"), F.col("yp")) - gain(F.col("xp"), F.col("yz")) - gain(F.col("xz"), F.col("yp")) + gain(F.col("xz"), F.col("yz"))
    shared = shared.select("lang", F.col("xi").alias("a"), F.col("yi").alias("b"), beyond.alias("value"))
    # what the terms of one add, against each source as if that had none of them
    alone = in_lang(histogram).withColumn("p", share(F.col("n"), group(F.col("i"))["total"] + F.col("v")))
    alone = alone.select("lang", "i", "m", "p", none(F.col("i")).alias("zi"), F.posexplode("none").alias("j", "zj")).where("i <> j")
    ways = F.array(
        F.struct(F.col("i").alias("a"), F.col("j").alias("b"), (F.col("m") * (gain(F.col("p"), F.col("zj")) - gain(F.col("zi"), F.col("zj")))).alias("value")),
        F.struct(F.col("j").alias("a"), F.col("i").alias("b"), (F.col("m") * (gain(F.col("zj"), F.col("p")) - gain(F.col("zj"), F.col("zi")))).alias("value")))
    alone = alone.select("lang", F.explode(ways).alias("e")).select("lang", "e.*")
    # what there would be without any term
    named = shape.select("lang", "v", "none", "groups", F.explode("groups").alias("x")).select("lang", "v", "none", "x", F.explode("groups").alias("y")).where("x.i <> y.i")
    bare = named.select("lang", F.col("x.i").alias("a"), F.col("y.i").alias("b"), F.coalesce(F.col("v") * gain(none(F.col("x.i")), none(F.col("y.i"))), F.lit(0)).alias("value"))
    pairs = shared.unionByName(alone).unionByName(bare).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = in_lang(pairs).select("lang", group(F.col("a"))["source"].alias("source"), F.lit("pair").alias("part"), group(F.col("b"))["source"].alias("item"), "value")

    above = priced.select("lang", "term", "q", F.explode(F.filter("ps", lambda x: x["p"] > F.col("q"))).alias("x"))
    own = above.select("lang", F.col("x.i").alias("i"), F.col("term").alias("item"), gain(F.col("x.p"), F.col("q")).alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "i").orderBy(*order))).where(F.col("rank") <= most_terms)
    own = in_lang(own).select("lang", group(F.col("i"))["source"].alias("source"), F.lit("term").alias("part"), "item", "value", "rank")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    return ranked.unionByName(own)


ORACLE = f"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}') AS words FROM documents),
t AS (SELECT lang, source, r, unnest(words) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
s AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n + v) AS p
  FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
a AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 1)) // (n + v) AS q
  FROM (SELECT lang, term, sum(c)::HUGEINT AS c FROM c GROUP BY lang, term) JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM n GROUP BY lang) USING (lang) JOIN v USING (lang)),
w AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
p AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(w.value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN w ON w.lang = x.lang AND w.source = x.source AND w.item = y.source),
o AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM s JOIN a USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM p UNION ALL SELECT * FROM o))
SELECT lang, source, part, item, value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= {MOST_TERMS}
"""
