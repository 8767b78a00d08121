"""BM25 over postings in blocks, with exact early termination.

Documents are dealt into shards, and each shard's into windows; a block holds a
term's postings in one window, and the largest weight among them. Nothing of a
window can score more than the sum of the largest weights of a question's terms
there. So a task first scores the windows of most promise. Then, with the k-th
score so far, which runs on from shard to shard, it reads the rarer terms only
(a document that has none of them can't reach the k-th score by the others), in
the windows that can reach it, and reads the others' blocks only where a document
still can. What is left out is not summed, and nothing of it can be among the
first k, ties included.

Weights are whole numbers of 2^-44, and doubles hold sums of them exactly up to
512; larger scores are rounded to that many bits, the same way every time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import retrieval as R
from rankloom.operators.meeting import meet, ranges

#: Documents of a shard and of a window, on average and at most; bits of a weight's fraction.
SHARD, WINDOW, BITS = 4096, 32, 44
ONE = float(1 << BITS)
#: The row of a shard that holds its documents; no token is empty.
DOCUMENTS = ""


def blocks_of(weights: DataFrame, lengths: DataFrame, shard: int = SHARD, window: int = WINDOW) -> DataFrame:
    """shard, term, windows, tops, counts, places, weights, ids from weights(term, id, weight) and lengths(id, dl) of all documents.

    A row has a term's blocks in a shard: their windows, largest weights and
    numbers of postings, and the postings one after another. Documents fall into
    shards by a hash, so a term of very many documents is spread over all of
    them; windows hold documents of similar length, whose weights differ least.
    """
    n, tasks = lengths.count(), int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n // shard), min(tasks, -(-n // (8 * window))))
    placed = lengths.where("id is not null").select("id", "dl", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    placed = placed.select("id", "shard", (F.row_number().over(Window.partitionBy("shard").orderBy("dl", "id")) - 1).alias("place"))
    posting = F.struct("place", F.rint(F.col("weight") * ONE).cast("long").alias("weight"))
    blocks = weights.join(placed, "id").select("shard", "term", F.floor(F.col("place") / window).cast("int").alias("window"), posting.alias("p"))
    blocks = blocks.groupBy("shard", "term", "window").agg(F.max("p.weight").alias("top"), F.array_sort(F.collect_list("p")).alias("p"))
    rows = blocks.groupBy("shard", "term").agg(F.array_sort(F.collect_list(F.struct("window", "top", "p"))).alias("b"))
    rows = rows.select(
        "shard", "term", F.col("b.window").alias("windows"), F.col("b.top").alias("tops"), F.transform("b", lambda b: F.size(b["p"])).alias("counts"),
        F.flatten(F.transform("b", lambda b: b["p"]["place"])).alias("places"), F.flatten(F.transform("b", lambda b: b["p"]["weight"])).alias("weights"))
    documents = placed.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("d")).select("shard", F.lit(DOCUMENTS).alias("term"), F.col("d.id").alias("ids"))
    return rows.unionByName(documents, allowMissingColumns=True).repartitionByRange("term", "shard").sortWithinPartitions("term", "shard")


def blocks_of_tokens(tokenized: DataFrame, shard: int = 4 * SHARD, window: int = WINDOW) -> DataFrame:
    """shard, term, windows, counts, places, tfs, dls, ids from tokenized(id, tokens, dl): blocks as above, whose weights ``with_weights`` adds.

    Documents move to their shards once, and a shard's postings are counted and
    put in order there, so no posting moves by itself and none needs its term's
    frequency. Ids that are null are left out.
    """
    n, tasks = tokenized.count(), int(tokenized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n // shard), min(tasks, -(-n // (8 * window))))
    kind = dict(tokenized.dtypes)["id"]
    placed = tokenized.where("id is not null").select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "dl", "tokens")
    lists = ("windows", "counts", "places", "tfs", "dls")

    def build(table: pa.Table) -> pa.Table:
        number = table.column("shard")[0].as_py()
        table = table.sort_by([("dl", "ascending"), ("id", "ascending")])
        tokens, dl = table.column("tokens").combine_chunks(), table.column("dl").to_numpy()
        coded = pc.dictionary_encode(pc.list_flatten(tokens))
        key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(dl) + pc.list_parent_indices(tokens).to_numpy(), return_counts=True)
        term, place = key // len(dl), key % len(dl)
        starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (place[1:] // window != place[:-1] // window)]) if len(key) else np.zeros(0, np.int64)
        of_terms = np.arange(len(coded.dictionary) + 1)
        of_blocks = np.searchsorted(term[starts], of_terms)
        of_postings = np.searchsorted(term, of_terms)
        values = {"windows": (place[starts] // window, of_blocks), "counts": (np.diff(np.r_[starts, len(key)]), of_blocks)}
        values |= {name: (x, of_postings) for name, x in (("places", place), ("tfs", tf), ("dls", dl[place]))}
        made = {name: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for name, (x, ends) in values.items()}
        none = pa.nulls(len(coded.dictionary), table.schema.field("id").type)
        rows = pa.table({"shard": pa.array([number] * len(none), pa.int32()), "term": coded.dictionary, **made, "ids": pa.nulls(len(none), pa.list_(none.type))})
        whole = {name: pa.nulls(1, pa.list_(pa.int32())) for name in lists}
        ids = pa.ListArray.from_arrays(pa.array([0, len(dl)], pa.int32()), table.column("id").combine_chunks())
        return pa.concat_tables([pa.table({"shard": pa.array([number], pa.int32()), "term": [DOCUMENTS], **whole, "ids": ids}), rows])

    return placed.groupBy("shard").applyInArrow(build, f"shard int, term string, {', '.join(f'{c} array<int>' for c in lists)}, ids array<{kind}>")


def with_weights(blocks: DataFrame, idfs: DataFrame, stats: DataFrame) -> DataFrame:
    """shard, term, windows, counts, places, weights, ids of the terms of idfs(term, idf), for ``search``; stats has one row."""
    part = lambda tf, dl: F.col("idf") * (tf * (R.K1 + 1)) / (tf + R.K1 * (1 - R.B + R.B * dl / F.col("avgdl")))
    weights = F.zip_with("tfs", "dls", lambda tf, dl: F.rint(part(tf, dl) * ONE).cast("long"))
    wanted = blocks.where(F.col("term") != DOCUMENTS).join(F.broadcast(idfs), "term").join(F.broadcast(stats.select("avgdl")))
    wanted = wanted.select("shard", "term", "windows", "counts", "places", weights.alias("weights"), "ids")
    documents = blocks.where(F.col("term") == DOCUMENTS)
    return wanted.unionByName(documents.select("shard", "term", "windows", "counts", "places", F.lit(None).cast("array<bigint>").alias("weights"), "ids"))


class Best:
    """The first k hits of a question so far."""

    def __init__(self, k: int) -> None:
        self.k, self.hits = k, []

    @property
    def least(self) -> float:
        """What a score must reach, in units of 10^-9, to be among them."""
        return -self.hits[-1][0] if len(self.hits) == self.k else -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray, first: np.ndarray) -> None:
        nine = np.rint(scores * 1e9)
        if len(nine) > self.k:
            kept = nine >= max(self.least, np.partition(nine, len(nine) - self.k)[len(nine) - self.k])
            ids, scores, first, nine = ids[kept], scores[kept], first[kept], nine[kept]
        found = list(zip((-nine).tolist(), first.tolist(), ids.tolist(), scores.tolist(), strict=True))
        self.hits = sorted([*self.hits, *found])[: self.k]


class _Shard:
    def __init__(self, table: pa.Table) -> None:
        term = table.column("term").to_pylist()
        self.ids = table.column("ids").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.row = {t: i for i, t in enumerate(term)}
        lists = {c: table.column(c).combine_chunks() for c in ("windows", "counts", "places", "weights")}
        sizes = lists["windows"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.last = np.cumsum(sizes)  # a term's blocks end there
        self.window, self.count, self.place, weight = (x.flatten().to_numpy() for x in lists.values())
        self.weight, self.start = weight.astype(np.float64), np.cumsum(self.count) - self.count
        self.top = np.maximum.reduceat(self.weight, self.start) if len(self.start) else np.zeros(0)  # a block's largest weight
        self.n_windows = int(self.window.max(initial=0)) + 1
        window_of = np.zeros(len(self.ids), np.int64)
        window_of[self.place] = np.repeat(self.window, self.count)
        self.window_of = window_of

    def search(self, terms: list[tuple[str, int, int]], best: Best, ahead: int) -> tuple[int, int, int, int]:
        """Adds a question's hits; terms are (term, times, first place). Returns blocks and postings there are, and those read."""
        own = [(self.row[t], times, first) for t, times, first in terms if t in self.row]
        if not own:
            return 0, 0, 0, 0
        rows = np.array([x[0] for x in own])
        low = np.where(rows, self.last[rows - 1], 0)
        sizes = self.last[rows] - low
        block, term = ranges(low, sizes), np.repeat(np.arange(len(own)), sizes)
        times, first = (np.array([x[i] for x in own]) for i in (1, 2))
        window, top = self.window[block], self.top[block] * times[term]
        blocks_read = postings_read = 0

        def read(taken: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Places, terms and weights of the postings of some blocks."""
            nonlocal blocks_read, postings_read
            counts = self.count[block[taken]]
            at = ranges(self.start[block[taken]], counts)
            of = np.repeat(term[taken], counts)
            blocks_read, postings_read = blocks_read + len(counts), postings_read + len(at)
            return self.place[at], of, self.weight[at] * times[of]

        def add(parts: list[tuple], kept: np.ndarray | None = None) -> None:
            place, of, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
            score = np.bincount(place, weight, len(self.ids))
            earliest = np.full(len(self.ids), np.iinfo(np.int64).max)
            np.minimum.at(earliest, place, first[of])
            found = np.flatnonzero(score if kept is None else kept)
            best.add(self.ids[found], score[found] / ONE, earliest[found])

        def nine(sums: np.ndarray) -> np.ndarray:
            return np.rint(sums / ONE * 1e9)

        bound = nine(np.bincount(window, top, self.n_windows))
        live = np.bincount(window, minlength=self.n_windows) > 0
        if best.least == -np.inf:
            promising = np.zeros(self.n_windows, bool)
            promising[np.argsort(-bound, kind="stable")[:ahead]] = True
            add([read(promising[window])])
            live &= ~promising
        live &= bound >= best.least
        if live.any():
            most = np.zeros(len(own))
            np.maximum.at(most, term, top)
            order = np.argsort(most, kind="stable")
            rare = np.zeros(len(own), bool)
            rare[order[nine(np.cumsum(most[order])) >= best.least]] = True
            here, others = live[window], live[window] & ~rare[term]
            if 4 * others.sum() < here.sum():  # hardly anything to leave out
                add([read(here)])
            elif rare.any():
                parts = [read(here & rare[term])]
                sums = np.bincount(parts[0][0], parts[0][2], len(self.ids))
                more = np.bincount(window[others], top[others], self.n_windows)
                kept = (sums > 0) & (nine(sums + more[self.window_of]) >= best.least)
                if kept.any():
                    wanted = np.zeros(self.n_windows, bool)
                    wanted[self.window_of[kept]] = True
                    parts.append(read(others & wanted[window]))
                    add(parts, kept)
        return len(block), int(self.count[block].sum()), blocks_read, postings_read


def search(blocks: DataFrame, asked: DataFrame, k: int = 10, tasks: int | None = None, count: bool = False) -> DataFrame:
    """qid, id, rank, score for asked(qid, pos, term): as ``retrieval.score_weights`` finds them.

    With ``count``: qid, and the blocks and postings of its terms that there are and that were read.
    """
    spark = blocks.sparkSession
    tasks = tasks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    per = asked.groupBy("qid", "term").agg(F.count(F.lit(1)).cast("int").alias("times"), F.min("pos").alias("first"))
    questions = per.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("first", "term", "times"))).alias("terms"))
    kinds = dict(questions.dtypes)["qid"], dict(blocks.dtypes)["ids"].removeprefix("array<")[:-1]
    ahead = max(1, k // 4)  # windows that are scored before there is a k-th score

    def run(asked_: pa.Table, shards: Iterator[pa.Table]) -> Iterator[pa.Table]:
        qids = asked_.column("qid").to_pylist()
        terms = [[(t["term"], t["times"], t["first"]) for t in row] for row in asked_.column("terms").to_pylist()]
        best, counted, kind = [Best(k) for _ in qids], np.zeros((len(qids), 4), np.int64), None
        for table in shards:
            kind = table.schema.field("ids").type.value_type
            shard = _Shard(table)
            for i, t in enumerate(terms):
                counted[i] += shard.search(t, best[i], ahead)
        if count:
            yield pa.table({"qid": asked_.column("qid"), **{c: counted[:, i] for i, c in enumerate(COUNTS)}})
            return
        rows = [(q, h[2], h[1], h[3]) for q, b in zip(qids, best, strict=True) for h in b.hits]
        if rows:
            qid, id_, first, score = zip(*rows, strict=True)
            yield pa.table({"qid": pa.array(qid, asked_.column("qid").type), "id": pa.array(id_, kind), "first": pa.array(first, pa.int64()), "score": pa.array(score, pa.float64())})

    names = asked.select("term").union(spark.range(1).select(F.lit(DOCUMENTS))).distinct()
    wanted = blocks.join(F.broadcast(names), "term", "left_semi").select("shard", "term", "windows", "counts", "places", "weights", "ids")
    if count:
        found = meet(questions, wanted, "shard", ["term"], run, f"qid {kinds[0]}, " + ", ".join(f"{c} long" for c in COUNTS), tasks)
        return found.groupBy("qid").agg(*(F.sum(c).alias(c) for c in COUNTS))
    found = meet(questions, wanted, "shard", ["term"], run, f"qid {kinds[0]}, id {kinds[1]}, first long, score double", tasks)
    nine = F.rint(F.col("score") * 1e9)
    return R.top(found, ["qid"], [nine.desc(), F.col("first"), F.col("id")], k).select("qid", "id", "rank", "score")


COUNTS = ("blocks", "postings", "blocks_read", "postings_read")
