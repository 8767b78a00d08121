"""Mixing, sharding and fingerprints against plain Python."""

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from rankloom.llm import fingerprints, mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, next string, key string, at int, `group` int, n int"


@pytest.fixture(scope="module")
def rows():
    made = [(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(i % 40)), "en", f"s{i % 4}" if i % 9 else None, 0, "x", "x", "x", 1, 1, 1) for i in range(300)]
    made += [(300, None, None, "s1", None, None, None, None, None, None, None), (301, "", "en", "tiny", 0, "", "", "", 0, 0, 0), (302, "one  two", "en", "tiny", 0, "", "", "", 0, 0, 0)]
    return [*made, made[5], (None, "null id", "en", "s0", 1, "", "", "", 0, 0, 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_mix_meets_targets(docs, rows):
    got = mixing.mix(docs, rows_per_bucket=7).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            free.discard(s)
            rest -= target[s]
    assert sorted({round(r["target"], 6) for r in got}) == sorted({round(t, 6) for t in target.values()})
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        per = taken.setdefault((round(r["target"], 6), r["source_size"]), [0, 0])
        per[0] += r["taken"]
        per[1] = max(per[1], r["size"])
    for (t, _), (n, most) in taken.items():
        assert abs(n - t) <= most
    again = mixing.mix(docs.repartition(5), rows_per_bucket=100).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_of_nothing(docs):
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(docs.where("doc_id = 301")).collect()] == [0]


def test_quality_draws_earlier(spark):
    docs = spark.createDataFrame([(i, "s", 10, i % 2) for i in range(2000)], "doc_id long, source string, size long, good int")
    more = spark.createDataFrame([(9999, "t", 10, 1)] * 300, docs.schema)  # leaves s less than one epoch
    got = mixing.mix(docs.union(more), size=F.col("size"), quality=F.when(F.col("good") == 1, 4.0).otherwise(1.0), weights=(1, 1)).where("doc_id < 9999 and taken > 0")
    odd = got.where("doc_id % 2 = 1").count()
    assert odd > 0.5 * got.count()


def test_shards_are_even_and_mixed(docs, rows):
    got = sharding.deal(docs, 7, rows_per_bucket=11).collect()
    assert len(got) == len(rows)
    per = {}
    for r in got:
        per.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in per.values()) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    text = {r[0]: r[1] for r in rows}
    assert all(r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) and r["size"] == 16 + len((text[r["doc_id"]] or "").encode()) for r in got)
    source = {r[0]: r[3] for r in rows}
    for shard in per:
        mine = [source[r["doc_id"]] for r in got if r["shard"] == shard]
        for s in set(source.values()):
            whole = sum(r[3] == s for r in rows) / 7
            assert abs(mine.count(s) - whole) <= 2
    assert sorted(map(str, sharding.deal(docs.coalesce(1), 7, rows_per_bucket=1000).collect())) == sorted(map(str, got))
    assert sharding.deal(docs.limit(0)).count() == 0


def test_fingerprint_digests(docs, rows):
    got = {(r["doc_id"], r["fingerprint"]): r for r in fingerprints.fingerprint_with_edits(docs).collect()}
    ordered = sorted(({(r[0], r[1]) for r in rows if r[0] is not None and r[0] != 5}), key=lambda r: -r[0])
    by_id = {k[0]: r for k, r in got.items()}
    for (i, text), (_, after) in zip(ordered, ordered[1:], strict=False):
        if i == 6:
            continue
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert by_id[i]["n_chars"] == len(text) and by_id[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= by_id[i]["near_edited"] <= 1
    same = {}
    for r in rows:
        same.setdefault(r[1] or "", set()).add(by_id[r[0]]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())


def test_neighbours_over_many_groups(spark):
    ids = [3, 4, 10, 500, 501, 502, 9000, 100000, 100001]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    for each in (1, 2, 3, 100):
        got = {r["doc_id"]: r["next"]["doc_id"] for r in fingerprints.with_next(df, each).collect()}
        assert got == {b: a for a, b in zip(ids, ids[1:], strict=False)} | {3: 100001}
    one = fingerprints.with_next(df.limit(1)).first()
    assert one["next"]["doc_id"] == one["doc_id"]
    assert fingerprints.with_next(df.limit(0)).count() == 0


def test_clumped_and_null_ids_make_even_groups(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "QUANTILES", 8)
    monkeypatch.setattr(fingerprints, "PARTS", 64)
    ids = [*range(2000), *(10**15 + 10**9 * i for i in range(2000))]  # two scales
    rows = [(i, f"t{i}") for i in ids] + [(None, f"null {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    largest = fingerprints.grouping(docs, 20, ["text"])(docs).groupBy("group").count().agg(F.max("count")).first()[0]
    assert largest <= 80
    got = fingerprints.with_next(docs, 20).collect()
    assert len(got) == len(rows)
    after = {r["doc_id"]: r["next"] for r in got if r["doc_id"] is not None}
    assert all(after[b]["doc_id"] == a for a, b in zip(ids, ids[1:], strict=False)) and after[0]["doc_id"] is None
    hashes = {r["text"]: r["h"] for r in docs.where("doc_id is null").select("text", F.xxhash64("text").alias("h")).collect()}
    nulls = sorted(hashes, key=hashes.get, reverse=True)
    follows = {r["text"]: r["next"]["text"] for r in got if r["doc_id"] is None}
    assert follows == dict(zip(nulls, [*nulls[1:], f"t{ids[-1]}"], strict=True)) and after[0]["text"] == nulls[0]


@pytest.mark.parametrize("quality", [0.01, 0.5, 1.0, 100.0, None])
def test_buckets_are_even_at_any_weight(spark, quality):
    n = 100_000
    weight = F.lit(quality) if quality else F.when(F.col("id") % 3 == 0, 0.03).when(F.col("id") % 3 == 1, 7.3).otherwise(1.0)
    drawn = spark.range(n).select((-F.log((F.hash("id").cast("double") + 2.0**31 + 0.5) / 2.0**32) / weight).alias("key"), F.round(F.log2(weight) * mixing.GRADES).cast("int").alias("grade"))
    grades = drawn.groupBy("grade").agg(F.count(F.lit(1)).alias("rows")).agg(F.sort_array(F.collect_list(F.struct("grade", "rows"))).alias("grades"))
    placed = drawn.crossJoin(grades).groupBy(F.floor(mixing.expected_share(F.col("key"), F.col("grades")) * 100)).count()
    assert placed.agg(F.max("count")).first()[0] <= 1400


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_likeness_estimates_jaccard(spark, share):
    n = 400
    a = [f"u{i}" for i in range(n)]
    b = a[: int(n * share)] + [f"v{i}" for i in range(int(n * share), n)]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    true = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    df = spark.createDataFrame([(" ".join(a), " ".join(b), "few words", "")], "a string, b string, c string, d string")
    sig = {c: fingerprints.signature(F.col(c)) for c in "abcd"}
    row = df.select(fingerprints.likeness(sig["a"], sig["b"]).alias("ab"), fingerprints.likeness(sig["c"], sig["d"]).alias("cd"), fingerprints.likeness(sig["c"], sig["c"]).alias("cc")).first()
    assert abs(row["ab"] - true) < 4 * math.sqrt(true * (1 - true) / fingerprints.BINS) + 0.01 and row["cd"] < 0.05 and row["cc"] == 1.0
