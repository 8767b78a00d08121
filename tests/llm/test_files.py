"""Matroska and WARC round trips, and the pipeline."""

import gzip
import hashlib
import os
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.llm import matroska, warc


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1024, 1025, 8192, 9000, 400_000])
def test_matroska_round_trip(n):
    raw = os.urandom(n)
    payload = raw + b"\0" * (-n % 64 or (0 if n else 64))
    data = matroska.write(payload)
    parsed = matroska.parse(data)
    assert b"".join(data[p.offset : p.offset + p.length] for p in parsed.packets) == payload
    assert [c[2] for c in parsed.cues] == parsed.clusters and parsed.tracks[0]["codec"] == "A_PCM/INT/LIT"


def test_lacings_groups_and_unknown_sizes():
    for lacing, sizes in ((0, [300]), (1, [5, 300, 255, 0, 700]), (2, [40] * 5), (3, [5, 300, 1000, 2, 700]), (3, [9])):
        frames = [os.urandom(k) for k in sizes]
        body = matroska.laced(frames, lacing)
        found, at = matroska.lace_sizes(body, 0, len(body), lacing)
        assert found == sizes and body[at:] == b"".join(frames)
    block = lambda t: b"\x81" + t.to_bytes(2, "big", signed=True) + b"\x00" + b"frame"
    cluster = matroska.number(matroska.CLUSTER_TIMESTAMP, 100) + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block(-3)) + matroska.number(matroska.REFERENCE_BLOCK, 1)) + matroska.element(matroska.SIMPLE_BLOCK, block(5))
    open_ = matroska.id_bytes(matroska.CLUSTER) + b"\x01" + b"\xff" * 7 + cluster
    data = matroska.element(matroska.EBML, matroska.element(matroska.DOC_TYPE, b"webm")) + matroska.id_bytes(matroska.SEGMENT) + b"\xff" + open_ + open_
    parsed = matroska.parse(data)
    assert [(p.cluster, p.timestamp, p.key, data[p.offset : p.offset + p.length]) for p in parsed.packets] == [(0, 97, False, b"frame"), (0, 105, False, b"frame"), (1, 97, False, b"frame"), (1, 105, False, b"frame")]
    for cut in range(1, len(data)):
        try:
            matroska.parse(data[:cut])
        except ValueError:
            pass


def test_media_columns(spark):
    rows = [(1, "some text"), (2, None), (3, ""), (4, "é" * 5000), (4, "é" * 5000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, media string, id int")
    got = sorted(map(tuple, matroska.digests(df).collect()))
    assert len(got) == 5 and got[3] == got[4]
    for (i, t), r in zip(sorted(rows, key=lambda x: x[0]), got, strict=True):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert r[:5] == (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    files = spark.createDataFrame([(1, matroska.write(b"a" * 64)), (2, b"junk"), (3, None)], "id long, media binary")
    table = {r["id"]: r for r in matroska.packets(files, "id", "media").collect()}
    assert table[1]["length"] == 64 and table[2]["error"] and table[3]["error"]
    assert matroska.digests(df.limit(0)).count() == 0


def test_split_reader_reads_every_record_once(tmp_path):
    rng = random.Random(6)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randrange(0, 3000))) for _ in range(60)] + [b"\x1f\x8b\x08" * 200, gzip.compress(b"WARC/1.1 no record")]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(warc.member(warc.record(i, f"http://h/{i}\r\n", p, hashlib.sha256(p).hexdigest(), None)) for i, p in enumerate(payloads)))
    size = path.stat().st_size
    for step in (97, 1000, 5000, size):
        found = []
        with pa.OSFile(str(path)) as f:
            for a in range(0, size, step):
                found += [(r.page("WARC-Record-ID"), r.http()[1]) for r in warc.records(f, a, min(size, a + step))]
        assert found == list(enumerate(payloads))


def test_warc_round_trip(spark):
    same, other = "<p>" + "x" * 200, "<p>" + "y" * 200
    rows = [(5, "u5", same), (3, "u3", same), (9, None, same), (1, "u\n1", "short"), (2, "u2", "short"), (7, "u", None), (8, "u8", other), (8, "u8", other), (None, "n", same), (4, "é", "ü" * 90)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int")
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        again = html == same and i != 3
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0
    small = warc.write(warc.deduplicated(df), warc.shared_dir(spark) + "/t")
    assert warc.read(small, 64).count() == len(rows)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(100_000, None, None, None, None), (100_001, "", "en", "src0", 0)], docs.schema)
    docs, first = docs.unionByName(extra), docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == first
            assert docs.count() > 150
    assert docs.where(F.length("decoded") == 0).count() == 0
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
