"""Media columns in Matroska: write samples, and parse files into packet tables.

``parse`` reads EBML: variable-length ids and sizes (unknown sizes too),
clusters, simple blocks and block groups, all four kinds of lacing (none,
Xiph, fixed, EBML) and cues. It yields a packet table with track, timestamp,
key flag, and the byte range of every frame in the file, so that payloads can
be read by range. ``write`` stores bytes as 8-bit PCM frames in laced blocks.

Both are applied by ``mapInArrow``, a file at a time, without a shuffle.

Defined cases: null text is empty; its payload is one unit of zero bytes.
Truncated or foreign files raise ``ValueError`` in ``parse``; ``packets`` gives
such a row one packet row with ``error`` set, as it does for null files. Very
long texts make more clusters; repeated rows give equal files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element ids and types (fixed values of the format).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3

UNIT = 64
FRAME, FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 1024, 8, 16
RATE = 8000


# ---- writing


def size_bytes(n: int, width: int = 0) -> bytes:
    """An EBML size: a leading one bit tells the width."""
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
        if n < (1 << 7 * width) - 1:
            break
    return (n | 1 << 7 * width).to_bytes(width, "big")


def id_bytes(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def element(i: int, body: bytes) -> bytes:
    return id_bytes(i) + size_bytes(len(body)) + body


def number(i: int, n: int) -> bytes:
    return element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """A block's bytes after its flags."""
    if lacing == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == XIPH_LACING:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING and len(frames) > 1:
        head += size_bytes(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = 1
            while not -((1 << 7 * width - 1) - 1) <= b - a <= (1 << 7 * width - 1) - 1:
                width += 1
            head += size_bytes(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def write(payload: bytes) -> bytes:
    """A Matroska file with the payload as one track of 8-bit samples."""
    head = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, UNIT * 1_000_000_000 // RATE) + element(MUXING_APP, b"rankloom") + element(WRITING_APP, b"rankloom"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, np.array([RATE], ">f8").tobytes()) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    track = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    parts = [info, element(TRACKS, element(TRACK_ENTRY, track))]
    at, cues = sum(map(len, parts)), []
    per_block = FRAME * FRAMES_PER_BLOCK
    for start in range(0, len(payload), per_block * BLOCKS_PER_CLUSTER):
        body = [number(CLUSTER_TIMESTAMP, start // UNIT)]
        for low in range(start, min(len(payload), start + per_block * BLOCKS_PER_CLUSTER), per_block):
            block = payload[low : low + per_block]
            frames = [block[i : i + FRAME] for i in range(0, len(block), FRAME)]
            lacing = NO_LACING if len(frames) == 1 else FIXED_LACING if len(frames[-1]) == FRAME else EBML_LACING
            # A block's time counts from its cluster's, in 16 bits with a sign; a unit is UNIT samples.
            body.append(element(SIMPLE_BLOCK, b"\x81" + ((low - start) // UNIT).to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1]) + laced(frames, lacing)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, number(CUE_TIME, start // UNIT) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


# ---- reading


@dataclass(frozen=True, slots=True)
class Packet:
    cluster: int
    block: int
    track: int
    timestamp: int  # in the segment's scale; frames of a lace share their block's
    key: bool
    offset: int
    length: int


@dataclass(slots=True)
class Parsed:
    doc_type: str
    scale: int
    tracks: list[dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time, track, offset of the cluster in the file
    clusters: list[int]  # offsets in the file


def read_id(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data) or not data[at]:
        raise ValueError(f"no element id at byte {at}")
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > len(data):
        raise ValueError(f"bad element id at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """The number and where it ends; None if all its bits are ones (an unknown size)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no size at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"a size ends after byte {len(data)}")
    n = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """id, start of the element, start and end of its body; an unknown size goes on to the parent's end."""
    while at < end:
        start = at
        i, at = read_id(data, at)
        n, at = read_size(data, at)
        to = end if n is None else at + n
        if n is None and i == CLUSTER:  # ends where the next element of a segment begins
            to = _open_cluster_end(data, at, end)
        if to > end:
            raise ValueError(f"the element at byte {start} ends after its parent")
        yield i, start, at, to
        at = to


def _open_cluster_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        i, body = read_id(data, at)
        if i in (CLUSTER, CUES, TRACKS, INFO):
            return at
        n, body = read_size(data, body)
        if n is None:
            raise ValueError(f"an unknown size inside a cluster at byte {at}")
        at = body + n
    return end


def unsigned(data: bytes, at: int, to: int) -> int:
    return int.from_bytes(data[at:to], "big")


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """The frames' lengths and where the first begins."""
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise ValueError("a laced block without a head")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED_LACING:
        if (end - at) % n:
            raise ValueError("a fixed lace doesn't divide evenly")
        return [(end - at) // n] * n, at
    if lacing == XIPH_LACING:
        for _ in range(n - 1):
            total = 0
            while True:
                if at >= end:
                    raise ValueError("a lace ends early")
                byte, at = data[at], at + 1
                total += byte
                if byte < 255:
                    break
            sizes.append(total)
    elif n > 1:
        first, at = read_size(data, at)
        sizes.append(first or 0)
        for _ in range(n - 2):
            before = at
            step, at = read_size(data, at)
            width = at - before
            step = (1 << 7 * width) - 1 if step is None else step
            sizes.append(sizes[-1] + step - ((1 << 7 * width - 1) - 1))
    last = end - at - sum(sizes)
    if last < 0 or any(x < 0 for x in sizes):
        raise ValueError("a lace's frames exceed the block")
    return [*sizes, last], at


def parse(data: bytes) -> Parsed:
    out = Parsed("", 1_000_000, [], [], [], [])
    block = 0

    def frames(at: int, end: int, clock: int, key: bool | None) -> None:
        nonlocal block
        track, at = read_size(data, at)
        if at + 3 > end:
            raise ValueError("a block without a head")
        time, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
        sizes, at = lace_sizes(data, at + 3, end, flags >> 1 & 3)
        for n in sizes:
            out.packets.append(Packet(len(out.clusters) - 1, block, track or 0, clock + time, bool(flags & 0x80) if key is None else key, at, n))
            at += n
        block += 1

    for top, _, at, to in elements(data, 0, len(data)):
        if top == EBML:
            for i, _, a, b in elements(data, at, to):
                if i == DOC_TYPE:
                    out.doc_type = data[a:b].rstrip(b"\0").decode("ascii", "replace")
        elif top == SEGMENT:
            base = at
            for i, start, a, b in elements(data, at, to):
                if i == INFO:
                    for j, _, c, d in elements(data, a, b):
                        if j == TIMESTAMP_SCALE:
                            out.scale = unsigned(data, c, d)
                elif i == TRACKS:
                    for _, _, c, d in elements(data, a, b):
                        fields = {j: (e, f) for j, _, e, f in elements(data, c, d)}
                        out.tracks.append({"number": unsigned(data, *fields.get(TRACK_NUMBER, (0, 0))), "type": unsigned(data, *fields.get(TRACK_TYPE, (0, 0))), "codec": data[slice(*fields.get(CODEC_ID, (0, 0)))].decode("ascii", "replace")})
                elif i == CLUSTER:
                    out.clusters.append(start)
                    clock = 0
                    for j, _, c, d in elements(data, a, b):
                        if j == CLUSTER_TIMESTAMP:
                            clock = unsigned(data, c, d)
                        elif j == SIMPLE_BLOCK:
                            frames(c, d, clock, None)
                        elif j == BLOCK_GROUP:
                            inner = {k: (e, f) for k, _, e, f in elements(data, c, d)}
                            if BLOCK in inner:
                                frames(*inner[BLOCK], clock, REFERENCE_BLOCK not in inner)
                elif i == CUES:
                    for j, _, c, d in elements(data, a, b):
                        if j != CUE_POINT:
                            continue
                        time, places = 0, []
                        for k, _, e, f in elements(data, c, d):
                            if k == CUE_TIME:
                                time = unsigned(data, e, f)
                            elif k == CUE_TRACK_POSITIONS:
                                inner = {m: (g, h) for m, _, g, h in elements(data, e, f)}
                                places.append((unsigned(data, *inner.get(CUE_TRACK, (0, 0))), base + unsigned(data, *inner.get(CUE_CLUSTER_POSITION, (0, 0)))))
                        out.cues += [(time, *p) for p in places]
    if not out.doc_type:
        raise ValueError("not an EBML file")
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % UNIT or (0 if raw else UNIT))


def features(parsed: Parsed, payload: bytes) -> str:
    """What the file shows of its samples: frames, cues, time, levels."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    clusters = set(parsed.clusters)
    indexed = sum(c[2] in clusters for c in parsed.cues)
    return f"clusters={len(parsed.clusters)} cues={indexed} packets={len(parsed.packets)} last_ms={max((p.timestamp for p in parsed.packets), default=0) * parsed.scale // 1_000_000} samples={len(samples)} sum={int(samples.sum())} energy={int((samples * samples).sum())} crossings={crossings}"


def _stored(batches: Iterator[pa.RecordBatch], rows_at_once: int = 200, bytes_at_once: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) as (doc_id, n_bytes, media), a bounded number of bytes (or one text) at a time: files are as large as their texts."""

    def made(ids: list, files: list[tuple[int, bytes]], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([n for n, _ in files], pa.int64()), pa.array([m for _, m in files], pa.binary())], names=["doc_id", "n_bytes", "media"])

    for batch in batches:
        ids, files, held = [], [], 0
        for i, text in zip(*batch.columns, strict=True):
            n, payload = payload_of(text.as_py())
            ids.append(i.as_py())
            files.append((n, write(payload)))
            held += n
            if held >= bytes_at_once or len(ids) >= rows_at_once:
                yield made(ids, files, batch.column(0).type)
                ids, files, held = [], [], 0
        if ids:
            yield made(ids, files, batch.column(0).type)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as a Matroska file."""
    return docs.select("doc_id", "text").mapInArrow(_stored, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary")


def packets(files: DataFrame, key: str, media: str) -> DataFrame:
    """A row for each frame of each file: key, cluster, block, track, timestamp, is_key, offset, length, error."""
    fields = ["cluster", "block", "track", "timestamp", "key", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column(0), batch.column(1), strict=True):
                error, found = None, []
                try:
                    found = parse(data.as_py() or b"").packets
                except ValueError as e:
                    error = str(e)
                n = len(found) or int(error is not None)
                columns = [pa.array([getattr(p, f) for p in found] or [None] * n, pa.bool_() if f == "key" else pa.int64()) for f in fields]
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * n, i.type), *columns, pa.array([error] * n, pa.string())], names=["id", "cluster", "block", "track", "timestamp", "is_key", "offset", "length", "error"])

    kind = dict(files.dtypes)[key]
    return files.select(key, media).mapInArrow(run, f"id {kind}, cluster long, block long, track long, timestamp long, is_key boolean, offset long, length long, error string")


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n_bytes, media) as digest rows, all from the stored bytes."""
    for batch in batches:
        rows = []
        for media in batch.column(2):
            data = media.as_py()
            parsed = parse(data)
            payload = b"".join([data[p.offset : p.offset + p.length] for p in parsed.packets])
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(parsed, payload)))
        if rows:
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def read(files: DataFrame) -> DataFrame:
    """The digest rows of files(doc_id, n_bytes, media)."""
    return files.mapInArrow(_digested, f"doc_id {dict(files.dtypes)['doc_id']}, {DIGEST}")


def digests(docs: DataFrame) -> DataFrame:
    """``read`` of ``store`` in one pass: the stored files are read back where they are made and don't travel between workers."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _digested(_stored(batches)), f"doc_id {dict(docs.dtypes)['doc_id']}, {DIGEST}")
