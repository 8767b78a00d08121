"""Conversation repair against every possible sequence of edits."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from rankloom.llm import conversations as C

SOUND = re.compile(r"(s?(ua)+)?")
STRIP = " \t\n\x0b\x0c\r"


@lru_cache(None)
def cheapest(rows):
    """(cost, audit, turns put out) of rows(initial, fault) by trying all edits; turns are (row or None, role or None for kept)."""
    best = None
    for n in range(len(rows) + 5):
        for letters in itertools.product("DIKR", repeat=n):
            if sum(x != "I" for x in letters) != len(rows):
                continue
            cost, at, slots, ok = 0, 0, [], True
            for x in letters:
                if x == "I":
                    cost += 2
                    slots.append([(None, "user"), (None, "assistant")])
                    continue
                initial, fault = rows[at]
                if x == "D":
                    cost += 3
                else:
                    ok &= fault not in ("blank", "duplicate")
                    cost += 2 * (x == "R") + (fault == "truncated")
                    slots.append([(at, None)] if x == "K" else [(at, "user"), (at, "assistant")])
                at += 1
            if not ok or best and (cost, "".join(letters)) >= best[:2]:
                continue
            for turns in itertools.product(*slots):
                if SOUND.fullmatch("".join(role[0] if role else rows[i][0] or "?" for i, role in turns)):
                    best = (cost, "".join(letters), turns)
                    break
    return best


def plain(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in sorted((r for r in table if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            role, text = " " if role is None else role, " " if text is None else text
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            draw = zlib.crc32(name.encode()) % 20
            if draw == 1:
                text = ""
            if draw == 2:
                text = re.sub("[.!?]", "", text)
            if draw == 4:
                role = "user"
            rows += [(turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in rows:
            bare = text.strip(STRIP)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, put = cheapest(tuple((r[1][:1], f) for r, f in zip(rows, faults, strict=True)))
        said = "\n".join(f"{role or rows[i][1]}:{rows[i][2] if i is not None else ''}" for i, role in put)
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def result(spark, table, **kw):
    df = spark.createDataFrame([(*r, 7) for r in table], "conv_id long, turn long, role string, text string, conv int")
    got = C.repair(C.damaged(df)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: tuple(r[1:]) for r in got}


def made(rng, convs, most):
    texts = ["Yes.", "No!", "Why?", "cut off", "é ü.", " \n", "a. ", "Yes."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]
    table = []
    for conv in [*range(convs), None]:
        turn = rng.randrange(3)
        for _ in range(rng.randrange(1, most + 1)):
            table.append((conv, None if rng.random() < 0.05 else turn, rng.choice(roles), rng.choice([*texts, None])))
            turn += rng.choice((0, 1, 1, 1, 2))
    return table


@pytest.mark.parametrize("rows,size", [(4096, 1 << 24), (2, 1 << 24), (4096, 8)])
def test_repair_equals_trying_all_edits(spark, monkeypatch, rows, size):
    monkeypatch.setattr(C, "ROWS", rows)
    monkeypatch.setattr(C, "BYTES", size)
    table = made(random.Random(13), 120, 4)
    assert result(spark, table) == plain(table)


def test_charts_of_segments_join_to_the_chart_of_the_whole():
    rng = random.Random(3)
    for _ in range(300):
        rows = [(rng.choice("suat"), rng.choice(("", "", "", "truncated", "blank", "duplicate"))) for _ in range(rng.randrange(0, 14))]
        whole = C.parse(rows)
        at, parts = rng.randrange(len(rows) + 1), {"begin": (0, "")}
        for piece in (rows[:at], rows[at:]):
            parts = C.joined(parts, {s: C.parse(piece, s) for s in C.STATES})
        assert parts == whole
        if len(rows) <= 4:
            assert C.accepted(whole) == cheapest(tuple(rows))[:2]


def test_one_conversation_of_many_rows_and_long_texts(spark, monkeypatch):
    rng = random.Random(4)
    table = [(1, t, "user" if t % 2 else "assistant", f"{rng.random()} said.") for t in range(9000)] + [(2, 0, "user", "word " * 200_000 + "."), (2, 1, "assistant", "Yes.")]
    table += [(3, 5, "user", "Same.")] * 500
    got = result(spark, table)
    monkeypatch.setattr(C, "BROADCAST_IDS", 0)
    monkeypatch.setattr(C, "ROWS", 100)
    assert result(spark, table) == got
    copies = 1000 if zlib.crc32(b"3:5") % 20 == 3 else 500
    assert got[3][2] in (copies - 1, 0) and len(got) == 3
    assert len(got[1][6]) >= 8000 and got[1][5] > 0


def test_empty_tables_and_conversations(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert result(spark, [(gone, 0, "user", "Hello.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair(C.damaged(df)).count() == 0
