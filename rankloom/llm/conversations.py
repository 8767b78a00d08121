"""Conversation structure repair by error-correcting Earley parsing.

The role grammar is ``(s? (ua)+)?``, weighted: a user or assistant turn is a row
kept as it is, a row given the role, or an empty turn that is inserted, and any
row may be deleted. Its rules are left-recursive, so every chart set holds a
bounded number of items whatever the length. Each item keeps its least (cost,
audit), the audit being the initials of the edits so far; an item that becomes
cheaper is worked off again, and the completed chart yields the repair. Of two
different audits of equal cost between the same rows and states neither is the
beginning of the other, so the least of a whole consists of least parts.

That also lets conversations be cut: rows lie in ranges of (conversation, turn),
and a conversation that ends in the middle of a range and is short is parsed,
repaired and hashed there. Of any other one each segment of at most ``ROWS`` rows
(or ``BYTES`` of text) is parsed from all four states of the grammar, the segments'
charts are joined in order, and its rows stream once through the digest, which by
its nature takes one conversation in one order. So a conversation with a third of
all rows needs no more memory than its audit, which is part of the result.

A role and text seen earlier is told by the first turn that has it, found by
partial aggregation; keys that a thousandth of all rows have are joined by
broadcast. Rows equal in everything are one row with a count until they are parsed.

Defined cases: a null role or text is one space; null turns come first; rows of
one turn are ordered by role, then text. Null ids are one conversation. Roles of
other initials than s, u and a can't be kept. Other columns are ignored. An
empty table gives no rows. A conversation may have 2^31 edits at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import HOT_PARTS, cut

#: Rows and bytes of text of a segment; bytes of a range; open conversations whose ids are broadcast.
ROWS, BYTES, RANGE_BYTES, BROADCAST_IDS = 4096, 16 << 20, 64 << 20, 1_000_000
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
Value = tuple[int, str]


@dataclass(frozen=True)
class Rule:
    """left -> right. ``right`` names parts of the grammar, or holds one terminal: an initial, or ANY. An edit has a cost and a letter."""

    left: str
    right: tuple[str, ...]
    cost: int = 0
    letter: str = ""


ANY = "*"
#: What has been put out so far: nothing, the system turn, a user turn last, an assistant turn last.
STATES = ("begin", "system", "asked", "answered")
RULES = (
    Rule("system", ("begin", "kept system")),
    Rule("asked", ("begin", "user")), Rule("asked", ("system", "user")), Rule("asked", ("answered", "user")),
    Rule("answered", ("asked", "assistant")),
    *(Rule(s, (s, "deleted")) for s in STATES),
    Rule("kept system", ("s",), 0, "K"),
    Rule("user", ("u",), 0, "K"), Rule("user", (ANY,), 2, "R"), Rule("user", (), 2, "I"),
    Rule("assistant", ("a",), 0, "K"), Rule("assistant", (ANY,), 2, "R"), Rule("assistant", (), 2, "I"),
    Rule("deleted", (ANY,), 3, "D"),
)
BY_LEFT: dict[str, list[int]] = {}
for _i, _rule in enumerate(RULES):
    BY_LEFT.setdefault(_rule.left, []).append(_i)
Row = tuple[str, str]  # a row's initial and fault


class _Set:
    """A chart set: the best value of each item (rule, dot, origin), and the items that wait for a part of the grammar."""

    def __init__(self) -> None:
        self.best: dict[tuple[int, int, int], Value] = {}
        self.waiting: dict[str, list[tuple[int, int, int]]] = {}
        self.empty: dict[str, Value] = {}  # parts completed where they began
        self.agenda: list[tuple[int, int, int]] = []

    def add(self, item: tuple[int, int, int], value: Value) -> None:
        if item not in self.best or value < self.best[item]:
            self.best[item] = value
            self.agenda.append(item)


def parse(rows: Iterable[Row], start: str = "begin") -> dict[str, Value]:
    """The least (cost, audit) by the state reached, for rows parsed from a state."""
    first = _Set()
    for s in STATES:
        for r in BY_LEFT[s]:
            first.add((r, 0, 0), (0, ""))
    first.empty[start] = (0, "")
    sets, reached, at = {0: first}, {start: (0, "")}, 0
    _close(sets, 0, reached)
    for row in rows:
        nxt = _Set()
        for part, items in sets[at].waiting.items():
            if part in BY_LEFT:
                continue
            usable = row[1] not in (BLANK, DUPLICATE)
            for item in items:
                rule = RULES[item[0]]
                if rule.letter != "D" and (not usable or part not in (ANY, row[0])):
                    continue
                nxt.add((item[0], 1, item[2]), (rule.cost + (rule.letter != "D" and row[1] == TRUNCATED), rule.letter))
        sets, at = {0: first, at: sets[at], at + 1: nxt}, at + 1
        reached = {}
        _close(sets, at, reached)
    return reached


def _close(sets: dict[int, _Set], at: int, reached: dict[str, Value]) -> None:
    """Predict and complete until nothing in the set gets cheaper."""
    here = sets[at]
    while here.agenda:
        item = here.agenda.pop()
        r, dot, origin = item
        rule, (cost, audit) = RULES[r], here.best[item]
        if dot < len(rule.right):
            part = rule.right[dot]
            waiting = here.waiting.setdefault(part, [])
            if item not in waiting:
                waiting.append(item)
                for p in BY_LEFT.get(part, ()):
                    if part not in STATES:  # states are predicted once, where the chart begins
                        here.add((p, 0, at), (0, ""))
            if part in here.empty:
                c, a = here.empty[part]
                here.add((r, dot + 1, origin), (cost + c, audit + a))
            continue
        if not rule.right:
            cost, audit = rule.cost, rule.letter
        if origin == 0 and rule.left in STATES and (rule.left not in reached or (cost, audit) < reached[rule.left]):
            reached[rule.left] = (cost, audit)
        if origin == at and (rule.left not in here.empty or (cost, audit) < here.empty[rule.left]):
            here.empty[rule.left] = (cost, audit)
        for other in list(sets[origin].waiting.get(rule.left, ())):
            c, a = sets[origin].best[other]
            here.add((other[0], other[1] + 1, other[2]), (c + cost, a + audit))


def accepted(reached: dict[str, Value]) -> Value:
    return min(reached[s] for s in ("begin", "answered") if s in reached)


def joined(before: dict[str, Value], ways: dict[str, dict[str, Value]]) -> dict[str, Value]:
    """What is reached over a segment from each state that was reached before it."""
    out: dict[str, Value] = {}
    for s, (c, a) in before.items():
        for e, (c2, a2) in ways.get(s, {}).items():
            if e not in out or (c + c2, a + a2) < out[e]:
                out[e] = (c + c2, a + a2)
    return out


class Repairer:
    """Follows an audit over the rows and hashes the repaired turns."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.last, self.digest, self.any = audit, 0, "", hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "replace"))
        self.any, self.last = True, role[:1]

    def _due(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._put(self._due(), "")

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            self._put(role if letter == "K" else self._due(), text)

    def end(self) -> str:
        self._inserts()
        return self.digest.hexdigest()


@dataclass
class Segment:
    """Consecutive rows of a conversation, and what is counted of them."""

    rows: list[Row] = field(default_factory=list)
    turns: list[tuple[str, str]] = field(default_factory=list)
    size: int = 0
    first: str | None = None
    last: str | None = None
    low: int | None = None
    high: int | None = None
    n_turns: int = 0
    counts: dict[str, int] = field(default_factory=lambda: {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, "illegal": 0})

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        self.rows.append((role[:1], fault))
        self.turns.append((role, text))
        self.size += len(role) + len(text)
        if fault:
            self.counts[fault] += 1
        self._follow(role[:1], role[:1])
        if turn is not None:
            self.n_turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def _follow(self, first: str, last: str) -> None:
        if self.last is not None and self.last + first not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.first, self.last = first if self.first is None else self.first, last

    def take(self, other: dict) -> None:
        """Add the counts of the segment that follows."""
        for name in self.counts:
            self.counts[name] += other[name]
        if other["first"] is not None:
            self._follow(other["first"], other["last"])
        if other["low"] is not None:
            self.n_turns += other["n_turns"] - (other["low"] == self.high)
            self.low, self.high = other["low"] if self.low is None else self.low, other["high"]

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.n_turns

    def row(self) -> dict:
        return {"first": self.first, "last": self.last, "low": self.low, "high": self.high, "n_turns": self.n_turns, **self.counts}


#: Columns of parsed segments. Of a whole conversation (open is false) the result is there, of an open one the ways through a segment.
PARSED = pa.schema([
    ("conv", pa.string()), ("conv_id", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("open", pa.bool_()), ("first", pa.string()), ("last", pa.string()),
    ("low", pa.int64()), ("high", pa.int64()), ("n_turns", pa.int64()), (BLANK, pa.int64()), (DUPLICATE, pa.int64()), (TRUNCATED, pa.int64()), ("illegal", pa.int64()),
    ("gaps", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
    ("ways", pa.list_(pa.struct([("a", pa.string()), ("b", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])))])
_COUNTS = f"first string, last string, low long, high long, n_turns long, {BLANK} long, {DUPLICATE} long, {TRUNCATED} long, illegal long"
_RESULT = "gaps long, cost long, audit string, repaired_sha256 string"
OUT = f"conv_id string, gaps long, {BLANK} long, {DUPLICATE} long, {TRUNCATED} long, illegal long, cost long, audit string, repaired_sha256 string"


def _batches(rows: Iterator[dict], schema: pa.Schema, each: int = 500, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("audit") or "") + sum(len(w["audit"]) for w in row.get("ways") or ())
        if len(held) == each or size > most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _copies(row: dict) -> Iterator[str]:
    """The faults of a row's copies: those behind the first are duplicates, if not blank."""
    for k in range(row["n"]):
        yield row["fault"] if k == 0 or row["fault"] == BLANK else DUPLICATE


def _parsed(rows: Iterator[dict], limit: int, most: int) -> Iterator[dict]:
    """Whole conversations and open segments of one range of sorted rows."""
    conv, conv_id, part, seq, segment, edge = None, None, 0, 0, None, True

    def out(open_: bool) -> dict:
        row = {"conv": conv, "conv_id": conv_id, "part": part, "seq": seq, "open": open_, **segment.row()}
        if open_:
            ways = [{"a": s, "b": e, "cost": c, "audit": a} for s in STATES for e, (c, a) in parse(segment.rows, s).items()]
            return row | {"ways": ways}
        cost, audit = accepted(parse(segment.rows))
        repairer = Repairer(audit)
        for role, text in segment.turns:
            repairer.row(role, text)
        return row | {"gaps": segment.gaps(), "cost": cost, "audit": audit, "repaired_sha256": repairer.end()}

    for row in rows:
        if row["conv"] != conv:
            if segment:
                yield out(edge or seq > 0)
                edge = False
            conv, conv_id, part, seq, segment = row["conv"], row["conv_id"], row["part"], 0, Segment()
        for fault in _copies(row):
            if len(segment.rows) >= limit or segment.size >= most:
                yield out(True)
                seq, segment = seq + 1, Segment()
            segment.add(row["turn"], row["role"], row["text"], fault)
    if segment:
        yield out(True)


def _combined(rows: Iterator[dict]) -> Iterator[dict]:
    """One row for each open conversation from its segments in order."""
    conv, conv_id, whole, reached = None, None, None, {}

    def out() -> dict:
        cost, audit = accepted(reached)
        return {"conv": conv, "conv_id": conv_id, **whole.row(), "gaps": whole.gaps(), "cost": cost, "audit": audit}

    for row in rows:
        if row["conv"] != conv:
            if whole:
                yield out()
            conv, conv_id, whole, reached = row["conv"], row["conv_id"], Segment(), {"begin": (0, "")}
        whole.take(row)
        ways: dict[str, dict[str, Value]] = {}
        for w in row["ways"]:
            ways.setdefault(w["a"], {})[w["b"]] = (w["cost"], w["audit"])
        reached = joined(reached, ways)
    if whole:
        yield out()


def _hashed(rows: Iterator[dict]) -> Iterator[dict]:
    """Results of open conversations: each one's own row comes first, then its turns."""
    head, repairer = None, None
    for row in rows:
        if row["kind"] == 0:
            if head:
                yield head | {"repaired_sha256": repairer.end()}
            head, repairer = row, Repairer(row["audit"])
        else:
            for _ in range(row["n"]):
                repairer.row(row["role"], row["text"])
    if head:
        yield head | {"repaired_sha256": repairer.end()}


def _in_arrow(df: DataFrame, run, schema: pa.Schema, ddl: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(({n: r.get(n) for n in schema.names} for r in run(_records(batches))), schema)

    return df.mapInArrow(each, ddl)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: the rows after damage with the times they stand there; dropped rows have n = 0, and no role or text."""
    name = F.concat(*(x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))))
    draw = F.crc32(F.substring(name, F.lit(1), F.length(name) - 1).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(draw == 0, "").when(draw == 4, "user").otherwise(role).alias("role"),
        F.when(draw <= 1, "").when(draw == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).cast("long").alias("n"))


def _order(turn: str = "turn") -> Column:
    return F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"))


def with_faults(rows: DataFrame) -> DataFrame:
    """The distinct rows(conv, conv_id, turn, role, text) with their number n and each one's fault ('' if it has none)."""
    rows = rows.groupBy("conv", "conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cutoff = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    seen = F.sha2(F.concat_ws(":", "conv", F.length("role").cast("string"), "role", "text"), 256)
    rows = cut(rows.withColumn("own", F.when(F.col("n") < 1, "").when(blank, BLANK).when(cutoff, TRUNCATED).otherwise("")).withColumn("seen", F.when((F.col("n") > 0) & ~blank, seen)))
    again = cut(rows.where("seen is not null").groupBy("seen").agg(F.min(_order()).alias("earliest"), F.count(F.lit(1)).alias("places")).where("places > 1"))
    least = max(1, -(-rows.count() // HOT_PARTS))
    hot = F.broadcast(again.where(F.col("places") >= least))
    later = F.when(_order() > F.col("earliest"), DUPLICATE).otherwise(F.col("own")).alias("fault")
    first = ["conv", "conv_id", "turn", "role", "text", "n"]
    cold = rows.where("seen is not null").join(hot.select("seen"), "seen", "left_anti").join(again.where(F.col("places") < least), "seen", "left")
    out = rows.join(hot, "seen").select(*first, later).unionByName(cold.select(*first, later))
    return out.unionByName(rows.where("seen is null").select(*first, F.col("own").alias("fault")))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of rows(conv_id, turn, role, text, n).

    A conversation without rows (n is 0) has zeros, an empty audit and the hash of nothing.
    """
    kind = dict(rows.dtypes)["conv_id"]
    # a key that is never null, and ids as text on the way
    rows = rows.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", "text", "n")
    place = ["conv", "turn", "role", "text"]
    faulty = cut(with_faults(rows))
    size = faulty.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    ranges = max(8, -(-size // RANGE_BYTES))
    ordered = cut(faulty.repartitionByRange(ranges, *place).sortWithinPartitions(*place).withColumn("part", F.spark_partition_id()))
    limit, most = ROWS, BYTES
    ddl = f"conv string, conv_id string, part int, seq long, open boolean, {_COUNTS}, {_RESULT}, ways array<struct<a:string,b:string,cost:long,audit:string>>"
    parsed = cut(_in_arrow(ordered, lambda r: _parsed(r, limit, most), PARSED, ddl))

    several = parsed.where("open").repartition("conv").sortWithinPartitions("conv", "part", "seq")
    names = ["conv", "conv_id", "first", "last", "low", "high", "n_turns", BLANK, DUPLICATE, TRUNCATED, "illegal", "gaps", "cost", "audit"]
    heads = cut(_in_arrow(several, _combined, pa.schema([PARSED.field(n) for n in names]), f"conv string, conv_id string, {_COUNTS}, gaps long, cost long, audit string"))
    ids = heads.select("conv")
    open_rows = ordered.join(F.broadcast(ids) if heads.count() <= BROADCAST_IDS else ids, "conv", "left_semi")
    numbers = ["gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost"]
    stream = heads.select("conv", "conv_id", F.lit(0).alias("kind"), *numbers, "audit").unionByName(open_rows.select("conv", F.lit(1).alias("kind"), "turn", "role", "text", "n"), allowMissingColumns=True)
    stream = stream.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "text")
    result = ["conv_id", *numbers, "audit", "repaired_sha256"]
    long = _in_arrow(stream, _hashed, pa.schema([PARSED.field(n) for n in ["conv_id", "gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost", "audit", "repaired_sha256"]]), OUT)
    return parsed.where("not open").select(*result).unionByName(long).withColumn("conv_id", F.col("conv_id").cast(kind))
