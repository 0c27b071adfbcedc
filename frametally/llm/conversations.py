"""Repair of conversations whose turns are damaged: the cheapest edits that give them a legal structure.

Edits move through layers, one for each row and one at the end, of the four
states of the pattern ``(s?(ua)+)?``.  Minimum costs run forward from the
beginning and backward from the end; an arc whose costs add up to the optimum
is tight, and the tight arcs are the DAG of all optimal edits.  A set of
states walks it from the beginning, always along the least letter.

Conversations are sorted over all tasks by range, so one of any length lies in
many of them, and are cut into segments.  One that lies whole in a task is
repaired there.  The others' segments become matrices of costs between states,
which a pass over the matrices alone adds up forward and backward; then each
segment is walked on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frametally.llm.shared import stored

REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: States: nothing yet, after the system's turn, after a user's, after an assistant's.
STATES = 4
INF = float("inf")
#: state -> {initial: next state}
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0.0, INF, INF, 0.0)
BEGIN = (0.0, INF, INF, INF)
NAMES = {"u": "user", "a": "assistant"}
#: Rows and characters of a segment.
ROWS, CHARS = 512, 1 << 20
_SPACE = " \t\n\v\f\r"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows by the remainder of a CRC of ``conv_id:turn``; nulls count as one space.

    A dropped row stays as one that is gone, so that its conversation is known.
    """
    blank = F.lit(" ")
    code = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    text = F.coalesce("text", blank)
    changed = F.when(code.isin(0, 1), "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(code == 4, "user").otherwise(F.coalesce("role", blank))
    copies = F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), changed.alias("text"), (code == 0).alias("gone"), F.explode(copies).alias("_c")).drop("_c")


# ---- the kernel: rows as symbols of one byte: initial (s, u, a, any other), must be deleted, is cut short -----------

_INITIALS = "sua"


def symbol(role: str, must: bool, short: bool) -> int:
    at = _INITIALS.find(role[:1]) if role else -1
    return (at if at >= 0 else 3) | must << 2 | short << 3


def _arcs(code: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of the edits of a row."""
    out = [("D", q, q, DELETE) for q in range(STATES)]
    if not code & 4:
        extra = CUT_SHORT if code & 8 else 0
        kept = _INITIALS[code & 3 : (code & 3) + 1]
        for q, then in enumerate(NEXT):
            if kept in then:
                out.append(("K", q, then[kept], extra))
            out += [("R", q, then[i], REROLE + extra) for i in "ua" if i in then]
    return out


ARCS = [_arcs(code) for code in range(16)]
INSERTS = [("I", q, then[i], INSERT) for q, then in enumerate(NEXT) for i in "ua" if i in then]


def _inserted(cost: list[float], forward: bool) -> list[float]:
    """Costs with insertions in a layer; two are enough, as a third would come back to a state."""
    for _ in range(2):
        for _, q, r, c in INSERTS:
            if forward:
                cost[r] = min(cost[r], cost[q] + c)
            else:
                cost[q] = min(cost[q], cost[r] + c)
    return cost


def forward(symbols: bytes, begin: tuple[float, ...]) -> list[list[float]]:
    """Least costs from the beginning to each state of each layer; insertions of the last layer aren't in them."""
    out = [list(begin)]
    for code in symbols:
        now, then = _inserted(out[-1], True), [INF] * STATES
        for _, q, r, c in ARCS[code]:
            then[r] = min(then[r], now[q] + c)
        out.append(then)
    return out


def backward(symbols: bytes, end: tuple[float, ...]) -> list[list[float]]:
    """Least costs from each state of each layer to the end, insertions of the layer included."""
    out = [list(end)]
    for code in reversed(symbols):
        then = [INF] * STATES
        for _, q, r, c in ARCS[code]:
            then[q] = min(then[q], out[-1][r] + c)
        out.append(_inserted(then, False))
    return out[::-1]


def closed() -> tuple[float, ...]:
    """Least costs from each state to the end of a conversation without further rows."""
    return tuple(_inserted(list(ENDS), False))


def walked(symbols: bytes, begin: tuple[float, ...], end: tuple[float, ...], start: int, last: bool) -> tuple[str, int]:
    """(letters, state after them) of the least of the optimal edits of a segment that is entered in a state.

    ``end`` has the costs from the end of the segment on; insertions after its
    last row are the next segment's, or this one's if it is the last.
    """
    f, b = forward(symbols, begin), backward(symbols, end)
    if last:
        _inserted(f[-1], True)
    best = min(x + y for x, y in zip(f[-1], b[-1]))
    at, front, out = 0, {start}, []
    while at < len(symbols) or last and not any(ENDS[q] == 0 and f[at][q] == best for q in front):
        steps: dict[str, set[int]] = {}
        for letter, q, r, c in INSERTS + (ARCS[symbols[at]] if at < len(symbols) else []):
            if q in front and f[at][q] + c + b[at + (letter != "I")][r] == best:
                steps.setdefault(letter, set()).add(r)
        letter = min(steps)
        front = steps[letter]
        at += letter != "I"
        out.append(letter)
    return "".join(out), min(front)


@lru_cache(maxsize=1 << 16)
def repaired_whole(symbols: bytes) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    end = closed()
    cost = backward(symbols, end)[0][0]
    return int(cost), walked(symbols, BEGIN, end, 0, True)[0]


@lru_cache(maxsize=1 << 16)
def matrix(symbols: bytes) -> tuple[float, ...]:
    """Least costs from each state before a segment to each after it, row by row."""
    return tuple(c for q in range(STATES) for c in forward(symbols, tuple(0.0 if r == q else INF for r in range(STATES)))[-1])


@dataclass
class Segment:
    """Rows of one conversation in order, and what counting needs of them."""

    turns: list = field(default_factory=list)
    roles: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    chars: int = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def faults(self, fresh: list[bool] | None = None) -> tuple[bytes, int, int, int]:
        """(symbols, blank, duplicate, truncated); ``fresh`` tells which rows are the first of their role and text."""
        seen: set[tuple[str, str]] = set()
        codes, counts = bytearray(), [0, 0, 0]
        for i, (role, text) in enumerate(zip(self.roles, self.texts)):
            stripped = text.strip(_SPACE)
            again = (role, text) in seen if fresh is None else not fresh[i]
            seen.add((role, text))
            fault = 0 if not stripped else 1 if again else 2 if stripped[-1] not in ".!?" else 3
            if fault < 3:
                counts[fault] += 1
            codes.append(symbol(role, fault < 2, fault == 2))
        return bytes(codes), *counts

    def lines(self, letters: str, state: int) -> list[str]:
        """``role:text`` of the rows after edits from a state."""
        out, at = [], 0
        for letter in letters:
            if letter == "D":
                at += 1
                continue
            kept = self.roles[at] if letter == "K" else None
            # an edit that isn't a row's own role is the one that the pattern asks for next
            initial = kept[0] if kept else "a" if state == 2 else "u"
            state = NEXT[state][initial]
            out.append(f"{kept or NAMES[initial]}:{'' if letter == 'I' else self.texts[at]}")
            at += letter != "I"
        return out


_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _illegal(roles: list[str]) -> int:
    return sum((a[:1], b[:1]) not in _LEGAL for a, b in zip(roles, roles[1:]))


def _gaps(low: int | None, high: int | None, different: int) -> int:
    return 0 if low is None else high - low + 1 - different


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _row(conv, seq=None, counts=None, audit=None, digest=None, rows: Segment | None = None) -> tuple:
    return (conv, seq, *(counts or [None] * len(_COUNTS)), audit, digest, *((rows.turns, rows.roles, rows.texts) if rows else (None, None, None)))


def _judged(conv, s: Segment) -> tuple:
    codes, blank, duplicate, truncated = s.faults()
    cost, audit = repaired_whole(codes)
    known = [t for t in s.turns if t is not None]
    gaps = _gaps(min(known, default=None), max(known, default=None), len(set(known)))
    body = "\n".join(s.lines(audit, 0))
    return _row(conv, None, (gaps, blank, duplicate, truncated, _illegal(s.roles), cost), audit, hashlib.sha256(body.encode()).hexdigest())


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    chars = 0

    def made() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    for r in rows:
        held.append(r)
        chars += sum(len(x) if isinstance(x, str) else 64 * len(x) if isinstance(x, list) else 0 for x in r)
        if len(held) >= most or chars >= CHARS:
            yield made()
            held, chars = [], 0
    if held:
        yield made()


def _first_pass(kind: pa.DataType, segment_rows: int):
    """Sorted rows to finished conversations, and to numbered segments of those that a task may not hold whole."""
    schema = pa.schema([("conv_id", kind), ("seq", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33

        def rows() -> Iterator[tuple]:
            nonlocal number
            some, conv, now, edge, first = False, None, Segment(), False, True
            for batch in batches:
                for c, turn, role, text, gone in zip(*(x.to_pylist() for x in batch.columns)):
                    if some and c != conv:
                        # the first of a task may have begun in an earlier one
                        if edge or first:
                            yield _row(conv, number, rows=now)
                            number += 1
                        else:
                            yield _judged(conv, now)
                        now, edge, first = Segment(), False, False
                    elif len(now.turns) >= segment_rows or now.chars >= CHARS:
                        yield _row(conv, number, rows=now)
                        number += 1
                        now, edge = Segment(), True
                    some, conv = True, c
                    if not gone:
                        now.add(turn, role, text)
            if some:
                yield _row(conv, number, rows=now)

        yield from _batches(rows(), schema)

    return run


def _carried(narrow: DataFrame, kind: str, descending: bool) -> DataFrame:
    """(seq, cost): the least costs up to each segment from the beginning, or from each segment's end on, by its matrices.

    One pass over conversations in order, with four numbers kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, conv, now = False, None, BEGIN
        for batch in batches:
            out = []
            for c, _, m in zip(*(x.to_pylist() for x in batch.columns)):
                if not some or c != conv:
                    some, conv, now = True, c, closed() if descending else BEGIN
                out.append(list(now))
                if descending:
                    now = tuple(_inserted([min(m[STATES * q + r] + now[r] for r in range(STATES)) for q in range(STATES)], False))
                else:
                    now = tuple(min(now[q] + m[STATES * q + r] for q in range(STATES)) for r in range(STATES))
            yield pa.record_batch([batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=["seq", "cost"])

    order = F.col("seq").desc() if descending else F.col("seq").asc()
    return narrow.select("conv_id", "seq", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(run, "seq long, cost array<double>")


def _entered(exits: DataFrame) -> DataFrame:
    """(seq, entry): the state in which each segment is entered, by the exits of those before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, conv, now = False, None, 0
        for batch in batches:
            out = []
            for c, _, ends in zip(*(x.to_pylist() for x in batch.columns)):
                if not some or c != conv:
                    some, conv, now = True, c, 0
                out.append(now)
                now = ends[now]
            yield pa.record_batch([batch.column(1), pa.array(out, pa.int32())], names=["seq", "entry"])

    return exits.select("conv_id", "seq", "exits").repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(run, "seq long, entry int")


def _long_ones(segments: DataFrame) -> DataFrame:
    """The results of conversations given as segments (conv_id, seq, turns, roles, texts)."""
    conv = segments.schema["conv_id"].dataType.simpleString()
    # which rows are the first of their role and text: counted before the shuffle, brought back by segment
    flat = segments.select("conv_id", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "x"))
    firsts = flat.groupBy("conv_id", F.col("x.roles").alias("role"), F.sha2("x.texts", 256).alias("digest")).agg(F.min(F.struct("seq", "i")).alias("f"))
    fresh = firsts.groupBy("f.seq").agg(F.collect_set("f.i").alias("fresh"))
    rows = segments.join(fresh, "seq", "left").select("conv_id", "seq", "turns", "roles", "texts", F.coalesce("fresh", F.array().cast("array<int>")).alias("fresh"))

    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        names = batch.schema.names
        for r in zip(*(x.to_pylist() for x in batch.columns)):
            d = dict(zip(names, r))
            first = set(d["fresh"])
            s = Segment(d["turns"], d["roles"], d["texts"])
            yield d, s, s.faults([i in first for i in range(len(s.roles))])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d["seq"], codes, list(matrix(codes)), *counts) for d, _, (codes, *counts) in read(batch)]
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, (pa.int64(), pa.binary(), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.record_batch([batch.column(0), *columns], names=["conv_id", "seq", "codes", "matrix", "blank", "duplicate", "truncated"])

    narrow = stored(rows.mapInArrow(summed, f"conv_id {conv}, seq long, codes binary, matrix array<double>, blank long, duplicate long, truncated long"), "segments")
    before = _carried(narrow, conv, False).withColumnRenamed("cost", "before")
    after = _carried(narrow, conv, True).withColumnRenamed("cost", "after")
    final = narrow.groupBy("conv_id").agg(F.max("seq").alias("seq")).select("seq", F.lit(True).alias("last"))
    costs = narrow.join(before, "seq").join(after, "seq").join(final, "seq", "left")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seq, codes, begin, end, last in zip(*(x.to_pylist() for x in batch.columns[1:])):
                rest = backward(codes, tuple(end))[0]
                best = min(x + y for x, y in zip(begin, rest))
                ways = [walked(codes, tuple(begin), tuple(end), q, bool(last)) if begin[q] + rest[q] == best else ("", 0) for q in range(STATES)]
                out.append((seq, [w[0] for w in ways], [w[1] for w in ways], best))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.float64()))]
            yield pa.record_batch([batch.column(0), *columns], names=["conv_id", "seq", "letters", "exits", "cost"])

    ways = stored(costs.select("conv_id", "seq", "codes", "before", "after", "last").mapInArrow(walk, f"conv_id {conv}, seq long, letters array<string>, exits array<int>, cost double"), "ways")
    chosen = ways.join(_entered(ways), "seq").select("seq", F.get("letters", F.col("entry")).alias("letters"), "entry", "cost")
    told = segments.join(chosen, "seq").join(narrow.select("seq", "blank", "duplicate", "truncated"), "seq")
    names = ["conv_id", "seq", "turns", "roles", "texts", "letters", "entry", "cost", "blank", "duplicate", "truncated"]
    # the digest of a conversation reads its text in order: a stream through one task, of which one segment is held
    pieces = told.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    kind = pa.schema([("conv_id", pa.null()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def told_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = kind

        def results() -> Iterator[tuple]:
            nonlocal schema
            some, conv_id, now = False, None, None
            for batch in batches:
                schema = kind.set(0, pa.field("conv_id", batch.schema.field(0).type))
                for r in zip(*(x.to_pylist() for x in batch.columns)):
                    d = dict(zip(names, r))
                    if not some or d["conv_id"] != conv_id:
                        if some:
                            yield now.result(conv_id)
                        some, conv_id, now = True, d["conv_id"], _Telling()
                    now.add(d)
            if some:
                yield now.result(conv_id)

        for r in results():
            yield pa.record_batch([pa.array([x], t) for x, t in zip(r, schema.types)], schema=schema)

    longs = ", ".join(f"{c} long" for c in _COUNTS)
    return pieces.mapInArrow(told_in_order, f"conv_id {conv}, {longs}, audit string, repaired_sha256 string")


class _Telling:
    """A conversation's counts, letters and digest, segment by segment."""

    def __init__(self) -> None:
        self.sha, self.began, self.letters = hashlib.sha256(), False, []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.role, self.cost = None, 0
        self.low = self.high = None
        self.different = 0

    def add(self, d: dict) -> None:
        s = Segment(d["turns"], d["roles"], d["texts"])
        for c in ("blank", "duplicate", "truncated"):
            self.counts[c] += d[c]
        self.counts["illegal"] += _illegal(([] if self.role is None else [self.role]) + s.roles)
        self.role = s.roles[-1] if s.roles else self.role
        for t in s.turns:
            # in order: a turn that isn't the one before is new
            if t is not None and t != self.high:
                self.low = t if self.low is None else self.low
                self.high, self.different = t, self.different + 1
        self.cost = int(d["cost"])
        self.letters.append(d["letters"])
        for line in s.lines(d["letters"], d["entry"]):
            self.sha.update(("\n" * self.began + line).encode())
            self.began = True

    def result(self, conv) -> tuple:
        c = self.counts
        return conv, _gaps(self.low, self.high, self.different), c["blank"], c["duplicate"], c["truncated"], c["illegal"], self.cost, "".join(self.letters), self.sha.hexdigest()


def repaired(turns: DataFrame, rows: int = ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations (conv_id, turn, role, text).

    The rows are damaged first, see :func:`damaged`, and taken by turn (nulls
    first), rows of one turn by role and the SHA-256 of the text.  A null
    conv_id is a conversation of its own; null roles and texts are one space.
    A conversation without rows after damage has zeros, no edits and the digest
    of the empty string.  An empty table gives no rows; other columns are not read.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    numbered = damaged(turns).withColumns({"_digest": F.sha2("text", 256), "_n": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "_digest", "_n"]
    ordered = numbered.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone")
    arrow = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    longs = ", ".join(f"{c} long" for c in _COUNTS)
    schema = f"conv_id {kind}, seq long, {longs}, audit string, repaired_sha256 string, turns array<long>, roles array<string>, texts array<string>"
    passed = stored(ordered.mapInArrow(_first_pass(arrow, rows), schema), "conversations")
    results = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    long_ones = _long_ones(passed.where("seq is not null").select("conv_id", "seq", "turns", "roles", "texts"))
    return passed.where("seq is null").select(*results).unionByName(long_ones.select(*results))
