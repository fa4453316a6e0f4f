"""Operator 13: repair of conversation structure by a run-length dynamic program.

A sound conversation has the role initials ``(s?(ua)+)?``. Each row becomes a symbol: what it starts
its role with, and its fault. The cheapest edits lead through four states (nothing yet, after s,
after u, after a); a symbol is a 4 x 4 min-plus matrix of what it costs to pass it, insertions before
it included. Equal consecutive symbols are one run, and a run of length k is advanced through cached
binary powers of its matrix, last run first. The choices are then unrolled from the front: at each
place the ASCII-least edit that stays on a cheapest path. Each edit is one letter of the audit and
leads to one state only, so this gives the ASCII-least audit, and the audit alone gives the rows.

The first pass sees 32-byte digests, no texts: equal rows fold before the shuffle, a conversation is
cut by turn into pieces that come back as runs, and only these meet in one task, a few bytes for each
letter of the audit that the result holds in one cell anyway. The second pass deals texts to their
conversations, sorted, and streams them past the audit; it holds no more than one batch of rows. One
conversation is one stream there, as its hash is.

Rows are in the order of turn, nulls first; rows of one turn follow role and digest of the text.
``damage`` makes nulls one space. Elsewhere a null role or text is empty. A role other than system,
user and assistant is told by its first letter; without s, u or a there, it can only be replaced or
deleted. A null conv_id is a conversation of its own. Equal rows are repeats. Texts may have any
length. An empty table has no conversations. Only conv_id, turn, role, text and, where it is there,
``n`` (how often the row stands in its place) are read; other columns may have any name but ``n``.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\x0c\r"
KEEP_FAULT, REROLE, DELETE, INSERT = 3, 3, 4, 3
#: Turns of a piece (a power of two), runs between two kept values, rows unrolled at once.
PIECE_BITS, RUNS, ROWS = 12, 4096, 4096
#: Where each state leads by a role's initial, and the role that an edit may write there.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WRITES = ("user", "user", "assistant", "user")
ENDS = (0, 3)
INITIALS, LED, OTHER, GONE = "sua?", {"s", "u", "a"}, 3, 8
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


# ---- min-plus ---------------------------------------------------------------------------------


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    return tuple(tuple(min(FAR, *(x + b[k][j] for k, x in enumerate(row))) for j in range(4)) for row in a)


def passed(m: Matrix, v: Vector) -> Vector:
    """Cheapest cost from each state through a matrix to the values behind it."""
    return tuple(min(FAR, *(x + y for x, y in zip(row, v, strict=True))) for row in m)


def _written(state: int) -> int:
    return NEXT[state][WRITES[state][0]]


def insertions() -> Matrix:
    """Cost of insertions from state to state."""
    one = [[0 if i == j else INSERT if j == _written(i) else FAR for j in range(4)] for i in range(4)]
    m = tuple(map(tuple, one))
    return product(product(m, m), m)


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row, in ASCII order."""
    found = [("D", DELETE, state)]
    if symbol != GONE:
        initial, fault = INITIALS[symbol // 2], KEEP_FAULT * (symbol % 2)
        if initial in NEXT[state]:
            found.append(("K", fault, NEXT[state][initial]))
        found.append(("R", REROLE + fault, _written(state)))
    return found


@cache
def power(symbol: int, bit: int) -> Matrix:
    """The matrix of 2^bit rows of a symbol."""
    if bit:
        half = power(symbol, bit - 1)
        return product(half, half)
    one = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, to in edits(symbol, state):
            one[state][to] = min(one[state][to], cost)
    return product(insertions(), tuple(map(tuple, one)))


def advance(symbol: int, length: int, v: Vector) -> Vector:
    """Values before a run from those behind it."""
    bit = 0
    while length:
        if length & 1:
            v = passed(power(symbol, bit), v)
        length, bit = length >> 1, bit + 1
    return v


def best_edits(symbols, lengths) -> tuple[int, str]:
    """Cost and audit of a conversation, given as runs. Values are kept at every ``RUNS`` runs only."""
    end = passed(insertions(), tuple(0 if s in ENDS else FAR for s in range(4)))
    marks, v = [end], end
    starts = range(0, len(symbols), RUNS)
    for a in reversed(starts):
        for i in range(min(a + RUNS, len(symbols)) - 1, a - 1, -1):
            v = advance(symbols[i], lengths[i], v)
        marks.append(v)
    marks.reverse()
    out, state = bytearray(), 0
    for block, a in enumerate(starts):
        b = min(a + RUNS, len(symbols))
        behind = [marks[block + 1]]
        for i in range(b - 1, a, -1):
            behind.append(advance(symbols[i], lengths[i], behind[-1]))
        for i, v in zip(range(a, b), reversed(behind), strict=True):
            state = _unroll(symbols[i], lengths[i], v, state, out)
    while state not in ENDS:
        out.append(ord("I"))
        state = _written(state)
    return marks[0][0], out.decode()


def _unroll(symbol: int, length: int, end: Vector, state: int, out: bytearray) -> int:
    """Adds the letters of one run; returns the state behind it."""
    for left in range(length, 0, -ROWS):
        rows = min(ROWS, left)
        values = [advance(symbol, left - rows, end)]
        for _ in range(rows):
            values.append(advance(symbol, 1, values[-1]))
        for at in range(rows, 0, -1):
            state = _one_row(symbol, values[at], values[at - 1], state, out)
    return state


def _one_row(symbol: int, here: Vector, behind: Vector, state: int, out: bytearray) -> int:
    while True:
        choices = {letter: to for letter, cost, to in edits(symbol, state) if cost + behind[to] == here[state]}
        if INSERT + here[_written(state)] == here[state]:
            choices["I"] = -1
        letter = min(choices)
        out.append(ord(letter))
        if letter != "I":
            return choices[letter]
        state = _written(state)


# ---- rows -------------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with ``n`` copies after a fault told by crc32 of ``conv_id:turn``; dropped rows have n = 0."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(filled["conv_id"], F.lit(":"), filled["turn"])) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled["text"], "[.!?]", "")).otherwise(filled["text"])
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(filled["role"]).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _prepared(rows: DataFrame) -> DataFrame:
    """Rows with the fault of their text (1 truncated, 2 blank) and its digest; blank texts have none."""
    text, bare = F.coalesce("text", F.lit("")), F.rtrim("text", F.lit(BLANK))
    n = F.col("n") if "n" in rows.columns else F.lit(1).cast("long")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), n.alias("n"))
    fault = F.when(bare == "", 2).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    rows = rows.withColumn("fault", fault)
    return rows.withColumn("sha", F.when(F.col("fault") < 2, F.unhex(F.sha2("text", 256))))


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc_nulls_first("sha")]


class Piece:
    """Runs and counts of consecutive rows of one conversation."""

    COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")

    def __init__(self):
        self.symbols, self.lengths = array("B"), array("Q")
        self.counts = dict.fromkeys(self.COUNTS, 0)
        self.first = self.last = None  # initials
        self.low = self.high = None  # turns

    def add(self, turn: int | None, role: str, fault: int, is_first: bool, n: int) -> None:
        """``n`` equal rows; the first of them is no repeat if ``is_first``."""
        initial = role[:1]
        self._meet(initial, n - 1)
        if turn is not None and turn != self.high:
            self.counts["turns"] += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        fresh = int(is_first and fault < 2)
        if fresh:
            self._run(2 * (INITIALS.index(initial) if initial in LED else OTHER) + fault, 1)
            self.counts["truncated"] += fault
        if n > fresh:
            self._run(GONE, n - fresh)
            self.counts["blank" if fault == 2 else "duplicate"] += n - fresh

    def _meet(self, initial: str, again: int = 0) -> None:
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.counts["illegal"] += again
        self.last = initial

    def _run(self, symbol: int, length: int) -> None:
        if self.symbols and self.symbols[-1] == symbol:
            self.lengths[-1] += length
        else:
            self.symbols.append(symbol)
            self.lengths.append(length)

    def follow(self, piece: dict) -> None:
        """Puts the piece of the next turns behind."""
        if piece["first"] is None:
            return
        self._meet(piece["first"])
        self.last = piece["last"]
        for name in self.COUNTS:
            self.counts[name] += piece[name]
        if piece["low"] is not None:
            self.low, self.high = piece["low"] if self.low is None else self.low, piece["high"]
        symbols, lengths = array("B", piece["symbols"]), array("Q")
        lengths.frombytes(piece["lengths"])
        for symbol, length in zip(symbols, lengths, strict=True):
            self._run(symbol, length)

    def row(self) -> dict:
        ends = {"first": self.first, "last": self.last, "low": self.low, "high": self.high}
        return {"symbols": self.symbols.tobytes(), "lengths": self.lengths.tobytes(), **ends, **self.counts}

    def plan(self) -> dict:
        cost, audit = best_edits(self.symbols, self.lengths)
        counts = {name: self.counts[name] for name in self.COUNTS[:-1]}
        gaps = self.high - self.low + 1 - self.counts["turns"] if self.low is not None else 0
        return {"gaps": gaps, **counts, "cost": cost, "audit": audit}


PIECE = "symbols binary, lengths binary, first string, last string, low long, high long, " + ", ".join(f"{c} long" for c in Piece.COUNTS)
PLAN = "gaps long, " + ", ".join(f"{c} long" for c in Piece.COUNTS[:-1]) + ", cost long, audit string"
STRINGS, BINARIES = {"audit", "first", "last", "role", "text", "edit", "repaired_sha256"}, {"symbols", "lengths"}


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield dict(zip(names, values, strict=True))


def _packed(rows: Iterator[dict], conv_id: pa.DataType, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``size`` bytes."""
    held, room = [], size
    for row in rows:
        held.append(row)
        room -= 64 + sum(len(v) for v in row.values() if isinstance(v, str | bytes))
        if room < 0:
            yield _batch(held, conv_id)
            held, room = [], size
    if held:
        yield _batch(held, conv_id)


def _batch(rows: list[dict], conv_id: pa.DataType) -> pa.RecordBatch:
    kind = lambda c: conv_id if c == "conv_id" else pa.string() if c in STRINGS else pa.binary() if c in BINARIES else pa.int64()
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, kind(c)) for c in rows[0]]))


def _streamed(body):
    """A task function out of one that maps an iterator of rows to one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            kind = first.schema.field("conv_id").type

            def rest():
                yield first
                yield from batches

            yield from _packed(body(_listed(rest())), kind)

    return task


def _pieces(rows: Iterator[dict]) -> Iterator[dict]:
    key = piece = None
    for r in rows:
        if piece is None or key != (r["conv_id"], r["piece"]):
            if piece is not None:
                yield {"conv_id": key[0], "piece": key[1], **piece.row()}
            key, piece = (r["conv_id"], r["piece"]), Piece()
        if r["n"]:
            piece.add(r["turn"], r["role"], r["fault"], r["is_first"], r["n"])
    if piece is not None:
        yield {"conv_id": key[0], "piece": key[1], **piece.row()}


def _plans(rows: Iterator[dict]) -> Iterator[dict]:
    key = whole = None
    for r in rows:
        if whole is None or key != r["conv_id"]:
            if whole is not None:
                yield {"conv_id": key, **whole.plan()}
            key, whole = r["conv_id"], Piece()
        whole.follow(r)
    if whole is not None:
        yield {"conv_id": key, **whole.plan()}


def plans(rows: DataFrame) -> DataFrame:
    """Counts, cost and audit of every conversation."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    there = F.col("n") > 0
    facts = (
        _prepared(rows)
        .select(
            "conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.col("role")).alias("role"),
            F.when(there, F.col("sha")).alias("sha"), F.when(there, F.col("fault")).alias("fault"), "n",
        )
        .groupBy("conv_id", "turn", "role", "sha", "fault")
        .agg(F.sum("n").alias("n"))
    )
    seen = (
        facts.where("sha is not null")
        .groupBy("conv_id", "role", "sha")
        .agg(F.when(F.count("turn") == F.count(F.lit(1)), F.min("turn")).alias("since"))
        .withColumnsRenamed({c: f"seen_{c}" for c in ("conv_id", "role", "sha")})
    )
    same = F.col("conv_id").eqNullSafe(F.col("seen_conv_id")) & F.expr("role = seen_role and sha = seen_sha")
    marked = facts.join(seen, same, "left").select(
        "conv_id", F.shiftright("turn", PIECE_BITS).alias("piece"), "turn", "role", "sha", "fault", "n",
        F.col("turn").eqNullSafe(F.col("since")).alias("is_first"),
    )
    pieces = (
        marked.repartition("conv_id", "piece")
        .sortWithinPartitions("conv_id", F.asc_nulls_first("piece"), *_order())
        .select("conv_id", "piece", "turn", "role", "fault", "n", "is_first")
        .mapInArrow(_streamed(_pieces), f"conv_id {id_type}, piece long, {PIECE}")
    )
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("piece"))
    return ordered.mapInArrow(_streamed(_plans), f"conv_id {id_type}, {PLAN}")


def _edited(rows: Iterator[dict]) -> Iterator[tuple[dict, str | None, str | None, str | None]]:
    """(plan, edit, role, text) of every row that a repair keeps or writes; one without edit starts a conversation."""
    plan, audit, at, state = None, "", 0, 0

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = WRITES[state]
            at, state = at + 1, _written(state)
            yield plan, "I", role, ""

    for r in rows:
        if r["audit"] is not None:
            if plan is not None:
                yield from inserted()
            plan, audit, at, state = r, r["audit"], 0, 0
            yield plan, None, None, None
            continue
        for _ in range(r["n"]):
            yield from inserted()
            letter, at = audit[at], at + 1
            if letter == "D":
                continue
            role = r["role"] if letter == "K" else WRITES[state]
            state = NEXT[state][role[0]]
            yield plan, letter, role, r["text"]
    if plan is not None:
        yield from inserted()


def _repaired(rows: Iterator[dict]) -> Iterator[dict]:
    pos = 0
    for plan, edit, role, text in _edited(rows):
        pos = pos + 1 if edit else 0
        if edit:
            yield {"conv_id": plan["conv_id"], "pos": pos, "edit": edit, "role": role, "text": text}


def _digests(rows: Iterator[dict]) -> Iterator[dict]:
    now = sha = None
    joint = b""
    names = ["conv_id", "gaps", *Piece.COUNTS[:-1], "cost", "audit"]
    for plan, edit, role, text in _edited(rows):
        if edit is None:
            if now is not None:
                yield {**{c: now[c] for c in names}, "repaired_sha256": sha.hexdigest()}
            now, sha, joint = plan, hashlib.sha256(), b""
            continue
        sha.update(joint + f"{role}:{text}".encode())
        joint = b"\n"
    if now is not None:
        yield {**{c: now[c] for c in names}, "repaired_sha256": sha.hexdigest()}


def _beside_plans(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows in order behind the plan of their conversation, in one partition each."""
    texts = _prepared(rows).where("n > 0").select("conv_id", "turn", "role", "sha", F.when(F.col("fault") < 2, F.col("text")).alias("text"), "n")
    both = planned.unionByName(texts, allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_order())
    return dealt.drop("turn", "sha")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, edit, role, text): the rows of every repaired conversation and the edit each comes from."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    return _beside_plans(rows, plans(rows)).mapInArrow(
        _streamed(_repaired), f"conv_id {id_type}, pos long, edit string, role string, text string"
    )


def repair_audit(rows: DataFrame) -> DataFrame:
    """One row per conversation: faults, cost, audit and the digest of the repaired conversation."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    return _beside_plans(rows, plans(rows)).mapInArrow(_streamed(_digests), f"conv_id {id_type}, {PLAN}, repaired_sha256 string")
