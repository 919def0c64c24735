"""Repair of conversations by the cheapest edits, found by iterative-deepening A*.

A sound conversation is one whose role initials read ``(s?(ua)+)?``. Its rows are taken by
turn (nulls first), then role, then MD5 of the text. Each row's first fault counts: blank,
duplicate of an earlier row, or truncated (the last character that is no white space ends no
sentence). Edits, by their initials: Delete (3), Insert an empty user or assistant row (2),
Keep (0), Rerole to user or assistant (2); blank and duplicate rows must go, a truncated row that
stays adds 1.

``cheapest_edits`` searches depth first in ASCII order of the edits under a cost bound. A state is how
many rows are used up and which role may follow. The transposition table holds for every state
what it still needs at least: at first the heuristic, and more after the state has failed. A failed bound
is followed by the least cost above it, so the first accepting path is the cheapest, and of the
cheapest the least in ASCII. The heuristic adds up what blocks of 2^k rows cost at
least whatever the roles around them are; each join of two blocks can hide a few points at most, so the
work grows with n log n, not with the square of a conversation.

Plan: texts are not needed to find the edits, so one shuffle moves marks and digests only, sorted by
conversation; a second brings the texts of each conversation in order to its edits, row by row.
Edits and hash of one conversation are sequential by nature: a task holds a few hundred
bytes for every row of the longest conversation, and never its texts.

Defined cases: a null role or text is one space, in the key of the damage also a null conv_id or
turn; null conv_id is one conversation. Repeated rows are duplicates of the first. A role is known by its first
letter, any other than s, u, a must change or go. Extra columns are not read. Empty tables give an
empty result; a conversation without rows has zeros, no edits and the hash of nothing.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import stored

BLANKS = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Marks of a row: its initial, 4 more if truncated; GONE must be deleted; END is after the last row.
INITIALS, GONE, END = "sua?", 8, 9


def _options(mark: int, state: int) -> tuple[tuple[str, int, int, int], ...]:
    """The edits possible in a state: initial, cost, rows used up, next state; in ASCII order."""
    insert = ("I", INSERT, 0, NEXT[state])
    if mark == END:
        return (insert,)
    delete = ("D", DELETE, 1, state)
    if mark == GONE:
        return (delete, insert)
    extra, initial = (TRUNCATED, INITIALS[mark - 4]) if mark >= 4 else (0, INITIALS[mark])
    kept = FOLLOWS.get((state, initial))
    keep = () if kept is None else (("K", extra, 1, kept),)
    return (delete, insert, *keep, ("R", REROLE + extra, 1, NEXT[state]))


OPTIONS = [[_options(mark, state) for state in range(4)] for mark in range(END + 1)]
_FAR = 1 << 20


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Costs from state to state of two runs of rows, one after the other."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), _FAR)


def _row_costs() -> np.ndarray:
    inserts = np.full((4, 4), _FAR, np.int32)
    for state in range(4):
        at, cost = state, 0
        for _ in range(3):
            inserts[state, at] = min(inserts[state, at], cost)
            at, cost = NEXT[at], cost + INSERT
    rows = np.full((END, 4, 4), _FAR, np.int32)
    for mark in range(END):
        for state in range(4):
            for _, cost, used, after in OPTIONS[mark][state]:
                if used:
                    rows[mark, state, after] = min(rows[mark, state, after], cost)
    return _then(inserts[None], rows)


_ROWS = _row_costs()


def at_least(marks: bytes) -> list[int]:
    """For every place, what the rows from there on cost at least, from blocks of 2^k rows."""
    n = len(marks)
    level = _ROWS[np.frombuffer(marks, np.uint8)]
    blocks = [level.min(axis=(1, 2))]
    while len(level) > 1:
        pairs = len(level) // 2
        parts = [_then(level[2 * i : 2 * (i + 4096) : 2][: pairs - i], level[2 * i + 1 : 2 * (i + 4096) : 2]) for i in range(0, pairs, 4096)]
        level = np.concatenate(parts)
        blocks.append(level.min(axis=(1, 2)))
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        k = (i & -i).bit_length() - 1 if i else len(blocks) - 1
        while i + (1 << k) > n:
            k -= 1
        rest[i] = int(blocks[k][i >> k]) + rest[i + (1 << k)]
    return rest


def cheapest_edits(marks: bytes) -> tuple[int, str]:
    """Cost and initials of the cheapest edits, the ASCII-least of them."""
    n = len(marks)
    marks += bytes([END])
    need = array("i")
    for least in at_least(marks[:-1])[:-1] if n else []:
        need.extend((least,) * 4)
    need.extend((0, 2 * INSERT, INSERT, 0))
    while True:
        bound = need[0]
        nodes, spent, tried, path = [0], [0], [0], []
        while nodes:
            node, cost, option = nodes[-1], spent[-1], tried[-1]
            place, state = node >> 2, node & 3
            if place == n and state in ACCEPTING:
                return cost, "".join(path)
            options = OPTIONS[marks[place]][state]
            while option < len(options):
                edit, price, used, after = options[option]
                option += 1
                child = (place + used) << 2 | after
                if cost + price + need[child] <= bound:
                    tried[-1] = option
                    nodes.append(child)
                    spent.append(cost + price)
                    tried.append(0)
                    path.append(edit)
                    break
            else:
                least = min(price + need[(place + used) << 2 | after] for _, price, used, after in options)
                need[node] = max(need[node], least)
                nodes.pop(), spent.pop(), tried.pop()
                if path:
                    path.pop()


# -- rows -----------------------------------------------------------------


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def as_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``there``, which is false for a row that only names its conversation."""
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), _spaced("role").alias("role"), _spaced("text").alias("text"), F.lit(True).alias("there")
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults that depend on crc32 of ``conv_id:turn`` modulo 20; dropped rows still name their conversation."""
    kind = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn"))) % 20
    rows = as_rows(conversations).withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), F.explode(copies)).drop("col")


def _digest(*parts: str) -> Column:
    """128 bits of some texts; the lengths keep them apart."""
    lengths = [F.concat(F.length(p).cast("string"), F.lit(":")) for p in parts]
    return F.unhex(F.md5(F.concat(*lengths, *parts)))


_ORDER = ["conv_id", "turn", "role", "text_md5"]  # nulls first, as Spark sorts


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as tuples, conv_id first."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


class _Report:
    """Faults and marks of one conversation, row by row in order."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.marks, self.seen = conv_id, bytearray(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = None

    def add(self, turn: int | None, initial: str, key: bytes, last: str) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        mark = INITIALS.index(initial) if initial in ("s", "u", "a") else 3
        if not last:
            self.blank, mark = self.blank + 1, GONE
        elif key in self.seen:
            self.duplicate, mark = self.duplicate + 1, GONE
        elif last not in ".!?":
            self.truncated, mark = self.truncated + 1, mark + 4
        self.seen.add(key)
        self.marks.append(mark)

    def row(self) -> tuple:
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest_edits(bytes(self.marks)))


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (the edits' initials)."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    marks = rows.select(
        "conv_id",
        "turn",
        "role",
        F.md5("text").alias("text_md5"),
        F.substring("role", 1, 1).alias("initial"),
        _digest("role", "text").alias("key"),
        F.substring(trimmed, -1, 1).alias("last"),
        "there",
    )
    conv_type = rows.schema["conv_id"].dataType
    schema = f"conv_id {conv_type.simpleString()}, " + ", ".join(f"{c} long" for c in REPORT) + ", audit string"
    names = ["conv_id", *REPORT, "audit"]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done, types = None, [], None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done))
            fixed = [types, *[pa.int64()] * len(REPORT), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fixed)], names)

        for batch in batches:
            types = batch.schema.field("conv_id").type
            for conv_id, turn, initial, key, last, there in _by_conversation([batch]):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        done.append(current.row())
                    current = _Report(conv_id)
                if there:
                    current.add(turn, initial, key, last)
            if done:
                yield flush()
                done = []
        if current is not None:
            done.append(current.row())
            yield flush()

    ordered = marks.repartition("conv_id").sortWithinPartitions(*_ORDER)
    return ordered.select("conv_id", "turn", "initial", "key", "last", "there").mapInArrow(report, schema)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the rows after the edits that ``audits`` found, each conversation in order within its partition."""
    nothing = F.lit(None)
    first = found.select(
        "conv_id", nothing.cast("long").alias("turn"), nothing.cast("string").alias("role"), nothing.cast("string").alias("text"), "audit"
    )
    both = rows.where("there").select("conv_id", "turn", "role", "text", nothing.cast("string").alias("audit")).unionAll(first)
    ordered = (
        both.withColumn("text_md5", F.md5("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("audit").asc_nulls_last(), *_ORDER[1:])
        .select("conv_id", "role", "text", "audit")
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place, conv_id = "", 0, START, 0, None
        for batch in batches:
            out: list[tuple] = []

            def put(role: str, text: str) -> None:
                nonlocal place
                out.append((conv_id, place, role, text))
                place += 1

            def inserts() -> None:
                nonlocal at, state
                while at < len(audit) and audit[at] == "I":
                    at, state = at + 1, NEXT[state]
                    put(ROLE[state], "")

            for conv, role, text, edits in _by_conversation([batch]):
                if edits is not None:
                    audit, at, state, place, conv_id = edits, 0, START, 0, conv
                    inserts()
                    continue
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = FOLLOWS[state, role[:1]]
                    put(role, text)
                elif edit == "R":
                    state = NEXT[state]
                    put(ROLE[state], text)
                inserts()
            columns = list(zip(*out)) if out else [()] * 4
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "place", "role", "text"])

    conv_type = rows.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(apply, f"conv_id {conv_type}, place long, role string, text string")


def fingerprints(rows: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, the hash of ``role:text`` joined by newlines, of what ``repaired`` returns, in its order."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, types = None, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current], types), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

        for batch in batches:
            types = batch.schema.field("conv_id").type
            for conv_id, place, role, text in _by_conversation([batch]):
                if place:
                    state.update(b"\n")
                else:
                    if state is not None:
                        yield row()
                    current, state = conv_id, hashlib.sha256()
                state.update(f"{role}:{text}".encode())
        if state is not None:
            yield row()

    conv_type = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(digest, f"conv_id {conv_type}, repaired_sha256 string")


def repair_reports(rows: DataFrame) -> DataFrame:
    """What ``audits`` returns, with repaired_sha256; ``rows`` as ``as_rows`` or ``damaged`` give them."""
    found = stored(audits(rows), "audits")
    prints = fingerprints(repaired(rows, found)).withColumnRenamed("conv_id", "conv")
    joined = found.join(prints, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    empty = F.lit(hashlib.sha256().hexdigest())
    return joined.select("conv_id", *REPORT, "audit", F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
