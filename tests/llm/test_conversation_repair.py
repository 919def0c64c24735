"""Conversation repair: the search against Dijkstra, the query against SQL, the defined cases by hand."""

import hashlib
import heapq
import random
import zlib

import pytest

import __spark_entry__ as contract
from compare import difference, duck
from pairlens.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(marks: bytes) -> tuple[int, str]:
    """Dijkstra over (cost, edits)."""
    ends, heap, done = list(marks) + [cr.END], [(0, "", 0, cr.START)], set()
    while True:
        cost, edits, place, state = heapq.heappop(heap)
        if place == len(marks) and state in cr.ACCEPTING:
            return cost, edits
        if (place, state) not in done:
            done.add((place, state))
            for edit, price, used, after in cr.OPTIONS[ends[place]][state]:
                heapq.heappush(heap, (cost + price, edits + edit, place + used, after))


def test_search_against_dijkstra():
    rng = random.Random(5)
    for _ in range(4000):
        marks = bytes(rng.randrange(cr.END) for _ in range(rng.randrange(14)))
        assert cr.cheapest_edits(marks) == cheapest(marks)
    long = bytes(rng.randrange(cr.END) for _ in range(600))
    assert cr.cheapest_edits(long) == cheapest(long)


def test_heuristic_never_exceeds_the_cost():
    rng = random.Random(6)
    for _ in range(500):
        marks = bytes(rng.randrange(cr.END) for _ in range(rng.randrange(1, 40)))
        assert cr.at_least(marks)[0] <= cheapest(marks)[0]


def test_long_conversation():
    marks = bytes([1, 2, 1, 1, 8, 2, 5, 6, 3] * 4000)
    cost, audit = cr.cheapest_edits(marks)
    assert len([e for e in audit if e != "I"]) == len(marks)
    assert cost == sum({"D": 3, "I": 2, "R": 2, "K": 0}[e] for e in audit) + sum(
        4 <= m < 8 and e != "D" for m, e in zip(marks, (e for e in audit if e != "I"))
    )


def test_query_against_sql(spark, sf_dir):
    with duck(sf_dir) as database:
        result = contract.queries()["op12_conversation_repair"](spark, sf_dir)
        assert difference(result, database, contract.oracle_sql()["op12_conversation_repair"]) is None


def by_hand(rows: list[tuple]) -> dict:
    """The contract in plain Python, for rows that are damaged already."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if ro is None else ro, " " if x is None else x) for c, t, ro, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults, marks = set(), [], []
        for _, role, text in own:
            body = text.rstrip(cr.BLANKS)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            mark = {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)
            marks.append(cr.GONE if fault in ("blank", "duplicate") else mark + 4 * (fault == "truncated"))
        cost, audit = cheapest(bytes(marks))
        left, state, lines = list(own), cr.START, []
        for edit in audit:
            _, role, text = left.pop(0) if edit != "I" else (None, "", "")
            if edit != "D":
                state = cr.FOLLOWS[state, role[0]] if edit == "K" else cr.NEXT[state]
                lines.append((role if edit == "K" else cr.ROLE[state]) + ":" + text)
        turns = [t for t, _, _ in own if t is not None]
        roles = [r[:1] for _, r, _ in own]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


CASES = [
    (1, 0, "system", "Rules."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes."), (1, 5, "user", "cut off"),
    (2, None, "user", "First."), (2, None, "assistant", "Second."), (2, 3, None, None), (2, 3, "tool", "output."),
    (3, 1, "user", "Same."), (3, 1, "user", "Same."), (3, 1, "assistant", "Same."), (3, 2, "", "no role."),
    (4, 0, "user", ""), (4, 1, "assistant", " \t\n"),
    (None, 0, "assistant", "Long. " * 50_000), (None, 9, "user", "a "),
    (5, 0, "User", "capital."), (5, -3, "s", "é!  \n"), (5, 7, "usher", "x!"), (5, 8, "an", "y?"),
]


def test_defined_cases(spark):
    rows = spark.createDataFrame([(*r, 1) for r in CASES], SCHEMA + ", cost int")
    found = {r.conv_id: tuple(r)[1:] for r in cr.repair_reports(cr.as_rows(rows)).collect()}
    assert found == by_hand(CASES)


def test_damage(spark):
    rng = random.Random(3)
    given = [
        (c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["One. Two!", "Three", "", None]) )
        for c in [*range(60), None] for t in [*range(rng.randrange(1, 9)), *([None] if c == 7 else [])]
    ]
    after, named = [], set()
    for conv, turn, role, text in given:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        named.add(conv)
        after += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    expected = by_hand(after)
    for conv in named - set(expected):
        expected[conv] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    frame = spark.createDataFrame(given, SCHEMA).repartition(5)
    assert {r.conv_id: tuple(r)[1:] for r in cr.repair_reports(cr.damaged(frame)).collect()} == expected


def test_repaired_rows(spark):
    rows = cr.as_rows(spark.createDataFrame([r for r in CASES if r[0] == 1], SCHEMA))
    (report,) = cr.audits(rows).collect()
    assert (report.gaps, report.truncated, report.cost, report.audit) == (2, 1, 3, "KKKD")
    out = cr.repaired(rows, cr.audits(rows)).orderBy("place").collect()
    assert [(r.role, r.text) for r in out] == [("system", "Rules."), ("user", "Hi?"), ("assistant", "Yes.")]


@pytest.mark.parametrize("make", [cr.as_rows, cr.damaged])
def test_empty_table(spark, make):
    assert cr.repair_reports(make(spark.createDataFrame([], SCHEMA))).collect() == []
