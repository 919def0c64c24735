"""Ranked search: NRA against full scoring, the query against SQL, the defined cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as contract
from compare import difference, duck
from pairlens.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def words(text: str | None) -> list[str]:
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(folded)


def by_hand(docs: list[tuple], items: list[tuple], k: int = 20) -> list[tuple]:
    texts = [(d, words(t)) for d, t in docs]
    n_docs, total = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    holding = Counter(t for _, w in texts for t in set(w))
    out = []
    for item_id, text in items:
        rows = []
        for doc_id, own in texts:
            tf, score = Counter(own), 0
            for t in words(text):
                if tf[t]:
                    m = 75 + (25 * len(own) * n_docs) // total
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1)))
                    score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0, doc_id))
        rows.sort(key=lambda r: r[:3])
        out += [(item_id, i + 1, r[3], -r[0]) for i, r in enumerate(rows[:k])]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def check(spark, docs, items, **options):
    got = ls.search(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string"), **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(by_hand(docs, items, options.get("k", 20)), key=key)


def test_nra_against_full_scores():
    rng = np.random.default_rng(2)
    for trial in range(300):
        size, terms, k = int(rng.integers(1, 400)), int(rng.integers(0, 7)), int(rng.integers(1, 25))
        whole, lists = np.zeros(size, np.int64), []
        for _ in range(terms):
            docs = rng.choice(size, int(rng.integers(0, size + 1)), replace=False)
            impacts = np.sort(rng.integers(1, int(rng.choice([3, 50, 10**9])), len(docs)))[::-1]
            whole[docs] += impacts
            lists.append((docs, impacts))
        floor = int(rng.choice([0, int(np.median(whole)), int(whole.max()), int(whole.max()) + 1]))
        found, scores = ls.nra(lists, size, k, floor)
        assert (whole[found] == scores).all()
        kth = np.sort(whole)[-k] if size >= k else 0
        wanted = np.flatnonzero((whole >= max(floor, kth, 1)))
        assert set(wanted) <= set(found.tolist())


def test_nra_stops_before_the_end():
    """A document far ahead in all lists needs no tail."""
    size = 100_000
    tail = np.arange(size, 0, -1)
    read = [0]

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                read[0] = max(read[0], at.stop)
            return super().__getitem__(at)

    impacts = np.concatenate([[10**9], tail[1:]]).view(Watched)
    found, scores = ls.nra([(np.arange(size), impacts), (np.arange(size), impacts.copy())], size, 1, 0)
    assert found.tolist() == [0] and scores.tolist() == [2 * 10**9] and read[0] < 1000


def test_query_against_sql(spark, sf_dir):
    with duck(sf_dir) as database:
        result = contract.queries()["op13_lexical_search"](spark, sf_dir)
        assert difference(result, database, contract.oracle_sql()["op13_lexical_search"]) is None


@pytest.mark.parametrize("options", [{}, {"shard_postings": 50, "block_terms": 20}, {"k": 3, "shard_postings": 200}])
def test_against_full_scoring(spark, options):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "straße", "ÀB", "日本"]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(150)]
    docs += [(i, docs[3][1]) for i in (200, 201, 202)] * 8 + [(300, docs[5][1].upper()), (None, docs[3][1])]
    items = [(i, text(rng.randrange(1, 12))) for i in range(12)] + [(12, "nowhere"), (0, docs[3][1])]
    check(spark, docs, items, **options)


def test_defined_cases(spark):
    docs = [(1, None), (2, ""), (3, "...!"), (None, "Some word"), (4, "some-word_x"), (4, "some-word_x"), (5, "a" * 3_000_000 + " some"), (6, "\x00some\x7fé")]
    items = [(1, None), (2, ""), (None, "SOME x"), (3, "é É some some"), (3, "é É some some")]
    check(spark, docs, items)


def test_extra_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, score long, key string")
    items = spark.createDataFrame([(1, "b", 2)], "item_id long, text string, terms int")
    assert [r.doc_id for r in ls.search(docs, items).collect()] == [1]
    assert ls.search(docs.limit(0), items).collect() == [] == ls.search(docs, items.limit(0)).collect()


def test_pieces_keep_terms_whole():
    data = b"ab " * 600_000 + b"c" * 2_500_000 + b" d"
    counts = ls.term_counts(data)
    assert counts == {b"ab": 600_000, b"c" * 2_500_000: 1, b"d": 1}
