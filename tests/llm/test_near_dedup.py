"""Near-deduplication against all pairs of full sets."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pairlens.llm import graph, near_dedup, shingles
from pairlens.llm.graph import components


def shingle_set(text):
    words = [w.encode().lower() for w in (text or "").split()]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_force(rows):
    rows = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_shingle = {}
    for i, (_, s) in enumerate(rows):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    for i, (_, s) in enumerate(rows):
        near = {j for x in s for j in by_shingle[x] if j < i}
        for j in near:
            both = len(s & rows[j][1])
            if 100 * both >= 75 * (len(s) + len(rows[j][1]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, s) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((str(doc), len(s), str(least.get(find(i)) if s else doc), doc == (least.get(find(i)) if s else doc)) for i, (doc, s) in enumerate(rows))


def result(found):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in found.collect())


def family(rng, n, words=60, edits=4):
    """A text and edited copies of copies."""
    texts = [[f"v{rng.randrange(5000)}" for _ in range(words)]]
    for _ in range(n - 1):
        copy = list(rng.choice(texts))
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(5000)}"
        texts.append(copy)
    return [" ".join(t) for t in texts]


def test_registered_query_on_the_given_documents(spark, sf_dir):
    from pairlens.llm.queries import op4_minhash_near_dedup

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op4_minhash_near_dedup(spark, sf_dir)) == brute_force(rows)


def test_families_common_passages_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [t for n in (2, 3, 40, 90) for t in family(rng, n)]
    texts += [f"{passage} {' '.join(family(rng, 1, words=rng.randrange(3, 50)))}" for _ in range(60)]
    texts += [None, "", " \n", "a b", "A\tB", "one two three four", "É é a b c", "é é a b c"]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 100)) + [(None, "q r s t u v"), (None, "q r s t u v"), (100, texts[0]), (7, "long " * 50_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    want = brute_force(rows)
    assert result(near_dedup.near_copies(docs)) == want
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == ["doc_id", "text", "node"]
    stay = sorted(str(r.doc_id) for r in kept.collect())
    assert stay == sorted({(d, c) for d, n, c, k in want if k and n} and [d for d, n, c, k in {w for w in want if w[3]}])


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in components(frame).collect()}
    want = {i: i for e in edges for i in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == {n: label for n, label in want.items() if any(a != b and n in (a, b) for a, b in edges)}


def test_components_write_no_round_that_changes_nothing(spark, monkeypatch):
    """Before, edges that were stars took a round of two tables to be found so, and every call ended with one."""
    written, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda frame, name: written.append(name) or stored(frame, name))
    stars = [(9, 1), (1, 7), (5, 2), (2, 2), (5, 2)]
    for edges, tables, want in ((stars, 1, {1: 1, 2: 2, 5: 2, 7: 1, 9: 1}), ([(1, 2), (3, 2)], 3, {1: 1, 2: 1, 3: 1}), ([(4, 4)], 1, {})):
        written.clear()
        assert {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
        assert len(written) == tables


def _members(rng, n, posting):
    """Rows of two blocks of a list, many alike, with the lists that hold each in one order."""
    base = rng.integers(0, 16, (6, near_dedup.FINE))
    values = np.where(rng.random((n, near_dedup.FINE)) < 0.14, rng.integers(0, 16, (n, near_dedup.FINE)), base[rng.integers(0, 6, n)]).astype(np.uint64)
    bits = (values.reshape(n, -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)
    prefixes = [sorted({*rng.integers(1, 30, 3).tolist(), posting}) for _ in range(n)]
    sizes, labels, blocks = rng.integers(60, 100, n), rng.integers(0, n, n), rng.integers(0, 2, n)
    table = pa.table({"block": pa.array(blocks, pa.int32()), "size": sizes, "label": [b"%d" % k for k in labels], "sketch": [b.tobytes() for b in bits], "prefix": prefixes})
    return table, values, prefixes, sizes, labels, blocks


def test_pairs_of_blocks_against_every_pair(monkeypatch):
    rng, posting = np.random.default_rng(6), 20
    rows, values, prefixes, sizes, labels, blocks = _members(rng, 150, posting)

    def wanted(i, j):
        alike = (values[i] == values[j]).sum() >= near_dedup.FINE_MATCHES and 100 * min(sizes[i], sizes[j]) >= 75 * max(sizes[i], sizes[j])
        return labels[i] != labels[j] and alike and min({*prefixes[i]} & {*prefixes[j]}) == posting

    whole = [(i, j) for i in range(150) for j in range(i + 1, 150) if wanted(i, j)]
    apart = [(i, j) for i in range(150) for j in range(150) if blocks[i] < blocks[j] and wanted(i, j)]
    assert 100 < len(apart) < len(whole)
    assert near_dedup._may_be_linked(rows, posting, False, 0) == whole
    assert near_dedup._may_be_linked(rows, posting, True, 0) == apart


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_copies(docs).collect() == [] == near_dedup.drop_near_copies(docs).collect()


def _peak(run) -> int:
    """MB that ``run`` holds at most."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()


def test_work_arrays_are_small():
    """A worker keeps the room of its largest arrays while it waits: 80 to 100 MB before, in each of four workers of an executor."""
    rng = np.random.default_rng(4)
    sets = rng.integers(0, 1 << 63, 1 << 15, dtype=np.uint64)
    assert _peak(lambda: near_dedup.signature(sets)) < 6
    assert _peak(lambda: near_dedup.fine_sketch(sets)) < 6
    texts = pa.array([" ".join(map(str, range(at, at + 25_000))) for at in range(0, 2_000_000, 125_000)], pa.string())
    assert _peak(lambda: [None for _ in near_dedup.shingle_sets(texts)]) < 24


def test_work_arrays_change_nothing(monkeypatch):
    texts = pa.array([None, "", " ", "a", "Ein Wort" * 3, "x" * 5000, *(f"{'wort ' * n}{n} é" for n in range(0, 4000, 331))], pa.string())
    sets = np.sort(np.random.default_rng(5).integers(0, 1 << 63, 5000, dtype=np.uint64))
    found = [[s.tolist() for s in near_dedup.shingle_sets(texts)], near_dedup.signature(sets).tolist(), near_dedup.fine_sketch(sets).tolist()]
    for chunk, table in ((1 << 20, 1 << 22), (1 << 9, 1 << 11)):
        monkeypatch.setattr(shingles, "CHUNK", chunk)
        monkeypatch.setattr(near_dedup, "TABLE", table)
        again = [[s.tolist() for s in near_dedup.shingle_sets(texts)], near_dedup.signature(sets).tolist(), near_dedup.fine_sketch(sets).tolist()]
        assert again == found
