"""Decontamination against all windows of all texts."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from pairlens.llm.decontamination import Index, Weights, drop_contaminated, item_shingles, matches


def shingles(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def lowered(text):
    return [w.encode().lower() for w in (text or "").split()]  # bytes.lower is A-Z only


def brute_force(docs, items, threshold=0.75):
    items = [(i, lowered(t)) for i, t in items if lowered(t)]
    parts = [Counter(shingles(w, min(5, len(w)))) for _, w in items]
    frequency = Counter(x for p in parts for x in p)
    weight = lambda x: 1 + math.log(len(items) / frequency[x]) if x in frequency else 1 + math.log(len(items))
    out = {}
    for doc, text in docs:
        words = lowered(text)
        for (item, w), part in zip(items, parts):
            n, length = min(5, len(w)), min(len(w), len(words))
            for start in range(len(words) - length + 1 if length >= n else 0):
                own = Counter(shingles(words[start : start + length], n))
                every = set(own) | set(part)
                both = sum(weight(x) * min(own[x], part[x]) for x in every) / sum(weight(x) * max(own[x], part[x]) for x in every)
                if both >= threshold and both > out.get((doc, item), (0,))[0] + 1e-12:
                    out[doc, item] = (both, start)
    return out


def as_rows(found):
    return {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in found.collect()}


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def edited(rng, words, rate):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < rate / 3 else [w, w] if x < 2 * rate / 3 else ["zz"] if x < rate else [w]
    return out


def test_edited_passages(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([2, 4, 5, 6, 15, 30, 60])))) for i in range(25)] + [(90, None), (91, "  ")]
    items += [(92, items[3][1])]
    docs = []
    for i in range(120):
        passage = edited(rng, rng.choice(items[:25])[1].split(), rng.choice([0, 0.02, 0.05, 0.1]))
        docs.append((i, " \n".join(say(rng.randrange(20)) + [w.upper() for w in passage] + say(rng.randrange(20)))))
    docs += [(200, None), (201, ""), (202, "one")]
    want = {k: (round(s, 9), at) for k, (s, at) in brute_force(docs, items).items()}
    assert len(want) > 60
    for options in ({}, {"block_items": 40}):
        assert as_rows(matches(*frames(spark, docs, items), **options)) == want
    dropped = {d for d, _ in want}
    kept = drop_contaminated(*frames(spark, docs, items))
    assert kept.columns == ["doc_id", "text", "item_id"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in dropped)


def test_benchmark_in_blocks_finds_exact_passages(spark):
    items = [(i, f"alpha{i} beta gamma delta eps zeta eta theta iota kappa") for i in range(9)]
    docs = [(i, f"x y {t} z") for i, t in items] + [(50, "clean words only")]
    found = matches(*frames(spark, docs, items), block_items=2)
    assert {(i, i) for i, _ in items} <= {(r.doc_id, r.item_id) for r in found.collect()}
    assert [r.doc_id for r in drop_contaminated(*frames(spark, docs, items), block_items=2).collect()] == [50]


def test_registered_query(spark, sf_dir):
    from pairlens.llm.queries import op7_decontamination

    read = lambda t, k: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k, "text").collect()]
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    known = {s for _, t in items for s in shingles(lowered(t), 5)}
    docs = [d for d in docs if known & set(shingles(lowered(d[1]), 5))]  # others share no shingle
    want = {k: (round(s, 9), at) for k, (s, at) in brute_force(docs, items).items()}
    assert as_rows(op7_decontamination(spark, sf_dir)) == want


def test_empty_tables(spark):
    docs, items = [(1, "a b c d e f")], [(1, "a b c d e f")]
    assert as_rows(matches(*frames(spark, [], items))) == {} == as_rows(matches(*frames(spark, docs, [])))
    assert drop_contaminated(*frames(spark, docs, [])).count() == 1


def test_blocks_give_what_one_block_gives(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(50)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    heads = [say(12) for _ in range(3)]  # items of several blocks have shingles in common
    items = [(i, " ".join(heads[i % 3] + say(rng.choice([3, 8, 20])))) for i in range(30)] + [(40, " ".join(say(3))), (41, None), (None, " ".join(heads[0]))]
    docs = []
    for i in range(150):
        passage = edited(rng, rng.choice(items[:30])[1].split(), rng.choice([0.03, 0.06, 0.1]))
        docs.append((i, " ".join(say(rng.randrange(15)) + passage + rng.choice(heads) + say(rng.randrange(15)))))
    want = {k: (round(s, 9), at) for k, (s, at) in brute_force(docs, items).items()}
    assert len(want) > 50
    whole = matches(*frames(spark, docs, items)).collect()
    assert as_rows(matches(*frames(spark, docs, items))) == want
    for block_items in (1, 7):
        got = matches(*frames(spark, docs, items), block_items=block_items).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, whole))
    kept = {r.doc_id for r in drop_contaminated(*frames(spark, docs, items), block_items=7).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_a_shingle_of_all_items_leads_to_none_of_them():
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    head = say(5)
    items = [(i, " ".join(head + say(40))) for i in range(200)]
    counts = Counter(x for _, t in items for x in set(item_shingles(pa.array([t]))[0].tolist()))
    shared = {x: n for x, n in counts.items() if n > 1}
    weights = Weights(len(items), np.array(list(shared), np.uint64), np.array(list(shared.values())))
    index = Index(items, weights, 42, 0.75)
    compared = []
    index.heavy_windows = lambda item, *rest: compared.append(item) or Index.heavy_windows(index, item, *rest)
    texts = [" ".join(say(60) + head + say(60)) for _ in range(20)] + [f"x {items[7][1]} y"]
    found = list(index.scan(pa.array(texts, pa.large_string())))
    assert [(row, index.ids[item]) for row, item, *_ in found] == [(20, 7)]
    assert set(compared) == {7}
