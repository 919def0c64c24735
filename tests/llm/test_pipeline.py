"""The pipeline's stages against their operators by brute force."""

from collections import Counter

import corpus_pipeline
from pairlens.llm.quality import quality
from pairlens.llm.store import stored
from test_decontamination import brute_force as contaminated
from test_near_dedup import brute_force as near
from test_packing import holds

BIG = "/root/testdata/sf0.01"


def test_each_stage_on_what_was_kept(spark):
    read = lambda t: spark.read.parquet(f"{BIG}/{t}.parquet")
    docs = columns = None
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = read("documents") if docs is None else docs
        columns = columns or docs.columns
        out = stored(stage(spark, docs, BIG), f"test-{name}")
        if name != "packing":
            assert out.columns == columns
        kept[name] = (docs, out)
        docs = out
    texts = lambda frame: {r.doc_id: r.text for r in frame.collect()}

    before, after = map(texts, kept["quality"])
    good = {r.doc_id for r in quality(kept["quality"][0], read("labels")).where("good").collect()}
    assert set(after) == good and 0.8 < len(after) / len(before) < 1

    before, after = map(texts, kept["exact_dedup"])
    norm = lambda t: " ".join(f"x{t}x".split())
    first = {}
    for doc in sorted(before):
        first.setdefault(norm(before[doc]), doc)
    assert set(after) == set(first.values())

    before, after = map(texts, kept["near_dedup"])
    assert set(after) == {int(d) for d, _, _, k in near(sorted(before.items())) if k}

    before, after = map(texts, kept["decontamination"])
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    words = {tuple(w[i : i + 5]) for _, t in items for w in [t.lower().split()] for i in range(len(w) - 4)}
    shared = {d: t for d, t in before.items() for w in [t.lower().split()] if words & {tuple(w[i : i + 5]) for i in range(len(w) - 4)}}
    assert set(before) - set(after) == {d for d, _ in contaminated(sorted(shared.items()), items)} != set()

    docs, packed = kept["packing"]
    known = {r.doc_id: (len(r.text.split()), r.source, norm(r.text)) for r in docs.collect()}
    rows = packed.collect()
    holds(rows, known, 2048)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, corpus_pipeline.run(spark, BIG).collect()))


def test_empty_and_null_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows, cols in (("documents", [(None, None, None, None, None)] * 2 + [(1, "", None, None, 0)], schema), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [], "item_id long, text string")):
        spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [r.n_words for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] in ([0], [0, 0])
