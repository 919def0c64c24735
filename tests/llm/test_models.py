"""Toxicity and quality: held-out accuracy, the statistics behind them, nulls and empty tables."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import quality, toxicity

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda t: spark.read.parquet(f"{BIG}/{t}.parquet")
    docs, labels = read("documents"), read("labels")
    # Copies of a text stay on one side.
    side = F.pmod(F.xxhash64("text"), F.lit(2))
    labels = labels.join(docs.select("doc_id", side.alias("side")), "doc_id")
    return docs, labels.where("side = 0").drop("side"), labels.where("side = 1").drop("side")


def test_toxicity_on_held_out_labels(tables):
    docs, known, held = tables
    held = held.select("doc_id", F.col("toxic").alias("truth"))
    scored = toxicity.score(docs, toxicity.train(docs, known)).join(held, "doc_id").toPandas()
    assert len(scored) > 1000
    truth = scored.truth > 0
    assert (scored.toxic == truth).mean() > 0.95
    assert scored.toxic[~truth].mean() < 0.01
    assert scored.severity[truth].mean() > 1 > 0.3 > scored.severity[~truth].mean()
    assert ((scored.severity >= 0) & (scored.severity <= 3)).all()


def test_quality_on_held_out_labels(tables):
    docs, known, held = tables
    rows = quality.quality(docs, known).join(held, "doc_id").toPandas()
    truth = rows.quality > 0
    assert (rows.good == truth).mean() > 0.97
    assert rows.good[truth].mean() > 0.99  # clean documents stay
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns
    assert kept.count() == quality.quality(docs, known).where("good").count()


def test_cumulative_link_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (3000, 2)).astype(float)
    latent = 1.5 * x[:, 0] - 1.0 * x[:, 1] + rng.logistic(size=3000)
    grades = np.digitize(latent, [0.0, 1.5, 3.0])
    at = [np.array([0, 1])] * 3000
    w, t = toxicity.fit_cumulative_link(at, list(x), grades, 2, l2=0.0)
    assert np.allclose(w, [1.5, -1.0], atol=0.2) and np.allclose(t, [0, 1.5, 3], atol=0.3)


def likelihood(w, t, at, values, grades) -> float:
    """Mean negative log-likelihood of the cumulative-link model, in plain loops."""
    total, edges = 0.0, [-math.inf, *t, math.inf]
    below = lambda edge, score: 0.0 if edge == -math.inf else 1.0 if edge == math.inf else 1 / (1 + math.exp(score - edge))
    for i, v, grade in zip(at, values, grades):
        score = sum(w[k] * x for k, x in zip(i, v))
        total -= math.log(below(edges[grade + 1], score) - below(edges[grade], score))
    return total / len(grades)


def test_fit_is_a_minimum_of_the_likelihood():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (300, 2)).astype(float)
    grades = np.digitize(x[:, 0] - 0.5 * x[:, 1] + rng.logistic(size=300), [0.0, 1.0, 2.0])
    at = [np.array([0, 1])] * 300
    w, t = toxicity.fit_cumulative_link(at, list(x), grades, 2, l2=0.0)
    assert list(t) == sorted(t)
    for place in range(5):
        step = np.zeros(5)
        step[place] = 1e-4
        up, down = (likelihood(w + s * step[:2], t + s * step[2:], at, x, grades) for s in (1, -1))
        assert abs(up - down) / 2e-4 < 2e-3


def test_severity_against_plain_loops(spark):
    """Expected grade, probability, grade and verdict of whole texts, long and odd ones included."""
    model = toxicity.Model({"bad": 2.0, "^badli": 1.0, "nice": -0.7, "évil": 0.4}, [1.0, 2.0, 3.0])
    texts = ["Bad badlings, bad!", "", None, "nice NICE day", "ÉVIL bad", "word " * 100_000 + "badlings", "b-a-d", "bad_bad"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string").repartition(3)
    found = toxicity.score(rows, model).collect()
    assert len(found) == 2 * len(texts)
    for r in found:
        words, score = set(re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower())), 0.0
        for word in words:
            score += model.weights.get(word, 0.0) + (model.weights.get("^" + word[:5], 0.0) if len(word) > 5 else 0.0)
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        mass = [1 - above[0], above[0] - above[1], above[1] - above[2], above[2]]
        assert abs(r.severity - sum(above)) < 1e-9 and abs(r.p_toxic - above[0]) < 1e-9
        assert (r.grade, r.toxic) == (mass.index(max(mass)), above[0] >= 0.5)


def test_rates_leave_the_document_out(spark):
    """Every rate against plain loops over all other documents."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None]), float(rng.normal(0.5, 2))) for i in range(80)]
    rows += [(80, "lone", "x", 3.0), (81, "sole", "x", -3.0)]
    rows = [(int(i), None if h is None else str(h), None if p is None else str(p), r) for i, h, p, r in rows]
    classifier = quality.Classifier.silent()
    frame = spark.createDataFrame(rows, "doc_id long, host string, path string, ratio double").repartition(3)
    sites, tree = quality._sites(frame, classifier)
    found = {r.doc_id: r for r in quality._with_rate(frame, sites, tree, classifier).collect()}
    own = {i: 1 / (1 + math.exp(-r - classifier.base)) for i, _, _, r in rows}
    for i, host, path, ratio in rows:
        others = [(h, p, own[j]) for j, h, p, _ in rows if j != i]
        mean = lambda kept, centre, k: (sum(kept) + k * centre) / (len(kept) + k)
        centre = (sum(g for _, _, g in others) + 0.5) / (len(others) + 1)
        of_host = mean([g for h, _, g in others if h == host], centre, tree.host_prior)
        rate = mean([g for h, p, g in others if (h, p) == (host, path)], of_host, tree.path_prior)
        assert abs(found[i].rate - rate) < 1e-9
        assert abs(found[i].posterior - 1 / (1 + math.exp(-ratio) * (1 - rate) / rate)) < 1e-9
    # Nothing but their own evidence sets these two apart, and that is not in their rates.
    assert abs(found[80].rate - found[81].rate) < 0.02


def test_sites_shrink_towards_their_host_and_the_whole(spark):
    rows = [("a", "x", 1.0)] * 400 + [("a", "y", 0.0)] * 2 + [("b", "x", 0.0)] * 300 + [("c", None, 1.0)]
    rates = {(r.host, r.path): r.rate for r in quality.site_rates(spark.createDataFrame(rows, "host string, path string, good double")).collect()}
    assert set(rates) == {("a", "x"), ("a", "y"), ("b", "x"), ("c", None)}
    whole = 401.5 / 704
    assert rates["a", "x"] > 0.95 and rates["b", "x"] < 0.05
    assert 0 < rates["a", "y"] < rates["a", "x"] and whole < rates["c", None] < 1


def test_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, 3), (None, "some words", "s", "en", 4), (2, "", "s", None, 5), (2, "", "s", None, 5)],
        "doc_id long, text string, source string, lang string, ratio int",
    )
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, labels).count() == 4
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert [r.severity for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()] == [0.0] * 4
    none = docs.limit(0)
    assert quality.quality(none, labels).collect() == [] == toxicity.score(none, toxicity.train(none, labels)).collect()
    both = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, both).count() == 4 == toxicity.score(docs, toxicity.train(docs, both)).count()
