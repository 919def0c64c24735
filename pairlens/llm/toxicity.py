"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(t_k - w.x): one weight vector for all thresholds, the
thresholds in order. A feature is a word, or the first ``PREFIX`` letters of a
word; its value is the number of distinct words of the text that show it. The
output is the expected grade, and the probability of any toxicity.

The labels say toxic or not. Grades come from them: 0 is not toxic; toxic
documents get 1 to 3 by terciles of the number of distinct marker words in their text,
a marker being a selected feature that occurs mainly in toxic documents. The model is
fitted on at most ``sample_rows`` labelled documents, chosen by the hash of
their id; features are kept if they occur in ``min_docs`` of them and their
log-likelihood ratio exceeds ``min_g2``, at most ``max_features``. Scoring
reads every whole text, in one pass without shuffle.

Defined cases: a null or empty text has no features and gets the grade that no
evidence gives; labels with null id or null toxic are not used, of repeated
ones the more toxic counts; without labels of both kinds every severity is 0. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .rows import whole_text
from .store import discard, stored

LETTERS = re.compile(r"[^\W\d_]+")
PREFIX = 5
GRADES = 3


def features_of(word: str) -> tuple[str, ...]:
    return (word, f"^{word[:PREFIX]}") if len(word) > PREFIX else (word,)


def distinct_words(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [math.inf] * GRADES)

    def score(self, text: str, memo: dict[str, float]) -> float:
        total, weights = 0.0, self.weights
        for word in distinct_words(text):
            known = memo.get(word)
            if known is None:
                if len(memo) > 500_000:
                    memo.clear()
                known = memo[word] = sum(weights.get(f, 0.0) for f in features_of(word))
            total += known
        return total

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..GRADES, one row per score."""
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(np.asarray(self.thresholds)[None, :] - score[:, None]))


def fit_cumulative_link(
    indices: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, n_features: int, l2: float = 1e-4, steps: int = 500
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that minimise the mean negative log-likelihood, by Adam over the whole sample."""
    rows = np.repeat(np.arange(len(indices)), [len(i) for i in indices])
    cols = np.concatenate([*indices, np.zeros(0, int)]).astype(int)
    vals = np.concatenate([*values, np.zeros(0)])
    n, top = len(grades), GRADES
    shares = np.cumsum(np.bincount(grades, minlength=top + 1)[:-1] + 1) / (n + top + 1)
    start = np.log(shares / (1 - shares))
    p = np.concatenate([np.zeros(n_features), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        w, t = p[:n_features], np.cumsum(np.concatenate([[p[n_features]], np.exp(p[n_features + 1 :])]))
        s = np.bincount(rows, vals * w[cols], minlength=n)
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        high, low = sigmoid(edges[grades + 1] - s), sigmoid(edges[grades] - s)
        high[grades == top], low[grades == 0] = 1.0, 0.0
        mass = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / mass, low * (1 - low) / mass
        gw = np.bincount(cols, vals * (d_high - d_low)[rows], minlength=n_features) / n + l2 * w
        gt = np.zeros(top)
        for k in range(top):
            gt[k] = (d_low[grades == k + 1].sum() - d_high[grades == k].sum()) / n
        later = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([gw, [later[0]], later[1:] * np.exp(p[n_features + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:n_features], np.cumsum(np.concatenate([[p[n_features]], np.exp(p[n_features + 1 :])]))


def _g2(a: float, n1: int, b: float, n0: int) -> float:
    """Log-likelihood ratio of a of n1 against b of n0."""
    part = lambda k, n, q: (k * math.log(k / (n * q)) if k else 0) + ((n - k) * math.log((n - k) / (n * (1 - q))) if n > k else 0)
    q = (a + b) / (n1 + n0)
    return 0.0 if q in (0, 1) else 2 * (part(a, n1, q) + part(b, n0, q))


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 20_000,
    min_docs: int = 5,
    min_g2: float = 20.0,
    max_features: int = 50_000,
) -> Model:
    judged = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    # The sample is bounded by its parameter, so it may be broadcast.
    sample = stored(texts.join(F.broadcast(judged), "doc_id").select("doc_id", "toxic", "text"), "toxicity-sample")
    n1 = sample.where("toxic > 0").count()
    n0 = sample.count() - n1
    if not n1 or not n0:
        return Model()

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            hits, counts = Counter(), Counter()
            for text, toxic in zip(frame.text, frame.toxic):
                found = {f for word in distinct_words(text) for f in features_of(word)}
                counts.update(found)
                if toxic > 0:
                    hits.update(found)
            if counts:
                yield pd.DataFrame({"feature": list(counts), "hit": [hits[f] for f in counts], "df": list(counts.values())})

    counted = (
        sample.mapInPandas(emit, "feature string, hit long, df long")
        .groupBy("feature")
        .agg(F.sum("hit").alias("a"), F.sum("df").alias("df"))
        .where(F.col("df") >= min_docs)
    )
    # What the driver takes is bounded: the features that stand out most.
    lift = F.abs(F.col("a") / F.lit(n1) - (F.col("df") - F.col("a")) / F.lit(n0))
    ranked = counted.orderBy(lift.desc(), "feature").limit(max_features).collect()
    kept = [r for r in ranked if _g2(r.a, n1, r.df - r.a, n0) >= min_g2]
    index = {r.feature: i for i, r in enumerate(sorted(kept, key=lambda r: r.feature))}
    markers = {r.feature for r in kept if r.a / n1 > (r.df - r.a) / n0}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for doc_id, text, toxic in zip(frame.doc_id, frame.text, frame.toxic):
                found: dict[int, int] = {}
                marked, present = 0, distinct_words(text)
                for word in present:
                    own = features_of(word)
                    marked += any(f in markers for f in own)
                    for f in own:
                        if f in index:
                            found[index[f]] = found.get(index[f], 0) + 1
                out.append((doc_id, int(toxic > 0), float(marked), list(found), [float(x) for x in found.values()]))
            yield pd.DataFrame(out, columns=["doc_id", "toxic", "marked", "at", "value"])

    rows = sample.mapInPandas(encode, "doc_id long, toxic int, marked double, at array<int>, value array<double>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.marked))
    marked = np.array([r.marked for r in rows if r.toxic])
    cuts = np.quantile(marked, [1 / 3, 2 / 3])
    grades = np.array([0 if not r.toxic else 1 + int(np.searchsorted(cuts, r.marked)) for r in rows])
    weights, thresholds = fit_cumulative_link(
        [np.array(r.at, int) for r in rows], [np.array(r.value, float) for r in rows], grades, len(index)
    )
    discard(sample)
    return Model({f: float(weights[i]) for f, i in index.items()}, [float(t) for t in thresholds])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """One row per document: doc_id, severity (expected grade, 0 to 3), p_toxic, grade (most likely), toxic (p_toxic >= cut)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, p_toxic double, grade int, toxic boolean")
    def grade(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, memo = shared.value, {}
        for texts in batches:
            above = model.at_least(np.array([model.score(text, memo) for text in texts], float))
            mass = -np.diff(np.hstack([np.ones((len(texts), 1)), above, np.zeros((len(texts), 1))]), axis=1)
            yield pd.DataFrame(
                {"severity": above.sum(axis=1), "p_toxic": above[:, 0], "grade": mass.argmax(axis=1), "toxic": above[:, 0] >= cut}
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), grade(whole_text(text_col)).alias("grade"))
    return rows.select("doc_id", "grade.*")
