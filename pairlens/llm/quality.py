"""Quality by hierarchical empirical Bayes: evidence of the text, shrunken rates of host and path.

A logistic classifier on features of the text's shape gives every document a
log-likelihood ratio. Sites are grouped twice: paths (source and language here)
inside hosts (source). A site's rate of good documents is the posterior mean of a
beta prior centred one level up: path -> host -> all documents. How strongly a
level shrinks is estimated from the data by the method of moments, so sparse sites
lean on their host and the host on everything. Site sums cover all documents,
each with the classifier's probability. What a document's own text says is taken out of the sums of its path, its
host and the whole before its rate is formed, so it counts once: the posterior adds its ratio
and the rate of the other documents of its site on the log-odds scale.

The classifier is fitted on at most ``sample_rows`` labelled documents, chosen by
the hash of their id. Site sums combine on the map side; the site table is joined
without hint, so that adaptive execution broadcasts it only when it is small
and splits a large site otherwise.

Defined cases: a null text counts as empty; null host or path is a site of its
own; labels with null id or null quality are not used, of repeated ones the lowest
counts; without labels of both kinds the classifier is silent (ratio 0). Extra columns pass
through ``keep_good`` whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .rows import whole_text
from .store import stored

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#$%&*@^~+=<>{}[]\\/_`",
    "bar": b"|",
    "loud": b"!?",
    "mark": b".,;:'\"()-",
    "space": b" \t",
    "line": b"\n\r",
}
_MEMBERS = np.zeros((256, len(_CLASSES)))
for _i, _chars in enumerate(_CLASSES.values()):
    _MEMBERS[list(_chars), _i] = 1
N_FEATURES = len(_CLASSES) + 7


def shape(text: str) -> np.ndarray:
    """Shares of character classes, word length, repetition of words and lines, size."""
    data = np.frombuffer(text.encode(), np.uint8)
    words, lines = text.split(), text.split("\n")
    n, nw = max(1, len(data)), max(1, len(words))
    shares = np.bincount(data, minlength=256) @ _MEMBERS / n
    distinct = len(set(words))
    again = sum(map(operator.eq, words, words[1:])) / nw
    return np.concatenate(
        [
            np.sqrt(shares),
            [
                np.log1p(len(words)),
                np.log1p(n / nw),
                distinct / nw,
                np.log1p(distinct) / np.log1p(nw),
                again,
                len(set(lines)) / len(lines),
                1 / nw,
            ],
        ]
    )


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the intercept
    base: float  # log-odds of good documents in the sample

    @classmethod
    def silent(cls) -> Classifier:
        return cls(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1), 0.0)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> Classifier:
        """Penalised logistic regression by Newton steps."""
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        penalty = np.diag([l2] * x.shape[1] + [1e-6])
        base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        w = np.zeros(z.shape[1])
        w[-1] = base
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
            w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w, base)

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of good against bad."""
        return (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1] - self.base


def _judged(labels: DataFrame) -> DataFrame:
    return (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.min(F.col("quality").cast("int")).alias("good"))
    )


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Classifier:
    judged = _judged(labels).orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), whole_text("text").alias("text"))

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([shape(t) for t in texts])

    # The sample is bounded by its parameter, so it may be broadcast and collected as numbers.
    rows = texts.join(F.broadcast(judged), "label_id").select("label_id", "good", measured("text").alias("x")).collect()
    rows.sort(key=lambda r: (r.label_id, r.x))
    y = np.array([float(r.good > 0) for r in rows])
    if not len(rows) or y.min() == y.max():
        return Classifier.silent()
    return Classifier.fit(np.array([r.x for r in rows]), y)


def _ratio(docs: DataFrame, classifier: Classifier, text: Column) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    @F.pandas_udf("double")
    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([shape(t) for t in texts]).reshape(len(texts), N_FEATURES)
            yield pd.Series(shared.value.ratio(x))

    return ratio(text)


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(total: DataFrame, centre: str) -> Column:
    """Prior size by the method of moments, of sites with good, n and the mean one level up; within 1 and 10,000."""
    mean, up = F.col("good") / F.col("n"), F.col(centre)
    between = F.sum(F.col("n") * (mean - up) ** 2) - F.sum(up * (1 - up))
    within = F.sum(F.col("n") * up * (1 - up))
    ratio = within / between - 1
    return F.coalesce(F.when(between > 0, F.least(F.greatest(ratio, F.lit(1.0)), F.lit(1e4))), F.lit(1e4))


@dataclass
class Tree:
    """Sums of evidence over all documents, and how many documents a prior counts for at each level."""

    good: float
    n: float
    host_prior: float
    path_prior: float

    def rate(self, host: tuple[Column, Column], path: tuple[Column, Column], own: Column | float = 0.0, left_out: int = 0) -> Column:
        """Share of good documents of a path, from (good, n) of its host and itself; without a document of evidence ``own`` if ``left_out`` is 1."""
        centre = (F.lit(self.good) - own + 0.5) / (self.n - left_out + 1)
        of_host = (F.greatest(host[0] - own, F.lit(0.0)) + self.host_prior * centre) / (host[1] - left_out + self.host_prior)
        return (F.greatest(path[0] - own, F.lit(0.0)) + self.path_prior * of_host) / (path[1] - left_out + self.path_prior)


def site_sums(evidence: DataFrame) -> tuple[DataFrame, Tree]:
    """host, path, good, n, host_good, host_n of every path, from (host, path, good) of every document; and the whole."""
    paths = evidence.groupBy("host", "path").agg(F.sum("good").alias("good"), F.count(F.lit(1)).cast("double").alias("n"))
    paths = stored(paths, "quality-sites")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    whole = hosts.agg(F.coalesce(F.sum("good"), F.lit(0.0)).alias("good"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).first()
    # Half a document of each kind keeps the rate off 0 and 1.
    centred = hosts.withColumn("centre", F.lit((whole.good + 0.5) / (whole.n + 1)))
    host_prior = centred.agg(_strength(centred, "centre").alias("k")).first().k
    sums = hosts.select(F.col("host").alias("h"), F.col("good").alias("host_good"), F.col("n").alias("host_n"))
    paths = paths.join(sums, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    tree = Tree(whole.good, whole.n, host_prior, 1.0)
    of_host = (F.col("host_good") + host_prior * F.lit((whole.good + 0.5) / (whole.n + 1))) / (F.col("host_n") + host_prior)
    below = paths.withColumn("centre", of_host)
    tree.path_prior = below.agg(_strength(below, "centre").alias("k")).first().k
    return paths, tree


def site_rates(evidence: DataFrame) -> DataFrame:
    """host, path, rate: posterior share of good documents of every path, from (host, path, good) of every document."""
    paths, tree = site_sums(evidence)
    rate = tree.rate(tuple(map(F.col, ("host_good", "host_n"))), tuple(map(F.col, ("good", "n"))))
    return paths.select("host", "path", rate.alias("rate"))


def _measured(docs: DataFrame, classifier: Classifier, host: Column, path: Column, *kept: Column) -> DataFrame:
    """``kept``, host, path and ratio of every document."""
    ratio = _ratio(docs, classifier, whole_text("text")).alias("ratio")
    return docs.select(*kept, host.cast("string").alias("host"), path.cast("string").alias("path"), ratio)


def _own(classifier: Classifier) -> Column:
    """What the text of a document says alone, as a share."""
    return _logistic(F.col("ratio") + F.lit(classifier.base))


def _sites(rows: DataFrame, classifier: Classifier) -> tuple[DataFrame, Tree]:
    return site_sums(rows.select("host", "path", _own(classifier).alias("good")))


def _with_rate(rows: DataFrame, sites: DataFrame, tree: Tree, classifier: Classifier) -> DataFrame:
    """Adds ``rate``, that of the site's other documents, and ``posterior``."""
    names = {"host": "site_host", "path": "site_path", "good": "site_good", "n": "site_n", "host_good": "up_good", "host_n": "up_n"}
    sites = sites.select(*[F.col(c).alias(n) for c, n in names.items()])
    joined = rows.join(sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")))
    rate = tree.rate((F.col("up_good"), F.col("up_n")), (F.col("site_good"), F.col("site_n")), _own(classifier), 1)
    joined = joined.withColumn("rate", F.least(F.greatest(rate, F.lit(1e-9)), F.lit(1 - 1e-9)))
    return joined.withColumn("posterior", _logistic(F.col("ratio") + _logit(F.col("rate"))))


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, cut: float = 0.5) -> DataFrame:
    """One row per document: doc_id, ratio, site_rate, posterior, good (posterior >= cut)."""
    classifier = train(docs, labels, sample_rows)
    ids = F.col("doc_id").cast("long").alias("doc_id")
    scored = stored(_measured(docs, classifier, F.col("source"), F.col("lang"), ids), "quality-ratios")
    rows = _with_rate(scored, *_sites(scored, classifier), classifier)
    return rows.select("doc_id", "ratio", F.col("rate").alias("site_rate"), "posterior", (F.col("posterior") >= cut).alias("good"))


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose posterior is at least ``cut``, with all their columns."""
    classifier = train(docs, labels, sample_rows)
    site = (F.col("source"), F.col("lang"))
    sites = _sites(_measured(docs, classifier, *site), classifier)
    rows = _measured(docs, classifier, *site, F.struct("*").alias("row"))
    return _with_rate(rows, *sites, classifier).where(F.col("posterior") >= cut).select("row.*")
