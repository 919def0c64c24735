"""Ranked lexical search by NRA (no random access): the best documents for each query text, exactly.

Every term of a query has a list of documents in falling order of impact, which is what the term adds
to a document's score. NRA reads the lists of a query in step, never looks a document up, and keeps an interval for
each document met: below, what its terms read so far add; above, that plus the last impact read
from every list that has not shown it yet. Reading goes on, at doubling depth, until no other document can
reach the k-th best lower bound and every document that still can has an interval of one point, so members, ties and
scores are final. Lists that no open interval needs are read no further.

Plan: documents are the unit of work, not terms, so no list of a common term is ever one task.

1. One scan turns every whole text into its length and the counts of the terms that queries hold; written as a table.
   Corpus statistics (N, L, document frequencies) are native aggregates of it.
2. Each task takes its rows of that table in shards of at most ``shard_postings`` postings, sorts the lists of a shard by
   impact and runs all queries by NRA, from one shard to the next with the k-th score found so far as the least worth reading for.
   It returns k rows a query at most.
3. A window with k rows a query, cut before its shuffle, puts the tasks' results together.

Queries are taken in blocks of about ``block_terms`` terms, dealt by hash; a block is what the driver and each task hold of
them (a query with more terms is a block of its own size). All counts cover all documents.

Score of a term: w * ((1000000000 * tf) div (1000 * tf + 12 * m)), with w and m as in ``weight`` and ``_lengths``.

Defined cases: a null or empty text has no terms, as a document it is found by no query, as a query it finds nothing. Every row
is a document, so copies under one id all rank; null ids rank after others at equal score. Every query row is
answered, repeated ones repeatedly. Very long texts are counted a megabyte at a time. Extra columns are not read. Empty tables give an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .rows import whole_text
from .store import discard, stored

#: Bytes of UTF-8: what belongs to a term stays, A-Z in lower case; all other ASCII separates terms.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PIECE = 1 << 20


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece of it at a time."""
    folded, low = data.translate(_FOLDED), 0
    while low < len(folded):
        high = folded.find(b" ", low + PIECE) if low + PIECE < len(folded) else -1
        high = len(folded) if high < 0 else high
        yield folded[low:high].split()
        low = high


def term_counts(data: bytes) -> Counter:
    counts: Counter = Counter()
    for terms in pieces(data):
        counts.update(terms)
    return counts


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _lengths(sizes: list[int], documents: int, terms: int) -> np.ndarray:
    """m of each document; Python's integers, since n * N can pass 64 bits."""
    return np.array([75 + 25 * n * documents // terms if terms else 75 for n in sizes], np.int64)


# -- NRA ------------------------------------------------------------------


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (0 to size - 1) and scores: all that reach both ``floor`` and the k-th best score.

    A list has documents and their impacts above 0, in falling order of impact.
    """
    lists = [x for x in lists if len(x[0])]
    ends = np.array([len(docs) for docs, _ in lists], np.int64)
    read = np.zeros(len(lists), np.int64)
    last = np.array([impacts[0] for _, impacts in lists], np.int64)
    lower, seen = np.zeros(size, np.int64), np.zeros((size, len(lists)), bool)
    wanted, depth, closed = read < ends, 64, None
    while True:
        for j in np.flatnonzero(wanted):
            docs, impacts = lists[j]
            low, high = read[j], min(read[j] + depth, ends[j])
            lower[docs[low:high]] += impacts[low:high]
            seen[docs[low:high], j] = True
            read[j], last[j] = high, impacts[high - 1] if high < ends[j] else 0
        unmet = int(last.sum())
        near = np.flatnonzero(lower) if closed is None else closed
        below = lower[near]
        enough = max(floor, 1, int(np.partition(below, -k)[-k]) if len(below) >= k else 1)
        able = below + unmet >= enough
        near, below = near[able], below[able]
        above = below + (~seen[near]) @ last
        able = above >= enough
        near, below, above = near[able], below[able], above[able]
        if unmet >= enough:  # a document not met yet may still belong
            wanted = read < ends
        else:
            closed = near
            opened = above > below
            if not opened.any():
                return near, below
            wanted = (read < ends) & (~seen[near[opened]]).any(axis=0)
        depth *= 2


class _Shard:
    """Impact-sorted lists of some documents."""

    def __init__(self, sizes: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray, queries: Queries) -> None:
        self.size = len(sizes)
        m = _lengths(sizes.tolist(), queries.documents, queries.terms)
        impact = queries.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[at]))
        order = np.lexsort((-impact, term))
        order = order[impact[order] > 0]
        self.docs, self.impacts = at[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(len(queries.weights) + 1))

    def lists(self, terms: np.ndarray, repeats: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in terms]
        return [(self.docs[s], self.impacts[s] * r) for s, r in zip(spans, repeats)]


@dataclass
class Queries:
    """One block of queries and the statistics their scores need."""

    keys: list[int]
    terms_of: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray
    documents: int
    terms: int


class _Best:
    """The k best rows of a query so far: score, is the id null, id."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, np.zeros((0, 3), np.int64)

    @property
    def floor(self) -> int:
        return int(self.rows[-1, 0]) if len(self.rows) == self.k else 0

    def add(self, scores: np.ndarray, absent: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([scores, absent, ids], axis=1)])
        self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]]


def _shards(batches: Iterator[pa.RecordBatch], shard_postings: int) -> Iterator[tuple[np.ndarray, ...]]:
    """absent, ids, sizes, at, term, tf of consecutive documents."""
    held, postings = [], 0
    for batch in batches:
        ids, terms, tfs = batch.column("doc_id"), batch.column("terms"), batch.column("tfs")
        sizes = np.diff(terms.offsets.to_numpy())
        part = (
            np.array(ids.is_null().to_numpy(zero_copy_only=False), np.int64),
            ids.fill_null(0).to_numpy(),
            batch.column("n").to_numpy(),
            np.repeat(np.arange(len(sizes)), sizes),
            terms.flatten().to_numpy().astype(np.int64),
            tfs.flatten().to_numpy(),
        )
        held.append(part)
        postings += len(part[3]) + len(sizes)
        if postings >= shard_postings:
            yield _joined(held)
            held, postings = [], 0
    if held:
        yield _joined(held)


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    first = np.cumsum([0, *(len(p[0]) for p in parts)])
    at = np.concatenate([p[3] + low for p, low in zip(parts, first)])
    absent, ids, sizes, _, term, tf = (np.concatenate(c) for c in zip(*parts))
    return absent, ids, sizes, at, term, tf


# -- Spark ----------------------------------------------------------------


def _count_terms(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (all terms of the text), terms and tfs (those of the vocabulary)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for data in batch.column("data"):
                n, counts = 0, Counter()
                for piece in pieces(data.as_py()):
                    n += len(piece)
                    counts.update([known[t] for t in piece if t in known])
                sizes.append(n)
                terms.append(list(counts))
                tfs.append(list(counts.values()))
            columns = [pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("data"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


def _query_terms(queries: DataFrame, text_col: str) -> DataFrame:
    """``key``, one for each row, ``item`` (the whole row) and its distinct terms with their numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [term_counts(data.as_py()) for data in batch.column("data")]
            columns = [
                pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), *columns], ["item_id", "terms", "repeats"])

    rows = queries.select(F.col("item_id"), whole_text(text_col).cast("binary").alias("data"))
    kind = rows.schema["item_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"item_id {kind}, terms array<binary>, repeats array<long>")
    return counted.where(F.size("terms") > 0).withColumn("key", F.monotonically_increasing_id())


def _block(rows: list, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Queries]:
    """The term counts of all documents for a block of queries, as a table, and the block with its statistics."""
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r.terms}))}
    counted = stored(_count_terms(docs, vocabulary, id_col, text_col), "term-counts")
    whole = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    # One row for each term of the block.
    held = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weights = np.array([weight(whole.documents, held.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    terms_of = [(np.array([vocabulary[bytes(t)] for t in r.terms]), np.array(r.repeats, np.int64)) for r in rows]
    return counted, Queries([r.key for r in rows], terms_of, weights, whole.documents, whole.terms)


def _run(counted: DataFrame, queries: Queries, k: int, shard_postings: int) -> DataFrame:
    """key, doc_id, score: the k best of each task."""
    shared = counted.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = [_Best(k) for _ in queries.keys]
        for absent, ids, sizes, at, term, tf in _shards(batches, shard_postings):
            shard = _Shard(sizes, at, term, tf, queries)
            for (terms, repeats), own in zip(queries.terms_of, best):
                found, scores = nra(shard.lists(terms, repeats), shard.size, k, own.floor)
                own.add(scores, absent[found], ids[found])
        rows = np.concatenate([own.rows for own in best])
        keys = np.repeat(np.array(queries.keys, np.int64), [len(own.rows) for own in best])
        ids = pa.array(rows[:, 2], pa.int64(), mask=rows[:, 1] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(keys), ids, pa.array(rows[:, 0])], ["key", "doc_id", "score"])

    return counted.where(F.size("terms") > 0).mapInArrow(run, "key long, doc_id long, score long")


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id_col: str = "item_id",
    block_terms: int = 500_000,
    shard_postings: int = 1_000_000,
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each row of ``queries`` the k documents of highest score above 0, equal scores by id."""
    items = stored(_query_terms(queries.select(F.col(query_id_col).alias("item_id"), text_col), text_col), "queries")
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_terms))
    parts = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).select("key", "terms", "repeats").collect()
        if rows:
            counted, block = _block(rows, docs, id_col, text_col)
            parts.append(stored(_run(counted, block, k, shard_postings), "best"))
            discard(counted)
    found = parts[0] if parts else docs.sparkSession.createDataFrame([], "key long, doc_id long, score long")
    for part in parts[1:]:
        found = found.unionAll(part)
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(items.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")
