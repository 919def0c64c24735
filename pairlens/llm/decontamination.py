"""Benchmark decontamination by SimHash windows with exact verification.

A benchmark item of L words is compared with the windows of L words of every
text. Fingerprints have 128 bits over weighted 5-word shingles; an index
over 16 blocks of 8 bits finds every fingerprint within ``radius`` bits, since
one block must then differ in at most radius // 16 bits. Each candidate is
verified by the weighted Jaccard similarity of the shingles, with weight
1 + ln(items / items that have the shingle) over the whole benchmark, as if one item had a shingle that
none has. A pair needs a common weight of ``threshold`` times the item's: so each item is listed under its rarest
shingles only, as many as leave less than that to the others, and a text's windows meet the items in whose lists its
shingles are. Of these windows those are fingerprinted whose shingles have that much weight in the item. Neither
step loses a pair of the threshold; a shingle that all items have leads to hardly any.

The benchmark is read in blocks of at most ``block_items`` items, each block an index of
bounded size that goes to all tasks; documents are scanned once per block,
without any shuffle. Every window of every whole text is covered. Items that have a shingle
are counted over the whole benchmark first, in one aggregate. A shingle of one item weighs as
much as one of none, so a window's weights need the shingles of two or more items only: that list goes
to all tasks beside the block, 16 bytes a shingle, and a pair's similarity does not depend on its block.

Defined cases: null or empty texts and items match nothing; items of fewer than
five words are one shingle; null doc_ids stay null; items with equal text and items
with null item_id match each for itself; repeated documents are reported each. Extra
columns pass through ``drop_contaminated`` whatever their names. An empty table
on either side matches nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .rows import whole_text
from .shingles import Words, mix, ngrams, shingle_list, slices, words

BITS, BLOCKS = 128, 16
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
MATCHES = "doc_id long, item_id long, similarity double, start_word long, n_words long, distance int"


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle, (n, 128)."""
    halves = np.stack([mix(shingles + np.uint64(1)), mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1)
    bits = np.unpackbits(np.ascontiguousarray(halves).view(np.uint8).reshape(len(shingles), 16), axis=1)
    return bits.astype(np.float64) * 2 - 1


class Weights:
    """Weights of shingles by the items of a whole benchmark that have them; ``shingles`` are those of two or more items."""

    def __init__(self, items: int, shingles: np.ndarray, counts: np.ndarray):
        order = np.argsort(shingles)
        self.rarest = 1 + math.log(max(1, items))
        self.shingles = shingles[order]
        self.weights = 1 + np.log(items / counts[order])

    def of(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.full(len(shingles), self.rarest)
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return np.where(self.shingles[at] == shingles, self.weights[at], self.rarest)

    def by_shingle(self, counts: Counter) -> dict[int, float]:
        return dict(zip(counts, self.of(np.array(list(counts), np.uint64)).tolist()))


def item_shingles(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """Shingles of each text, with repeats; of an item of fewer than n words one, of none nothing."""
    hashed = words(texts)
    return [shingle_list(hashed.of(i), n) for i in range(len(texts))]


class Index:
    """One block of items: [(item_id, text)]."""

    def __init__(self, items: list[tuple[int | None, str | None]], weights: Weights, radius: int, threshold: float, n: int = 5):
        self.weights, self.radius, self.threshold, self.n = weights, radius, threshold, n
        hashed = words(pa.array([t or "" for _, t in items], pa.large_string()))
        lists = [hashed.of(i) for i in range(len(items))]
        self.ids = [i for (i, _), w in zip(items, lists) if len(w)]
        lists = [w for w in lists if len(w)]
        self.lengths = np.array([len(w) for w in lists], int)
        shingled = [shingle_list(w, n) for w in lists]
        self.counts = [Counter(s.tolist()) for s in shingled]
        self.totals = [sum(w * counts[x] for x, w in weights.by_shingle(counts).items()) for counts in self.counts]
        prints = [self.fingerprints(s, len(s)) for s in shingled]
        self.prints = np.concatenate(prints) if prints else np.zeros((0, 16), np.uint8)
        # Shingles of items, by how many words they have and by the length of the item.
        self.known: dict[int, dict[int, np.ndarray]] = {}
        for length in sorted(set(self.lengths.tolist())):
            own = np.unique(np.concatenate([s for s, m in zip(shingled, self.lengths) if m == length]))
            self.known.setdefault(min(n, length), {})[length] = own
        self.all_known = {k: np.unique(np.concatenate([*by.values()])) for k, by in self.known.items()}
        self.filters = {k: self._filter(own) for k, own in self.all_known.items()}
        self.members = {m: np.flatnonzero(self.lengths == m) for m in set(self.lengths.tolist())}
        self.near = {m: self._near(self.prints[at]) for m, at in self.members.items()}
        weighed = [weights.by_shingle(counts) for counts in self.counts]
        self.item_weights = [tuple(np.array(x) for x in zip(*sorted(w.items()))) for w in weighed]
        self.lists = {m: self._lists(at.tolist(), weighed) for m, at in self.members.items()}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"weights": None}  # one broadcast for all blocks

    def _lists(self, items: list[int], weighed: list[dict[int, float]]) -> tuple[np.ndarray, np.ndarray]:
        """Shingles in order, and the item listed under each: a window without any of them has too little weight in the item."""
        keys, under = [], []
        for item in items:
            rest = self.totals[item]
            for shingle, weight in sorted(weighed[item].items(), key=lambda x: (-x[1], x[0])):
                if rest < self.needed(item):
                    break
                keys.append(shingle)
                under.append(item)
                rest -= weight * self.counts[item][shingle]
        keys, under = np.array(keys, np.uint64), np.array(under, np.int64)
        order = np.argsort(keys, kind="stable")
        return keys[order], under[order]

    def needed(self, item: int) -> float:
        """The least common weight of a pair of the threshold, less what rounding may take."""
        return self.threshold * self.totals[item] * (1 - 1e-9)

    def listed(self, shingles: np.ndarray, length: int) -> list[int]:
        """Items of a length in whose lists one of the shingles is."""
        keys, under = self.lists[length]
        own = np.unique(shingles)
        low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        return sorted({int(i) for a, b in zip(low[high > low], high[high > low]) for i in under[a:b]})

    def heavy_windows(self, item: int, shingles: np.ndarray, hits: np.ndarray, width: int, last: int) -> list[tuple[int, int]]:
        """Runs of starts of windows whose shingles have the needed weight in an item."""
        own, weights = self.item_weights[item]
        at = np.minimum(np.searchsorted(own, shingles[hits]), len(own) - 1)
        inside = own[at] == shingles[hits]
        mine, weights = hits[inside], weights[at[inside]]
        low, high = np.maximum(mine - width + 1, 0), np.minimum(mine, last)
        edges, of = np.unique(np.concatenate([low, high + 1]), return_inverse=True)
        weight = np.cumsum(np.bincount(of, np.concatenate([weights, -weights]), len(edges)))
        heavy = np.flatnonzero(weight[:-1] >= self.needed(item) * (1 - 1e-9))
        if not len(heavy):
            return []
        gap = np.flatnonzero(np.diff(heavy) > 1)
        first, after = heavy[np.append(0, gap + 1)], heavy[np.append(gap, len(heavy) - 1)] + 1
        return list(zip(edges[first].tolist(), (edges[after] - 1).tolist()))

    @staticmethod
    def _filter(own: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << 20, bool)
        table[(own & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return table

    def _near(self, prints: np.ndarray) -> np.ndarray:
        """(16, 256, items): may a fingerprint with this value in this block be within the radius."""
        distance = _POPCOUNT[np.arange(256, dtype=np.uint8)[None, :, None] ^ prints.T[:, None, :]]
        return distance <= self.radius // BLOCKS

    def fingerprints(self, shingles: np.ndarray, width: int) -> np.ndarray:
        """SimHash of each ``width`` consecutive shingles, as 16 bytes."""
        sums = np.zeros((len(shingles) + 1, BITS))
        weights = np.rint(self.weights.of(shingles) * 2**20)  # whole numbers: sums are exact, wherever a run begins
        np.cumsum(signs(shingles) * weights[:, None], axis=0, out=sums[1:])
        return np.packbits(sums[width:] - sums[:-width] > 0, axis=1)

    def similarity(self, shingles: np.ndarray, item: int) -> float:
        """Weighted Jaccard of a window's shingles and an item's."""
        window = Counter(shingles.tolist())
        weight = self.weights.by_shingle(window)
        common = sum(weight[x] * min(c, self.counts[item].get(x, 0)) for x, c in window.items() if x in self.counts[item])
        total = sum(weight[x] * c for x, c in window.items())
        return common / (total + self.totals[item] - common)

    def hits(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Positions in ``hashes`` (shingles of k words) of shingles that some item has."""
        maybe = np.flatnonzero(self.filters[k][(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        own = self.all_known[k]
        at = np.minimum(np.searchsorted(own, hashes[maybe]), len(own) - 1)
        return maybe[own[at] == hashes[maybe]]

    def matches(self, shingles: np.ndarray, hits: np.ndarray, k: int) -> Iterator[tuple[int, float, int, int]]:
        """(item, similarity, start, distance): the best window of each item that a text matches."""
        for length, own in self.known[k].items():
            mine = hits[own[np.minimum(np.searchsorted(own, shingles[hits]), len(own) - 1)] == shingles[hits]]
            width = min(length - k + 1, len(shingles))  # a shorter text is one window
            last = len(shingles) - width
            if not len(mine):
                continue
            position = {int(item): j for j, item in enumerate(self.members[length])}
            for item in self.listed(shingles[mine], length):
                best = None
                near = self.near[length][:, :, position[item]]
                for begin, end in self.heavy_windows(item, shingles, mine, width, last):
                    for start in range(begin, end + 1, 4096):  # bounded memory however long the run
                        stop = min(end, start + 4095)
                        part = shingles[start : stop + width]
                        prints = self.fingerprints(part, width)
                        maybe = np.flatnonzero(near[np.arange(BLOCKS), prints].any(axis=1))
                        distances = _POPCOUNT[prints[maybe] ^ self.prints[item]].sum(axis=1)
                        close = distances <= self.radius
                        for w, distance in zip(maybe[close].tolist(), distances[close].tolist()):
                            similarity = self.similarity(part[w : w + width], item)
                            if similarity >= self.threshold:
                                found = (-similarity, start + w, distance)
                                best = found if best is None else min(best, found)
                if best:
                    yield item, -best[0], best[1], best[2]

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, similarity, start, distance) of a batch of texts."""
        for first, part in slices(texts):
            for row, *found in self._scan(words(part)):
                yield (first + row, *found)

    def _scan(self, hashed: Words) -> Iterator[tuple[int, int, float, int, int]]:
        for k in self.known:
            grams = ngrams(hashed.hashes, k)  # also across texts; those are set aside below
            hits = self.hits(grams, k)
            rows = np.searchsorted(hashed.bounds, hits, "right") - 1
            inside = hits + k <= hashed.bounds[rows + 1]
            hits, rows = hits[inside], rows[inside]
            for row in np.unique(rows).tolist():
                low, high = hashed.bounds[row], hashed.bounds[row + 1]
                own = hits[np.searchsorted(rows, row) : np.searchsorted(rows, row, "right")] - low
                for found in self.matches(grams[low : high - k + 1], own, k):
                    yield (row, *found)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))


def benchmark_weights(benchmark: DataFrame) -> Weights:
    """Weights over all items that have a word; counted in Spark, shingles of two or more items come to the driver."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch.column(0)):
                found = [np.unique(s).view(np.int64) for s in item_shingles(part) if len(s)]
                for first in range(0, len(found), 100):
                    some = found[first : first + 100]
                    hashes = pa.array(np.concatenate(some), pa.int64())
                    every = pa.concat_arrays([hashes, pa.nulls(len(some), pa.int64())])  # a null for each item
                    yield pa.RecordBatch.from_arrays([every], ["shingle"])

    counts = _items(benchmark).select(whole_text("text").alias("text")).mapInArrow(shingles, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    shared = counts.where(F.col("shingle").isNull() | (F.col("n") > 1)).toArrow()
    hashes, n = shared.column("shingle").combine_chunks(), shared.column("n").to_numpy()
    of_items = hashes.is_null().to_numpy(zero_copy_only=False)
    keys = hashes.drop_null().to_numpy().astype(np.int64).view(np.uint64)
    return Weights(int(n[of_items].sum()), keys, n[~of_items])


def _blocks(benchmark: DataFrame, weights: Weights, block_items: int, radius: int, threshold: float) -> Iterator[Index]:
    held, n = [], 0
    for row in _items(benchmark).orderBy("item_id", "text").toLocalIterator():
        held.append(tuple(row))
        n += 1
        if len(held) == block_items:
            yield Index(held, weights, radius, threshold)
            held = []
    if held or n == 0:
        yield Index(held, weights, radius, threshold)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, radius: int = 42, block_items: int = 4000) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, similarity, start_word, n_words, distance (of the best window)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    found = None
    weights = benchmark_weights(benchmark)
    weighed = docs.sparkSession.sparkContext.broadcast(weights)
    for index in _blocks(benchmark, weights, block_items, radius, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            index.weights = weighed.value
            for batch in batches:
                hits = list(index.scan(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([h[0] for h in hits], pa.int64())),
                        pa.array([index.ids[h[1]] for h in hits], pa.int64()),
                        pa.array([h[2] for h in hits], pa.float64()),
                        pa.array([h[3] for h in hits], pa.int64()),
                        pa.array([int(index.lengths[h[1]]) for h in hits], pa.int64()),
                        pa.array([h[4] for h in hits], pa.int32()),
                    ],
                    [c.split()[0] for c in MATCHES.split(", ")],
                )

        part = rows.mapInArrow(scan, MATCHES)
        found = part if found is None else found.union(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, radius: int = 42, block_items: int = 4000) -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns."""
    weights = benchmark_weights(benchmark)
    weighed = docs.sparkSession.sparkContext.broadcast(weights)
    for index in _blocks(benchmark, weights, block_items, radius, threshold):
        clean = _clean(docs.sparkSession.sparkContext.broadcast(index), weighed)
        docs = docs.where(clean(whole_text("text")))
    return docs


def _clean(shared, weighed):
    """Whether a text matches no item of the index; a decision beside the row keeps the other columns in the JVM."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        index = shared.value
        index.weights = weighed.value
        hit = {h[0] for h in index.scan(pa.array(list(texts), pa.large_string()))}
        return pd.Series([i not in hit for i in range(len(texts))])

    return clean
