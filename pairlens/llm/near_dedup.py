"""MinHash near-deduplication by an inverted join over signature coordinates.

Texts with the same set of shingles are one node. A node's signature has
``COORDINATES`` minima; a posting is a pair of coordinate and value. Two sets of
similarity 0.75 agree in 48 of 64 coordinates on average; ``MATCHES`` = 32 is
required, which such a pair misses with a probability of 5e-6.

Prefix: with the postings of a node ordered by how many nodes share them, rarest
first, two nodes that agree in 32 of 64 share one of their first 33. Only
those are joined, so frequent lines and passages stay out of the lists, and
nodes whose first 33 postings are theirs alone are done.

Skip: links only matter between different components. In every list all nodes
are first compared with one of them, and the components of the confirmed links
are found; nodes of one component are then skipped, and in later steps only
nodes of different components are compared: with a hub that each list draws
for itself, so that a node meets as many hubs as it has lists, then all that
are left, long lists in blocks, each pair in the first list that holds both, and
only if 726 of 1024 further coordinates agree, kept as four bits each. A linked pair
in two components is missed with a probability of 1e-5 at similarity 0.75 and less
above it, and large groups of copies do not meet pair by pair.

Pairs with a hub are counted over the whole signature, and those with 32 agreements
are confirmed on the full sets of 64-bit shingle hashes by 100 * common >= 75 * union. In the last step
the sets of the nodes that a pair of blocks leaves come to one task, once each however many pairs they are in, and pairs
of components that links of this task have already united are not compared again. Blocks are dealt by
nodes and by shingles, so their sets have a size bound. Nodes, signatures, sets and links are written tables.

Defined cases: a text without words, null included, has no shingles, is linked
with nothing and its own component; fewer than five words are one shingle; null ids are
larger than others, and a component of null ids has a null id; rows that
repeat an id count as one document if their sets are linked or equal. Extra columns pass
through ``drop_near_copies`` whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .graph import components
from .rows import key_parts, whole_text
from .shingles import mix, shingle_list, slices, words
from .store import discard, stored

COORDINATES, MATCHES = 64, 32
PREFIX = COORDINATES - MATCHES + 1
#: Nodes of a block, and shingles for each of them on average.
BLOCK, BLOCK_SHINGLES = 2000, 1000
#: Further coordinates, for sketches of four bits each, and how many must agree: a pair of
#: similarity 0.75 has 784 on average and fewer than 726 with a probability of 1e-5.
FINE, FINE_MATCHES = 1024, 726
#: Products of shingles and factors that are held at once, 1 MB: a worker keeps the room of its largest arrays, also while it waits.
TABLE = 1 << 17
_FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_FINE_FACTORS = mix(np.arange(1001, 1001 + FINE, dtype=np.uint64)) | np.uint64(1)
_SIGNED = "absent boolean, value long, text_key long, n_shingles long, node binary, signature array<long>"


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for _, part in slices(texts):
        hashed = words(part)
        for i in range(len(part)):
            yield np.unique(shingle_list(hashed.of(i)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """One posting per coordinate: a hash of the coordinate and its minimum. ``shingles`` is not empty."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(shingles), step := TABLE // COORDINATES):
        np.minimum(least, (shingles[low : low + step, None] * _FACTORS).min(axis=0), out=least)
    return mix(least + np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fine_sketch(shingles: np.ndarray) -> np.ndarray:
    """Four bits of each of ``FINE`` further minima, 16 in a long."""
    least = np.full(FINE, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(shingles), step := TABLE // FINE):
        np.minimum(least, (shingles[low : low + step, None] * _FINE_FACTORS).min(axis=0), out=least)
    bits = (mix(least) & np.uint64(15)).reshape(-1, 16)
    return (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    absent, value = key_parts(id_col)
    text = whole_text(text_col)
    return docs.select(absent.alias("absent"), value.alias("value"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _node(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, nodes, signatures = [], [], []
        for shingles in shingle_sets(batch.column("text")):
            sizes.append(len(shingles))
            nodes.append(_node(shingles) if len(shingles) else None)
            signatures.append(signature(shingles).view(np.int64) if len(shingles) else None)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("absent", "value", "text_key")),
                pa.array(sizes, pa.int64()),
                pa.array(nodes, pa.binary()),
                pa.array(signatures, pa.list_(pa.int64())),
            ],
            ["absent", "value", "text_key", "n_shingles", "node", "signature"],
        )


def _collect_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, part in slices(batch.column("text")):
            sets = list(shingle_sets(part))
            nodes = batch.column("node").slice(low, len(part)).to_pylist()
            own = [(n, s.tobytes()) for n, s in zip(nodes, sets) if _node(s) == n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in own], pa.binary()), pa.array([s for _, s in own], pa.binary())], ["node", "shingles"]
            )


def _similar(left: np.ndarray, right: np.ndarray) -> bool:
    """Do two sorted sets share three quarters of their union?"""
    at = np.minimum(np.searchsorted(right, left), len(right) - 1)
    common = int((right[at] == left).sum())
    return 100 * common >= 75 * (len(left) + len(right) - common)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            linked.append(_similar(*(np.frombuffer(side.as_buffer(), np.uint64) for side in (x, y))))
        mask = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def _similar_size() -> Column:
    return 100 * F.least("size_a", "size_b") >= 75 * F.greatest("size_a", "size_b")


def _prefix_lists(nodes: DataFrame) -> DataFrame:
    """(posting, node, size) of the first ``PREFIX`` postings of each node, those shared with another node only."""
    postings = nodes.select("node", "n_shingles", F.explode("signature").alias("posting"))
    shared = postings.groupBy("posting").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    ranked = (
        postings.join(shared, "posting")
        .groupBy("node", "n_shingles")
        .agg(F.sort_array(F.collect_list(F.struct("held", "posting"))).alias("own"))  # at most COORDINATES
    )
    room = F.lit(PREFIX - COORDINATES) + F.size("own")  # postings that no other node has come first
    first = ranked.where(room > 0).select("node", "n_shingles", F.explode(F.slice("own", F.lit(1), room)).alias("p"))
    first = stored(first.select("p.posting", "node", F.col("n_shingles").alias("size")), "postings")
    several = first.groupBy("posting").agg(F.count(F.lit(1)).alias("held"), F.sum("size").alias("weight")).where("held > 1")
    lists = stored(first.join(several, "posting"), "lists")
    discard(first)
    return lists


def _confirmed(pairs: DataFrame, signatures: DataFrame, sets: DataFrame, tested: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The pairs, and the components (a, b) of those that are links: enough agreements, then the full sets."""
    pairs = pairs.distinct()
    if tested is not None:
        pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    pairs = stored(pairs, "pairs")
    left = signatures.select(F.col("node").alias("a"), F.col("signature").alias("x"))
    right = signatures.select(F.col("node").alias("b"), F.col("signature").alias("y"))
    likely = pairs.join(left, "a").join(right, "b").where(F.size(F.array_intersect("x", "y")) >= MATCHES).drop("x", "y")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = likely.join(left, "a").join(right, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"), "x", "y")
    return pairs, stored(both.mapInArrow(_confirm, "a binary, b binary"), "links")


def _hub_pairs(lists: DataFrame, order: Column) -> DataFrame:
    """Each node of a list with the list's first node in ``order``, in different components: the nodes a and b, and their labels."""
    hubs = lists.groupBy("posting").agg(F.min(F.struct(order.alias("rank"), "node", "size", "label")).alias("hub"))
    met = lists.join(hubs, "posting").withColumns({"size_a": F.col("hub.size"), "size_b": F.col("size")})
    met = met.where(F.col("hub.label") != F.col("label")).where(_similar_size())
    hub_first = F.col("hub.node") < F.col("node")
    labels = F.when(hub_first, F.col("hub.label")).otherwise(F.col("label")), F.when(hub_first, F.col("label")).otherwise(F.col("hub.label"))
    return met.select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b"), labels[0].alias("label_a"), labels[1].alias("label_b"))


def _open_lists(lists: DataFrame) -> DataFrame:
    """The lists that hold nodes of more than one component."""
    several = lists.groupBy("posting").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return lists.join(several.select("posting"), "posting", "left_semi")


def _block_links(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Components (a, b) that a link joins, in one list; long lists are dealt into blocks.

    A task holds two blocks at a time: first their sketches, which leave the nodes that
    may have links and with which others, then the sets of these nodes.
    """
    blocks = F.ceil(F.greatest(F.col("held"), F.col("weight") / BLOCK_SHINGLES) / BLOCK).cast("int")
    dealt = _with_sketches(lists, sets).withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("node", "posting"), blocks).cast("int")})
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "posting", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), *[c for c in _MEMBER if c != "posting"]
    )
    likely = stored(_by_blocks(met).mapInArrow(_compare_blocks, _LIKELY), "likely")
    links = stored(_by_blocks(likely.join(sets, "node")).mapInArrow(_link_blocks, "a binary, b binary"), "links")
    discard(likely)
    return links


def _by_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_BLOCKS).sortWithinPartitions(*_BLOCKS)


_BLOCKS = ("posting", "low", "high")
_LIKELY = "posting long, low int, high int, node binary, label binary, others array<binary>"
_MEMBER = ("posting", "block", "node", "size", "label", "sketch", "prefix")
_ONES = np.uint64(0x1111111111111111)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """The rows of each pair of blocks, which come together."""
    held, key = [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in _BLOCKS], axis=1)
        ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else []
        start = 0
        for end in ends:
            if key != (now := tuple(keys[start].tolist())):
                if held:
                    yield key, pa.Table.from_batches(held).combine_chunks()
                held, key = [], now
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each pair of blocks that may have links, each with those of its partners that it names."""
    for key, rows in _runs(batches):
        partners: dict[int, list[int]] = {}
        for m, n in _may_be_linked(rows, key[0], key[1] != key[2], key[1]):
            partners.setdefault(m, []).append(n)
            partners.setdefault(n, [])
        if partners:
            at = pa.array(list(partners), pa.int64())
            nodes = rows["node"].combine_chunks()
            sizes = np.cumsum([0, *map(len, partners.values())])
            others = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), nodes.take(pa.array([n for of in partners.values() for n in of], pa.int64())))
            whose = [pa.array(np.full(len(at), k), t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*whose, nodes.take(at), rows["label"].combine_chunks().take(at), others], [c.split()[0] for c in _LIKELY.split(", ")])


def _link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components that links of each pair of blocks join, of as many links as unite them."""
    for _, rows in _runs(batches):
        nodes, labels = rows["node"].to_pylist(), rows["label"].to_pylist()
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows["shingles"].combine_chunks()]
        place, parent, links = {node: i for i, node in enumerate(nodes)}, {label: label for label in labels}, []

        def root(label: bytes) -> bytes:
            while parent[label] != label:
                parent[label] = label = parent[parent[label]]
            return label

        for i, others in enumerate(rows["others"]):
            for j in (place[n] for n in others.as_py()):
                x, y = root(labels[i]), root(labels[j])
                if x != y and _similar(sets[i], sets[j]):
                    parent[x] = y
                    links.append((labels[i], labels[j]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([pair[k] for pair in links], pa.binary()) for k in (0, 1)], ["a", "b"])


def _planes(sketches: np.ndarray) -> np.ndarray:
    """The four-bit values of sketches by their bits: [k, p, row] holds bit p of 64 values."""
    words = sketches.reshape(len(sketches), -1, 4)
    out = np.zeros((words.shape[1], 4, len(sketches)), np.uint64)
    for bit in range(4):
        for part in range(4):
            out[:, bit] |= (((words[:, :, part] >> np.uint64(bit)) & _ONES) << np.uint64(part)).T
    return out


def _may_be_linked(rows: pa.Table, posting: int, apart: bool, low: int) -> list[tuple[int, int]]:
    """Pairs of rows of two blocks (or of one) in different components, of similar size, with ``FINE_MATCHES`` equal four-bit
    values, in the first list that holds both."""
    labels = rows["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    if len(labels) < 2 or labels.max() == 0:
        return []
    sizes, blocks = rows["size"].to_numpy(), rows["block"].to_numpy()
    planes = _planes(np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(len(labels), -1))
    left, right = (np.flatnonzero(blocks == low), np.flatnonzero(blocks != low)) if apart else (np.arange(len(labels)),) * 2
    out, earlier, prefixes = [], {}, rows["prefix"].combine_chunks()
    step = max(1, (1 << 16) // max(1, len(right)))
    for at in range(0, len(left), step):
        x = left[at : at + step]
        new = (labels[x][:, None] != labels[right]) & (100 * np.minimum(sizes[x][:, None], sizes[right]) >= 75 * np.maximum(sizes[x][:, None], sizes[right]))
        if not apart:
            new &= x[:, None] < right
        i, j = np.nonzero(new)
        i, j = x[i], right[j]
        differing = np.zeros(len(i), np.uint16)
        for read, four in enumerate(planes, 1):  # 64 coordinates at a time
            unlike = four[0].take(i) ^ four[0].take(j)
            for plane in four[1:]:
                unlike |= plane.take(i) ^ plane.take(j)
            differing += np.bitwise_count(unlike)
            if 64 * read > FINE - FINE_MATCHES:  # those beyond the bound go early
                stay = np.flatnonzero(differing <= FINE - FINE_MATCHES)
                if len(stay) < len(i):
                    i, j, differing = i[stay], j[stay], differing[stay]
        # The lists of a node come in one order for all nodes. Each row's are taken once, not for each pair.
        met = [k for k in np.union1d(i, j).tolist() if k not in earlier]
        earlier.update((k, frozenset(takewhile(posting.__ne__, own))) for k, own in zip(met, prefixes.take(pa.array(met, pa.int64())).to_pylist()))
        out += [(m, n) for m, n in zip(i.tolist(), j.tolist()) if earlier[m].isdisjoint(earlier[n])]
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketches = [fine_sketch(np.frombuffer(s.as_buffer(), np.uint64)).tobytes() for s in batch.column("shingles")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sketches, pa.binary())], ["node", "sketch"])


def _with_sketches(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """``lists`` with the sketch of each node and all its postings in lists, rarest first."""
    prefixes = lists.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "posting"))).alias("own"))  # at most PREFIX
    prefixes = prefixes.select("node", F.col("own.posting").alias("prefix"))
    needed = stored(sets.join(prefixes, "node").select("node", "prefix", "shingles"), "sketched")
    sketches = needed.select("node", "shingles").mapInArrow(_sketched, "node binary, sketch binary")
    return lists.join(sketches, "node").join(needed.select("node", "prefix"), "node")


def _relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """``rows`` with the label that theirs has in ``merged``, the components (node, label) of labels."""
    found = merged.select(F.col("node").alias("label"), F.col("label").alias("now"))
    return rows.join(found, "label", "left").withColumn("label", F.coalesce("now", "label")).drop("now")


def _links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, label) of all nodes that share a posting with another; each step links the components of the one before."""
    lists = _prefix_lists(nodes)
    signatures = stored(nodes.join(lists.select("node").distinct(), "node", "left_semi").select("node", "signature", "first"), "signatures")
    # One text per node to take the set from.
    wanted = signatures.select("node", "first.absent", "first.value", "first.text_key")
    texts = _keyed(docs, id_col, text_col).join(wanted, ["absent", "value", "text_key"]).select("node", "text")
    sets = texts.mapInArrow(_collect_sets, "node binary, shingles binary")
    sets = stored(sets.groupBy("node").agg(F.min("shingles").alias("shingles")), "sets")

    labels, current, tested, steps = signatures.select("node", F.col("node").alias("label")), lists.withColumn("label", F.col("node")), None, []
    for order in (F.col("node"), F.xxhash64("node", "posting")):
        pairs, found = _confirmed(_hub_pairs(current, order), signatures, sets, tested)
        tested = pairs
        steps.append(components(found))
        left = stored(_open_lists(_relabelled(current, steps[-1])), "open")
        discard(current)
        current = left
    steps.append(components(_block_links(current, sets)))
    for merged in steps:
        labels = _relabelled(labels, merged)
    labels = stored(labels, "labels")
    discard(current, signatures, sets, *steps)
    return labels


def _clustered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of all documents: absent, value, text_key, n_shingles, label (null without shingles), first (least id of the component)."""
    signed = stored(_keyed(docs, id_col, text_col).mapInArrow(_sign, _SIGNED), "signed")
    nodes = signed.where("node IS NOT NULL").groupBy("node", "n_shingles").agg(
        F.min(F.struct("absent", "value", "text_key")).alias("first"), F.first("signature").alias("signature")
    )
    nodes = stored(nodes, "nodes")
    labels = _links(docs, nodes, id_col, text_col)
    placed = nodes.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    firsts = placed.groupBy("label").agg(F.min("first").alias("first"))
    return signed.drop("signature").join(placed.select("node", "label").join(firsts, "label"), "node", "left")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    own = lambda absent, value: F.when(~F.col(absent), F.col(value))
    rows = _clustered(docs, id_col, text_col).withColumn("doc_id", own("absent", "value"))
    rows = rows.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(own("first.absent", "first.value")))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component its first document, and those without words."""
    firsts = _clustered(docs, id_col, text_col).where("node IS NOT NULL").select("first.*").distinct()
    rows = docs.select(F.struct("*").alias("row"))
    absent, value = key_parts(f"row.`{id_col}`")
    text = whole_text(f"row.`{text_col}`")
    keyed = rows.select("row", absent.alias("absent"), value.alias("value"), F.xxhash64(text).alias("text_key"))
    staying = keyed.join(firsts, ["absent", "value", "text_key"])
    staying = staying.groupBy("absent", "value", "text_key").agg(F.min("row").alias("row")).select("row.*")
    return staying.union(rows.where(~text.rlike(r"[^\x20\x09-\x0D]")).select("row.*"))
