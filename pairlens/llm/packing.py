"""Best-fit packing under conflicts.

Documents are measured in words. Full pieces of ``capacity`` words fill a bin
each; the rest of a document is packed best-fit decreasing. Two rests of the
same source or of the same duplicate cluster (equal normalised texts) never
share a bin. Each bin carries a bitmap of its sources and one of its clusters;
the open bins are ordered by what is left in them, and the search starts at
the first that is large enough and goes on until a bin is compatible, which is
then the tightest one.

Rests are dealt evenly into shards of about ``shard_rows`` rows whatever their
keys, so a source with a third of all rows is in every shard in proportion, and no task
holds more than one shard. Each shard is packed whole; nothing is dropped. The
narrow table that is dealt out is stored first, so a task that is
repeated packs the same rows the same way.

Defined cases: a null or empty text has no words, occupies no bin and comes out
with a null bin; null sources conflict with nothing; repeated rows are packed
each (in different bins, as copies); ties in size go by cluster, then id. An
empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .exact_dedup import normalised
from .rows import WORD, whole_text
from .store import stored

SCHEMA = "bin_id long, doc_id long, piece long, start_word long, n_words long, slot int"
ARROW = pa.schema([(c, pa.int64()) for c in ("bin_id", "doc_id", "piece", "start_word", "n_words")] + [("slot", pa.int32())])


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> list[int]:
    """Bin number of each (size, source, cluster), taken in the given order; None conflicts with nothing."""
    bits: dict[tuple[str, object], int] = {}
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    chosen = []
    for size, source, cluster in items:
        source_bit = 0 if source is None else 1 << bits.setdefault(("source", source), len(bits))
        cluster_bit = 0 if cluster is None else 1 << bits.setdefault(("cluster", cluster), len(bits))
        at = bisect_left(order, (size, -1))
        while at < len(order) and (sources[order[at][1]] & source_bit or clusters[order[at][1]] & cluster_bit):
            at += 1
        if at < len(order):
            residual, number = order.pop(at)
        else:
            residual, number = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[number] |= source_bit
        clusters[number] |= cluster_bit
        if residual > size:
            insort(order, (residual - size, number))
        chosen.append(number)
    return chosen


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    shard_rows: int = 8192,
) -> DataFrame:
    """One row per piece: bin_id, doc_id, piece, start_word, n_words, slot (place in the bin)."""
    sizes = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.unhex(F.md5(normalised(text_col))).alias("cluster"),
            F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("n"),
        ),
        "packing-sizes",
    )
    n_shards = max(1, -(-sizes.count() // shard_rows))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [batch for batch in batches if batch.num_rows]
        if not rows:
            return
        shard = pa.Table.from_batches(rows).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        for part in pack_shard(shard, capacity, TaskContext.get().partitionId() << 32):
            if len(part):
                yield pa.RecordBatch.from_pandas(part, ARROW, preserve_index=False)

    return sizes.repartition(n_shards).mapInArrow(fill, SCHEMA)


def pack_shard(shard: pd.DataFrame, capacity: int, first_bin: int) -> Iterator[pd.DataFrame]:
    """Pieces of the documents of one shard (doc_id, source, cluster, n); bins are numbered from ``first_bin``."""
    # Full pieces take the bins after those of the rests.
    full, rest = shard.n // capacity, shard.n % capacity
    packed = shard.assign(full=full, rest=rest)[rest > 0]
    packed = packed.sort_values(["rest", "cluster", "doc_id", "source"], ascending=[False, True, True, True])
    blank = lambda x: None if x is None or x != x else x
    items = list(zip(packed.rest.tolist(), map(blank, packed.source), map(bytes, packed.cluster)))
    packed["bin"] = best_fit(items, capacity)
    packed["slot"] = packed.groupby("bin").cumcount()
    used = int(packed.bin.max()) + 1 if len(packed) else 0
    yield pd.DataFrame(
        {
            "bin_id": packed.bin + first_bin,
            "doc_id": packed.doc_id,
            "piece": packed.full,
            "start_word": packed.full * capacity,
            "n_words": packed.rest,
            "slot": packed.slot,
        }
    )
    for row, count in zip(shard[full > 0].itertuples(), full[full > 0].tolist()):
        for low in range(0, count, 10_000):
            pieces = pd.Series(range(low, min(count, low + 10_000)))
            yield pd.DataFrame(
                {
                    "bin_id": pieces + used + first_bin,
                    "doc_id": pd.Series([row.doc_id] * len(pieces), dtype="Int64"),
                    "piece": pieces,
                    "start_word": pieces * capacity,
                    "n_words": capacity,
                    "slot": 0,
                }
            )
            used += len(pieces)
    empty = shard[shard.n == 0]
    nothing = pd.Series([pd.NA] * len(empty), dtype="Int64")
    yield pd.DataFrame(
        {"bin_id": nothing, "doc_id": empty.doc_id.reset_index(drop=True), "piece": 0, "start_word": 0, "n_words": 0, "slot": nothing}
    )
