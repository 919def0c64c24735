"""Token counts of whole texts, as the tokenizer library gives them.

Ordinary texts are counted word by word: this vocabulary's pre-tokenizer never
lets a token cross white space, so the counts of the words add up, and a task
asks the library once per distinct word. Texts longer than ``chunk_chars`` are
encoded in overlapping chunks with offsets, and neighbouring chunks are spliced
at a boundary where both encodings have a token end and white space follows;
there the pre-tokenizer cuts in the whole text as well, which proves it
stable. If the overlap holds no such boundary it is widened until it does or the
text ends. A single chunk is encoded at a time, so memory follows the text
itself and one chunk.

Defined cases: a null text counts as empty with no tokens; a null id stays
null; repeated rows are counted each; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .rows import whole_text

#: Python's split takes these for white space and the tokenizer does not; special strings may start so.
_NOT_BY_WORD = re.compile("[\x1c-\x1f]|<\\|")
_SPACE = frozenset(" \t\n\x0b\x0c\r")
_LOADED: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str):
    """The tokenizer, once per Python worker, without truncation and padding."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[path] = tokenizer
    return _LOADED[path]


def _token_ends(tokenizer, text: str, start: int, stop: int) -> list[int]:
    """Where the tokens of text[start:stop] end in the text, in order; a token that shares its characters repeats the end."""
    encoding = tokenizer.encode(text[start:stop], add_special_tokens=False)
    return [start + end for _, end in encoding.offsets]


def _stable(text: str, ends: set[int], more: set[int], low: int, high: int) -> int | None:
    """The last boundary in [low, high) that both encodings share and that white space follows."""
    for at in sorted(ends & more, reverse=True):
        if low <= at < high and text[at] in _SPACE:
            return at
    return None


def count_spliced(tokenizer, text: str, chunk_chars: int, overlap_chars: int) -> int:
    """Tokens of a huge text from overlapping chunks."""
    if len(text) <= chunk_chars:
        return len(tokenizer.encode(text, add_special_tokens=False))
    total, start, stop = 0, 0, chunk_chars
    ends = _token_ends(tokenizer, text, start, stop)
    while stop < len(text):
        overlap = overlap_chars
        while True:
            low = max(start + 1, stop - overlap)
            after = min(len(text), low + max(chunk_chars, 2 * overlap))
            following = _token_ends(tokenizer, text, low, after)
            # The first token after `low` may be half of a word; what follows white space is whole.
            at = _stable(text, set(ends), set(following), low + 1, stop)
            if at is not None:
                total += sum(end <= at for end in ends)
                ends, start, stop = [end for end in following if end > at], at, after
                break
            if low == start + 1:  # no stable boundary in the whole chunk: the chunk grows
                stop = min(len(text), stop + max(chunk_chars, stop - start))
                ends = [end for end in _token_ends(tokenizer, text, start, stop) if end > start]
                if stop == len(text):
                    break
                overlap = overlap_chars
                continue
            overlap *= 2
    return total + len(ends)


class _Counter:
    """Counts texts by their words, remembering at most ``most`` words."""

    def __init__(self, path: str, chunk_chars: int, overlap_chars: int, most: int = 1_000_000):
        self.tokenizer, self.chunk, self.overlap, self.most = load(path), chunk_chars, overlap_chars, most
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        split = [None if len(t) > self.chunk or _NOT_BY_WORD.search(t) else t.split() for t in texts]
        fresh = set().union(*(words for words in split if words)) - self.known.keys()
        if len(self.known) + len(fresh) > self.most:
            self.known.clear()
            fresh = set().union(*(words for words in split if words))
        if fresh:
            fresh = list(fresh)
            for word, code in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)):
                self.known[word] = len(code)
        size = self.known.__getitem__
        return [
            count_spliced(self.tokenizer, text, self.chunk, self.overlap) if words is None else sum(map(size, words))
            for text, words in zip(texts, split)
        ]


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    limit: int = 2048,
    chunk_chars: int = 32_768,
    overlap_chars: int = 512,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(path, chunk_chars, overlap_chars)
        for batch in batches:
            counts: list[int] = []
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                counts += counter(texts.slice(at, 256).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    counted = rows.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes")).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
