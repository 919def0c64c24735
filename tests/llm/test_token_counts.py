"""Token counts against the library, whole texts at once."""

import random

import pytest

from pairlens.llm.token_counts import count_spliced, default_vocabulary, load, token_counts

TRICKY = ["it's we're  x", "<|endoftext|> a <|startoftext|>b", "a\x1cb\x1f c", "é a ́b", " x y\u0085z", "ΑΣ ΣΑ", "日本語 text 123", "", " \n\t ", "###*** 😀😀"]


@pytest.fixture(scope="module")
def tokenizer():
    return load(default_vocabulary())


def whole(tokenizer, text):
    return len(tokenizer.encode(text, add_special_tokens=False))


def test_every_document_as_the_library_counts(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: (len(r.text.encode()), whole(tokenizer, r.text)) for r in docs.collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(docs).collect()}
    spliced = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(docs, chunk_chars=300, overlap_chars=20).collect()}
    assert got == want and spliced == want


def test_splicing_survives_texts_without_boundaries(tokenizer):
    rng = random.Random(5)
    texts = TRICKY + [" ".join(TRICKY) * 9, "x" * 500 + " y", "ab" * 300, "a" + " " * 400 + "b"]
    texts += ["".join(rng.choice("abé Σ'1#\ń ") for _ in range(rng.randrange(1, 400))) for _ in range(150)]
    for text in texts:
        for chunk, overlap in ((7, 1), (16, 3), (64, 10)):
            assert count_spliced(tokenizer, text, chunk, overlap) == whole(tokenizer, text), (text, chunk)


def test_nulls_ties_and_clashing_columns(spark, tokenizer):
    rows = [(1, None, 9), (None, "a b", 9), (1, "a b", 9), (1, "a b", 9)] + [(10 + i, t, 0) for i, t in enumerate(TRICKY)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, limit=1).collect())
    want = sorted((i or 0, len((t or "").encode()), whole(tokenizer, t or ""), whole(tokenizer, t or "") > 1) for i, t, _ in rows)
    assert got == want


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
