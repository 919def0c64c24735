"""Language of documents by a bidirectional gated recurrent network over bytes.

The text's UTF-8 bytes are read in windows of ``WINDOW`` bytes. Two gated recurrent layers run over a window,
one forwards and one backwards; at every position both states together give a
probability for each language. A document's probabilities are the mean over all its positions that are
part of a letter, so every byte of every text is labelled and the whole text decides.

The network is trained in numpy by backpropagation through time (``gradients``) with Adam, on windows of
labelled documents: at most ``sample_docs`` documents of a language, chosen by the hash of their id, and
``sample_windows`` windows of each, spread evenly over its text. Every language that occurs among the documents allowed for
training is learned; labels are not read for any other purpose. Prediction is one scan without shuffle;
a task holds the positions of ``BATCH`` windows at a time, whatever the length of a text.

Defined cases: a text that is null or has no letter is ``und`` with score 0, also where no language was learned. A null
lang is no label; null ids may be learned from where the caller's rule allows it. Repeated rows are judged alike. Very long texts are
read whole. Extra columns are not read. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .rows import whole_text
from .store import discard, stored

WINDOW, BATCH = 64, 2048
RANK_PARTS = (64, 8, 1)  # each divides the one before it
HIDDEN = 8
UNKNOWN = "und"
_NO_BYTE = 256  # past the end of a text


@dataclass
class Model:
    """Weights by name; ``languages`` in the order of the classes."""

    languages: list[str] = field(default_factory=list)
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def new_weights(classes: int, rng: np.random.Generator, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """``in``: what each byte adds to the gates (update, reset, candidate); ``state``: what the last state adds; one of each per direction."""
    out = {}
    for side in "fb":
        out[f"{side}_in"] = rng.normal(0, 0.5, (_NO_BYTE + 1, 3 * hidden))
        out[f"{side}_state"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
    out["out"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, classes))
    out["bias"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in out.items()}


def _run(table: np.ndarray, state: np.ndarray, text: np.ndarray, order: range, keep: dict | None = None) -> np.ndarray:
    """States at each position, (steps, rows, hidden), taken in ``order``; ``text`` is (steps, rows). ``keep`` takes what training needs."""
    hidden = state.shape[0]
    gates, candidate = np.ascontiguousarray(state[:, : 2 * hidden]), np.ascontiguousarray(state[:, 2 * hidden :])
    gate_in, candidate_in = np.ascontiguousarray(table[:, : 2 * hidden]), np.ascontiguousarray(table[:, 2 * hidden :])
    steps, rows = text.shape
    states = np.empty((steps, rows, hidden), table.dtype)
    h = np.zeros((rows, hidden), table.dtype)
    zr, c = np.empty((rows, 2 * hidden), table.dtype), np.empty_like(h)
    more, reset = np.empty_like(zr), np.empty_like(h)
    z, r = zr[:, :hidden], zr[:, hidden:]
    for t in order:
        np.matmul(h, gates, out=zr)
        zr += np.take(gate_in, text[t], axis=0, out=more, mode="clip")
        # The logistic function by way of tanh.
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        np.matmul(np.multiply(r, h, out=reset), candidate, out=c)
        c += np.take(candidate_in, text[t], axis=0, out=reset, mode="clip")
        np.tanh(c, out=c)
        if keep is not None:
            keep[t] = (h, z.copy(), r.copy(), c.copy())
        after = np.subtract(h, c, out=states[t])
        after *= z
        after += c
        h = after
    return states


def _orders(text: np.ndarray) -> tuple[range, range]:
    return range(len(text)), range(len(text) - 1, -1, -1)


def _scores(weights: dict[str, np.ndarray], text: np.ndarray, kept: tuple[dict, dict] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the languages at each position, (classes, steps * rows), and the states of both directions."""
    kept = kept or (None, None)
    ahead, back = (
        _run(weights[f"{side}_in"], weights[f"{side}_state"], text, order, keep).reshape(text.size, -1)
        for side, order, keep in zip("fb", _orders(text), kept)
    )
    out, hidden = weights["out"], ahead.shape[1]
    scores = out[:hidden].T @ ahead.T
    scores += out[hidden:].T @ back.T
    scores += weights["bias"][:, None]
    return scores, ahead, back


def _softmax(scores: np.ndarray) -> np.ndarray:
    """In place, over the first axis."""
    scores -= scores.max(axis=0)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=0)
    return scores


def _back_through_time(state: np.ndarray, order: range, kept: dict, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of what the bytes add to the gates, (steps, rows, 3 * hidden), and of ``state``, from those of the states."""
    hidden = state.shape[0]
    gates, candidate = state[:, : 2 * hidden], state[:, 2 * hidden :]
    d_in, d_state = np.empty((*d_states.shape[:2], 3 * hidden), state.dtype), np.zeros_like(state)
    d_h = np.zeros_like(d_states[0])
    for t in reversed(order):
        h, z, r, c = kept[t]
        d_h = d_h + d_states[t]
        d_zr, d_c = d_in[t, :, : 2 * hidden], d_in[t, :, 2 * hidden :]
        d_c[:] = d_h * (1 - z) * (1 - c * c)
        d_rh = d_c @ candidate.T
        d_zr[:, :hidden] = d_h * (h - c) * z * (1 - z)
        d_zr[:, hidden:] = d_rh * h * r * (1 - r)
        d_state[:, : 2 * hidden] += h.T @ d_zr
        d_state[:, 2 * hidden :] += (r * h).T @ d_c
        d_h = d_h * z + d_rh * r + d_zr @ gates.T
    return d_in, d_state


def gradients(weights: dict[str, np.ndarray], text: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the positions that hold a byte, and its gradients; ``text`` is (steps, rows), ``labels`` one class per row."""
    kept: tuple[dict, dict] = ({}, {})
    scores, ahead, back = _scores(weights, text, kept)
    p = _softmax(scores).reshape(-1, *text.shape)
    here = (text != _NO_BYTE).astype(p.dtype)
    n = max(1.0, float(here.sum()))
    rows = np.arange(len(labels))
    loss = -float((np.log(np.maximum(p[labels, :, rows], 1e-30)) * here.T).sum()) / n
    p[labels, :, rows] -= 1
    d = (p * (here / n)).reshape(len(p), -1).astype(ahead.dtype)
    hidden, out = ahead.shape[1], weights["out"]
    grads = {"out": np.concatenate([(d @ ahead).T, (d @ back).T]), "bias": d.sum(axis=1)}
    flat = text.ravel()
    by_byte = np.argsort(flat, kind="stable")
    found, first = np.unique(flat[by_byte], return_index=True)
    for side, order, keep, part in zip("fb", _orders(text), kept, (out[:hidden], out[hidden:])):
        d_states = (part @ d).T.reshape(*text.shape, hidden)
        d_in, grads[f"{side}_state"] = _back_through_time(weights[f"{side}_state"], order, keep, d_states)
        grads[f"{side}_in"] = np.zeros_like(weights[f"{side}_in"])
        grads[f"{side}_in"][found] = np.add.reduceat(d_in.reshape(text.size, -1)[by_byte], first, axis=0)
    return loss, grads


def fit(text: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 12, rows: int = 256, rate: float = 0.02) -> Model:
    """Adam over shuffled batches of windows; ``text`` is (windows, WINDOW)."""
    rng = np.random.default_rng(0)
    weights = new_weights(len(languages), rng)
    m = {k: np.zeros_like(v) for k, v in weights.items()}
    v = {k: np.zeros_like(x) for k, x in weights.items()}
    step, total = 0, max(1, epochs * -(-len(text) // rows))
    for _ in range(epochs):
        order = rng.permutation(len(text))
        for low in range(0, len(order), rows):
            part = order[low : low + rows]
            _, grads = gradients(weights, np.ascontiguousarray(text[part].T), labels[part])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            now = rate * 0.5 * (1 + np.cos(np.pi * step / total))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (size + 1e-12))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                weights[k] = (weights[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(languages, weights)


def windows(data: bytes) -> np.ndarray:
    """The bytes of a text in rows of WINDOW, the last filled up."""
    rows = -(-len(data) // WINDOW)
    out = np.full(rows * WINDOW, _NO_BYTE, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(rows, WINDOW)


#: Bytes that are part of a letter: A-Z, a-z and those of all characters beyond ASCII.
_LETTER = np.zeros(_NO_BYTE + 1, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _pooled(model: Model, text: np.ndarray, owner: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Adds the probabilities at all letters of some windows to their documents."""
    steps = np.ascontiguousarray(text.T)
    p = _softmax(_scores(model.weights, steps)[0]).reshape(-1, *steps.shape)
    letter = _LETTER[steps]
    p *= letter
    np.add.at(sums, owner, p.sum(axis=1).T)
    np.add.at(counts, owner, letter.sum(axis=0))


def probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): the mean of the probabilities over the letters of each text."""
    sums, counts = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    held, owners, n = [], [], 0

    def flush() -> None:
        nonlocal held, owners, n
        if held:
            text, owner = np.concatenate(held), np.repeat(owners, [len(h) for h in held])
            for low in range(0, len(text), BATCH):
                _pooled(model, text[low : low + BATCH], owner[low : low + BATCH], sums, counts)
        held, owners, n = [], [], 0

    for i, data in enumerate(texts):
        for low in range(0, len(data), WINDOW * BATCH):
            part = windows(data[low : low + WINDOW * BATCH])
            held.append(part)
            owners.append(i)
            n += len(part)
            if n >= BATCH:
                flush()
    flush()
    return sums / np.maximum(counts, 1)[:, None]


# -- Spark ----------------------------------------------------------------


def train(
    docs: DataFrame,
    allowed: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = 400,
    sample_windows: int = 6,
    **options,
) -> Model:
    """A model learned from the text and lang of the rows where ``allowed`` holds and lang is not null.

    What comes to the driver is bounded: ``sample_docs`` x ``sample_windows`` x WINDOW bytes of a language.
    """
    text = whole_text(text_col)
    labelled = docs.where(allowed & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.xxhash64(F.col(id_col).cast("string")).alias("h"),
        F.xxhash64(text).alias("x"),
        text.cast("binary").alias("data"),
    )
    # Ranked without the texts, repeated rows once; a common language first by parts, so that no task ranks all its rows.
    ranked = labelled.select("lang", "h", "x").distinct()
    for parts in RANK_PARTS:
        group = Window.partitionBy("lang", F.pmod("x", F.lit(parts))).orderBy("h", "x")
        ranked = ranked.withColumn("place", F.row_number().over(group)).where(F.col("place") <= sample_docs)
    chosen = stored(ranked.select("lang", "h", "x"), "language-sample")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("data")):
                data = data.as_buffer()
                last = max(0, (len(data) - 1) // WINDOW)
                for i in np.unique(np.linspace(0, last, sample_windows).astype(int)):
                    part = data[int(i) * WINDOW : (int(i) + 1) * WINDOW].to_pybytes()
                    if part:
                        langs.append(lang)
                        parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "part"])

    # Bounded by ``sample_docs`` rows a language, so it may be broadcast.
    texts = labelled.join(F.broadcast(chosen), ["lang", "h", "x"]).groupBy("lang", "h", "x").agg(F.first("data").alias("data"))
    sample = texts.select("lang", "data").mapInArrow(cut, "lang string, part binary")
    rows = sorted((r.lang, bytes(r.part)) for r in sample.collect())
    languages = sorted(r.lang for r in chosen.select("lang").distinct().collect())
    discard(chosen)
    if not rows:
        return Model()
    index = {lang: i for i, lang in enumerate(languages)}
    text = np.concatenate([windows(part) for _, part in rows])
    return fit(text, np.array([index[lang] for lang, _ in rows]), languages, **options)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1): one row per document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    if not model.languages:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = probabilities(model, [d.as_py() or b"" for d in batch.column("data")])
            # No data: the text has no letter.
            known = batch.column("data").is_valid().to_pylist()
            names = [model.languages[i] if k else UNKNOWN for i, k in zip(found.argmax(axis=1), known)]
            scores = np.where(known, np.minimum(found.max(axis=1), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    lettered = rows.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text").cast("binary")).alias("data"))
    return lettered.mapInArrow(judge, "doc_id long, lang_pred string, score double")
