"""Toxicity by bags of subwords: n-gram vectors averaged into a linear softmax.

A text is cut into windows of words. A window's vector is the average of its
distinct words' vectors (short windows are padded with zeros), a word's vector that of the hashed n-grams of its bytes (ends
marked), so misspellings never seen share most of their vectors with the words
they come from. Vectors and softmax are trained jointly, in numpy, on a bounded
sample of labelled texts. Labels are of whole texts: a first fit over all
windows finds the telling ones, a second learns from these alone. A text scores
as its most toxic window; every window of the whole text counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import lean, worker_cache
from tessella.llm.textbytes import _BYTE_VALUES, _P, _P_INV, _powers, buffers, mix

NGRAMS = (3, 4, 5)
BUCKETS, DIM, WINDOW = 1 << 16, 8, 12
#: The training sample holds at most so many texts of each class (the first by a hash of the id), and every window of them.
MAX_TEXTS = {1: 1200, 0: 1500}
EPOCHS, BATCH, RATE = (3, 8), 1024, 0.5
#: An n-gram counts if it is in so many texts of the sample.
MIN_TEXTS = 3
#: Refits on telling windows, and the share of clean windows below their bar.
REFITS, CLEAN_SHARE = 2, 0.998
#: Texts are cut into n-grams so many bytes at a time: in the making, those take some 200 bytes for each byte of text.
BATCH_BYTES = 1 << 17
#: Windows of the sample that are scored at a time.
SPAN = 1 << 12

_U = np.uint64
_SPACE = np.array([b <= 32 or chr(b) in ".,!?;:\"()[]{}|&%*#<>=+/\\" for b in range(256)])


@dataclass
class Bags:
    """N-grams of texts: buckets with weights, sorted by window; windows by text."""

    buckets: np.ndarray
    weights: np.ndarray
    window: np.ndarray
    text: np.ndarray


def bags(texts: pa.Array) -> Bags:
    """The n-grams of every window of WINDOW words of every text (null: empty)."""
    # A space around every text separates texts and marks the ends of words.
    mark, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    joined = pc.binary_join_element_wise(mark, pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), mark, nothing)
    data, offsets = buffers(joined)
    n = len(data)
    if n == 0:
        empty = np.empty(0, dtype=np.int64)
        return Bags(empty.astype(np.uint16), empty.astype(np.float32), empty, empty)
    space = _SPACE[data]
    data = np.where(space, np.uint8(32), data)
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    words_of = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(words_of)))[:-1]
    windows_of = -(-words_of // WINDOW)
    first_window = np.concatenate(([0], np.cumsum(windows_of)))[:-1]
    window = first_window[doc] + (np.arange(len(starts)) - first[doc]) // WINDOW
    sums = np.concatenate((np.zeros(1, dtype=_U), np.cumsum(_BYTE_VALUES[data] * _powers(_P, n), dtype=_U)))
    back = _powers(_P_INV, n)
    # A word counts once in its window, so that repetition alone says nothing.
    name = mix((sums[ends] - sums[starts]) * back[starts])
    order = np.lexsort((name, window))
    again = np.zeros(len(starts), dtype=bool)
    again[order[1:]] = (name[order[1:]] == name[order[:-1]]) & (window[order[1:]] == window[order[:-1]])
    starts, ends, window = starts[~again], ends[~again], window[~again]
    length = ends - starts
    total = sum(np.maximum(length + 3 - g, 0) for g in NGRAMS)
    found, of = [], []
    for g in NGRAMS:
        count = np.maximum(length + 3 - g, 0)
        w = np.repeat(np.arange(len(starts)), count)
        at = np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count) + starts[w] - 1
        found.append((mix((sums[at + g] - sums[at]) * back[at] + _U(g)) >> _U(48)).astype(np.uint16))
        of.append(w)
    w = np.concatenate(of)
    order = np.argsort(window[w], kind="stable")
    w = w[order]
    weights = (1.0 / (total[w] * float(WINDOW))).astype(np.float32)
    return Bags(np.concatenate(found)[order], weights, window[w], np.repeat(np.arange(len(texts)), windows_of))


@dataclass
class Model:
    """``effect`` of each bucket on the logit (its vector times the difference of the softmax rows), and the offset."""

    effect: np.ndarray
    offset: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        """The largest window logit of each text; texts without words get the offset less one window's doubt."""
        b = bags(texts)
        per_window = np.bincount(b.window, weights=self.effect[b.buckets] * b.weights, minlength=len(b.text))
        out = np.full(len(texts), -5.0)
        np.maximum.at(out, b.text, per_window + self.offset)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(texts), -30, 30)))


@dataclass
class Sample:
    """N-grams of the sample as training holds them: buckets with weights, and where those of each window begin and end."""

    buckets: np.ndarray
    weights: np.ndarray
    edge: np.ndarray


def _fit(b: Sample, chosen: np.ndarray, y: np.ndarray, vectors: np.ndarray, softmax: np.ndarray, bias: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Adaptive gradient steps on cross entropy over the chosen windows, in place."""
    buckets, weights, edge = b.buckets, b.weights, b.edge
    seen = [np.full_like(vectors, 1e-6), np.full_like(softmax, 1e-6), np.full_like(bias, 1e-6)]
    for _ in range(epochs):
        for i in range(0, len(chosen), BATCH):
            part = chosen[i : i + BATCH]
            n = edge[part + 1] - edge[part]
            row = np.repeat(np.arange(len(part)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + edge[part][row]
            k, w = buckets[at], weights[at]
            hidden = np.stack([np.bincount(row, weights=vectors[k, d] * w, minlength=len(part)) for d in range(DIM)], 1)
            z = hidden @ softmax.T + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1.0
            p /= len(part)
            back = p @ softmax
            grads = [np.stack([np.bincount(k, weights=back[row, d] * w, minlength=BUCKETS) for d in range(DIM)], 1), p.T @ hidden, p.sum(0)]
            for value, grad, past in zip((vectors, softmax, bias), grads, seen, strict=True):
                past += grad * grad
                value -= RATE * grad / np.sqrt(past)
        chosen = rng.permutation(chosen)


def _pieces(sizes) -> list[tuple[int, int]]:
    """Runs (first, end) of about BATCH_BYTES, to bound memory."""
    out, first, held = [], 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= BATCH_BYTES:
            out.append((first, i + 1))
            first, held = i + 1, 0
    return out + [(first, len(sizes))] * (first < len(sizes))


def train(texts: list[str], labels: list[int]) -> Model:
    """Fit a model to whole texts with labels 0 and 1; without texts of both classes, a model that calls nothing toxic."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), -5.0)
    rng = np.random.default_rng(7)
    truth = np.asarray(labels)
    parts, text_of, counts = [], [], np.zeros(BUCKETS, dtype=np.int64)
    pieces = _pieces([len(t) for t in texts])
    for first, end in pieces:
        b = bags(pa.array(texts[first:end], pa.large_string()))
        counts += np.bincount(np.unique(b.text[b.window] * BUCKETS + b.buckets) % BUCKETS, minlength=BUCKETS)
        # The sample's n-grams are the bulk of the memory here, so windows are held by their sizes, not beside every n-gram.
        parts.append((b.buckets, b.weights, np.bincount(b.window, minlength=len(b.text))))
        text_of.append(b.text + first)
    # N-grams of one or two texts tell those texts apart and nothing else; they keep no weight.
    known = counts >= MIN_TEXTS
    for i, (k, w, n) in enumerate(parts):
        keep = known[k]
        parts[i] = k[keep], w[keep], np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n))
    # Each column's parts go as it is joined.
    columns = [list(x) for x in zip(*parts, strict=True)]
    del parts, b, k, w, n, keep
    small = Sample(np.concatenate(columns.pop(0)), np.concatenate(columns.pop(0)), np.concatenate(([0], np.cumsum(np.concatenate(columns.pop(0))))))
    y = truth[np.concatenate(text_of)]
    windows = len(y)
    use = np.arange(windows)
    vectors, softmax, bias = rng.normal(0, 0.05, (BUCKETS, DIM)), rng.normal(0, 0.5, (2, DIM)), np.zeros(2)
    _fit(small, rng.permutation(use), y, vectors, softmax, bias, EPOCHS[0], rng)

    def window_logits() -> np.ndarray:
        effect = vectors @ (softmax[1] - softmax[0])
        out = np.zeros(windows)
        for i in range(0, windows, SPAN):
            here, edge = out[i : i + SPAN], small.edge[i : i + SPAN + 1]
            first, end = edge[0], edge[-1]
            weights = effect[small.buckets[first:end]] * small.weights[first:end]
            here += np.bincount(np.repeat(np.arange(len(here)), np.diff(edge)), weights=weights, minlength=len(here))
        return out + bias[1] - bias[0]

    # The telling windows of toxic texts are those above what all but a few clean windows reach;
    # texts labelled toxic without such a window teach nothing further.
    for _ in range(REFITS):
        z = window_logits()[use]
        bar = np.quantile(z[y[use] == 0], CLEAN_SHARE)
        chosen = use[(y[use] == 0) | (z > bar)]
        vectors[:], softmax[:], bias[:] = rng.normal(0, 0.05, vectors.shape), rng.normal(0, 0.5, softmax.shape), 0
        _fit(small, rng.permutation(chosen), y, vectors, softmax, bias, EPOCHS[1], rng)
    model = Model(np.where(known, vectors @ (softmax[1] - softmax[0]), 0.0), float(bias[1] - bias[0]))
    # Shift the offset so that 0.5 lies between what nearly all clean texts reach and the typical toxic text, nearer to the former.
    z = np.concatenate([model.logits(pa.array(texts[first:end], pa.large_string())) for first, end in pieces])
    cut = 0.7 * np.quantile(z[truth == 0], 0.99) + 0.3 * np.median(z[truth == 1])
    return Model(model.effect, model.offset - float(cut))


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on at most MAX_TEXTS labelled texts of each class that are not held out; the sample is fixed by the ids."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~is_held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct()
    ids = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for label, most in MAX_TEXTS.items()]
    # A repeated id counts once, by the least of its texts.
    first = docs.where("text is not null").select("doc_id", "text")
    sample = first.join(F.broadcast(ids[0].union(ids[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["text"]))
        model = train([r["text"] for r in rows], [r["toxic"] for r in rows])
        yield pa.RecordBatch.from_pylist([{"effect": model.effect.astype("<f8").tobytes(), "offset": model.offset}])

    # The sample is bounded, so one task trains on it, in a worker's memory instead of the driver's.
    rows = sample.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).repartition(1).mapInArrow(run, "effect binary, offset double").collect()
    return Model(np.frombuffer(rows[0].effect, dtype="<f8"), rows[0].offset) if rows else train([], [])


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """Add ``out_col``, the score of every whole text; other columns and all rows stay."""
    names = docs.columns
    effect, offset = model.effect.astype(np.float32), model.offset

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        m = Model(effect, offset)
        for batch in batches:
            texts = batch.column(names.index(text_col))
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            scores = [m.scores(texts.slice(first, end - first)) for first, end in _pieces(sizes)]
            kept = [(f, c) for f, c in zip(batch.schema, batch.columns, strict=True) if f.name != out_col]
            yield pa.RecordBatch.from_arrays([*[c for _, c in kept], pa.array(np.concatenate(scores) if scores else np.empty(0))], names=[*[f.name for f, _ in kept], out_col])

    schema = docs.drop(out_col).schema.add(out_col, "double")
    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Null and empty texts score near 0."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that score 0.5 or more; columns stay as they are."""
    return score(docs, fit(docs, labels), out_col="__toxicity").where("`__toxicity` < 0.5").drop("__toxicity")
