"""Near-duplicate documents by dart-throwing weighted MinHash.

A document is a weighted set: its shingles of five words (lower case, letters
and digits) with their counts. Darts are thrown at the region of each shingle:
a Poisson process over time on every unit of weight, seeded by the hash of the
shingle and the unit, so equal regions receive equal darts. Every dart lands on
one of k coordinates; a coordinate keeps its earliest dart. Two documents agree
in a coordinate with the probability of their weighted Jaccard similarity, and
only about k ln k darts are ever made for a document of any size.

Banded signatures give candidates, which are checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import lean, link, shared, staged, worker_cache
from tessella.llm.textbytes import LETTERS, buffers, mix, word_hashes

WORDS = 5
SIMILARITY = 0.8
#: Bands and rows. At similarity 0.8 a pair shares no band with probability (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
#: Texts per vectorised batch are cut at about this many bytes, to bound memory.
BATCH_BYTES = 4 << 20

_U = np.uint64


def shingle_slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all (shingle, occurrence) pairs and the text of each, sorted by text, then hash.

    The Jaccard similarity of two sets of slots is the weighted Jaccard
    similarity of the shingle counts. A text of one to four words is one
    shingle; a text without words has none.
    """
    data, offsets = buffers(pc.utf8_lower(pc.fill_null(texts, "")))
    words, of = word_hashes(data, offsets, LETTERS)
    n = np.bincount(of, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(texts)), count)
    start = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.concatenate(([0], np.cumsum(count)))[:-1], count)
    h = np.zeros(len(start), dtype=_U)
    last = first + n
    for j in range(WORDS):
        at = start + j
        inside = at < last[doc]
        h = np.where(inside, mix(h * _U(0x9E3779B97F4A7C15) + words[np.minimum(at, max(len(words) - 1, 0))] if len(words) else h), h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if not len(h):
        return h, doc
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
    run = np.flatnonzero(new)
    occurrence = np.arange(len(h)) - np.repeat(run, np.diff(np.concatenate((run, [len(h)]))))
    h = mix(h + occurrence.astype(_U) * _U(0xD1B54A32D192ED03))
    order = np.lexsort((h, doc))
    return h[order], doc[order]


def _gaps(h: np.ndarray) -> np.ndarray:
    """Exponential waiting times from hashes."""
    return -np.log(((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)


def dart_signatures(slots: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """(n_docs, k) earliest darts; documents without slots get zeros.

    The darts of a slot are thrown in order of time up to a horizon of
    (ln k + 5) / weight; the few documents that leave a coordinate empty are
    thrown again with a doubled horizon, until none is.
    """
    weight = np.bincount(doc, minlength=n_docs)
    signature = np.zeros((n_docs, k), dtype=_U)
    todo = np.flatnonzero(weight)
    horizon = k * (np.log(k) + 5.0) / np.maximum(weight, 1)
    while len(todo):
        place = np.full(n_docs, -1)
        place[todo] = np.arange(len(todo))
        best = np.full((len(todo), k), np.iinfo(np.uint64).max, dtype=_U)
        mine = place[doc] >= 0
        h, d = slots[mine], doc[mine]
        t, limit, row = _gaps(mix(h ^ _U(0xA5A5A5A5A5A5A5A5))), horizon[d], place[d]
        scale = _U(2**32 - 1) / limit
        step = 0
        while len(h):
            live = t <= limit
            h, t, limit, row, scale = h[live], t[live], limit[live], row[live], scale[live]
            if not len(h):
                break
            dart = mix(h + _U((step * 0xBF58476D1CE4E5B9) & (2**64 - 1)))
            # Time in the high half, the dart's name in the low: the least value is the earliest dart.
            value = ((t * scale).astype(_U) << _U(32)) | (dart >> _U(32))
            np.minimum.at(best.reshape(-1), row * k + (dart % _U(k)).astype(np.int64), value)
            step += 1
            t = t + _gaps(mix(dart ^ _U(0x5851F42D4C957F2D)))
        full = (best != np.iinfo(np.uint64).max).all(axis=1)
        done = todo[full]
        # Names of darts carry no horizon, so documents of unlike size still agree.
        signature[done] = mix((best[full] & _U(0xFFFFFFFF)) + _U(1))
        todo = todo[~full]
        horizon[todo] *= 2.0
    return signature


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(n, bands) int64 bucket names."""
    out = np.empty((len(signature), bands), dtype=_U)
    for b in range(bands):
        h = np.full(len(signature), b + 1, dtype=_U)
        for j in range(rows):
            h = mix(h * _U(0x9E3779B97F4A7C15) + signature[:, b * rows + j])
        out[:, b] = h
    return out.view(np.int64)


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES)))
        yield batch.slice(at, end - at)
        at = end


def _names(slots: np.ndarray, doc: np.ndarray, n: int) -> list[pa.Array]:
    """128-bit names of the shingle counts of n texts, as two columns; null without shingles."""
    full = np.bincount(doc, minlength=n) > 0
    starts = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))
    out = []
    for salt in (0x1234567, 0x89ABCDE):
        sums = np.concatenate((np.zeros(1, dtype=_U), np.cumsum(mix(slots + _U(salt)), dtype=_U)))
        out.append(pa.array((sums[starts[1:]] - sums[starts[:-1]]).view(np.int64), mask=~full))
    return out


@lean
def _sign_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, h1, h2, bands): the name of the shingle counts and the bands of the signature."""
    worker_cache("minhash")
    for whole in batches:
        for batch in _pieces(whole, "text"):
            slots, doc = shingle_slots(batch.column("text"))
            n = batch.num_rows
            bands = band_hashes(dart_signatures(slots, doc, n, BANDS * ROWS))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *_names(slots, doc, n), lists], names=["id", "h1", "h2", "bands"])


@lean
def _slot_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, h1, h2, slots), the slots packed as bytes."""
    for whole in batches:
        for batch in _pieces(whole, "text"):
            slots, doc = shingle_slots(batch.column("text"))
            n = batch.num_rows
            ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))) * 8
            packed = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(slots))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *_names(slots, doc, n), packed.cast(pa.binary())], names=["id", "h1", "h2", "slots"])


@lean
def _check_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, x, y) to the pairs whose packed slots x and y are similar enough."""
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        keep = []
        for i in range(batch.num_rows):
            p, q = (np.frombuffer(c[i].as_buffer(), dtype=_U) for c in (x, y))
            both = 0
            if min(len(p), len(q)) >= SIMILARITY * max(len(p), len(q)):
                both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(both > 0 and both >= SIMILARITY * (len(p) + len(q) - both))
        chosen = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(chosen), batch.column("b").filter(chosen)], names=["a", "b"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and class_id, the smallest id of its near-duplicate class.

    Classes are the connected components of "weighted Jaccard similarity of
    five-word shingles is at least 0.8". Texts without words (null, empty) and
    null ids are in classes of their own. Rows that repeat an id with other
    texts are compared under that id; each row gets the class of its text.
    Copies are collapsed right after signing: one text of each distinct shingle
    count is banded and compared, and only texts that share a bucket are
    fetched again to be compared exactly. An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = staged(base.mapInArrow(_sign_texts, "id long, h1 long, h2 long, bands array<long>"), "signed", spark)
    # Equal names have equal bands, so the bands can be part of the key.
    groups = signed.where("h1 is not null and id is not null").groupBy("h1", "h2", "bands").agg(F.min("id").alias("rep"))
    groups = staged(groups, "groups", spark)

    def checker(ids: DataFrame):
        texts = base.join(ids, "id", "left_semi").mapInArrow(_slot_texts, "id long, h1 long, h2 long, slots binary")
        wanted = groups.select(F.col("rep").alias("id"), "h1", "h2").join(ids, "id", "left_semi")
        slots = staged(texts.join(wanted, ["id", "h1", "h2"], "left_semi").dropDuplicates(["id", "h1", "h2"]).select("id", "slots"), "slots", spark)

        def verify(pairs: DataFrame) -> DataFrame:
            joined = pairs.join(slots.select(F.col("id").alias("a"), F.col("slots").alias("x")), "a").join(slots.select(F.col("id").alias("b"), F.col("slots").alias("y")), "b")
            return joined.select("a", "b", "x", "y").mapInArrow(_check_pairs, "a long, b long").distinct()

        return verify

    found = link(shared(groups.select(F.explode("bands").alias("bucket"), F.col("rep").alias("id"))), checker)
    heads = groups.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("root", "rep").alias("class_id"))
    out = signed.select("id", "h1", "h2").join(heads, ["h1", "h2"], "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class, that of the smallest id; columns stay as they are.

    ``id_col`` must identify documents: rows that repeat an id stay or go together.
    Rows with a null id stay.
    """
    spark = docs.sparkSession
    go = staged(classes(docs, id_col, text_col).where("doc_id <> class_id").select(F.col("doc_id").alias("__go")).distinct(), "go", spark)
    return docs.join(go, F.col(f"`{id_col}`") == F.col("__go"), "left_anti")
