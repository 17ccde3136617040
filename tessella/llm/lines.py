"""Fuzzy line deduplication.

Lines are alike if the sets of their character shingles (five characters from
every position) have a Jaccard similarity of 0.8 or more. Lines are split and
named natively; equal ones are collapsed with their text, so nothing is fetched
again. Shingles are hashed from the bytes in Arrow batches. A line's distinct
hashes are sorted, and neighbours among them are bands: every run of neighbours
in short lines, the runs beside fixed points of the number range in longer
ones. Bands name buckets, candidates of a bucket are checked by exact Jaccard
similarity, and distributed union-find keeps the first line of each component.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import fenced, forget, lean, link, staged, worker_cache
from tessella.llm.textbytes import _BYTE_VALUES, _P, _P_INV, _powers, buffers, mix

#: Similarity as a fraction: alike if both / either >= 4 / 5, that is 9 * both >= 4 * (sizes of the two).
SHINGLE, SIMILAR = 5, (4, 9)
#: Bands of lines with (from, below) so many distinct shingles: hashes in a band, and beside how many evenly spaced points they lie, or 0:
#: all runs of so many neighbours. Ranges overlap so that two lines alike (sizes within 4/5) always share one.
#: Of u hashes of either line at most u/5 are not common, so the common ones have a run of 2 (u = 5), 3 (u >= 6), 4 (u >= 16): all runs
#: lose nothing. A band beside a point agrees with probability 0.8**rows, so at 0.8 none of 32 does with probability 3e-6 (5 hashes),
#: nor of 42 (6 hashes). Bands of 6 are for lines in which 42 of them hardly overlap; unlike lines share far fewer of them.
KINDS = ((1, 6, 2, 0), (5, 25, 3, 0), (20, 40, 4, 0), (40, 100, 4, 32), (80, 320, 5, 32), (256, 1 << 62, 6, 42))
#: Points begin ranges of hashes; an outline tells in which of 256 ranges an odd number of them lies, 64 ranges a column.
RANGE_BITS, OUTLINE_BITS, COLUMN_BITS = 7, 8, 6
#: The outline of a line of so many shingles tells nothing, as it ends at half its ranges; such lines have a wide one too, of as many ranges as shingles or more.
WIDE = 1 << OUTLINE_BITS
#: So many pairs at a time take along what they are compared by: pairs grow with the square of a group of lines, what they take to disk must not.
SLICE = 1 << 21
#: Texts are hashed in pieces of about so many bytes and at most so many texts (16 bits of a sort key number them).
PIECE_BYTES, PIECE_TEXTS = 1 << 20, 1 << 15
#: Bands are packed and sorted so many at a time, and named by so many bits in all: lines of buckets that share a name are checked like any.
FLUSH, PART_BITS, LOW_BYTES = 1 << 20, 12, 5

_U = np.uint64
_STEP = 10**10


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1) -> DataFrame:
    """(doc_id, line_no, line, key) for every line; key, the form compared, is null for lines that are always kept (blank ones, and those of fewer words than ``min_words``)."""
    lines = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("key", fenced(F.lower(F.trim("line"))))
    counts = r"\S" + r"\s+\S+" * (min_words - 1)
    return lines.withColumn("key", fenced(F.when(F.col("key").rlike(counts), F.col("key"))))


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles from all positions, and the text of each, in no order; a text shorter than a shingle is its own."""
    data, offsets = buffers(texts)
    size = np.diff(offsets)
    beyond = np.concatenate(([0], np.cumsum(data >= 128)))
    plain = (np.diff(beyond[offsets]) == 0) & (size >= SHINGLE)
    if not plain.any():
        return _any_shingles(data, offsets)
    # Where characters are bytes all shingles have the same length, and the same sum comes without gathering.
    if plain.all():
        of, odd = np.arange(len(texts)), None
    else:
        of, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        odd = _any_shingles(*buffers(texts.take(pa.array(rest))))
        data, offsets = buffers(texts.take(pa.array(of)))
        size = np.diff(offsets)
    value = _BYTE_VALUES[data]
    n = len(data) - SHINGLE + 1
    h = value[SHINGLE - 1 :] * _U(_P)
    for k in range(SHINGLE - 2, -1, -1):
        h += value[k : k + n]
        if k:
            h *= _U(_P)
    whole = np.ones(len(data), dtype=bool)
    whole[(offsets[1:, None] - np.arange(1, SHINGLE)).ravel()] = False
    h, of = mix(h[whole[:n]]), np.repeat(of, size - SHINGLE + 1)
    return (h, of) if odd is None else (np.concatenate((h, odd[0])), np.concatenate((of, rest[odd[1]])))


def _any_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(heads, offsets)
    chars = np.diff(first)
    count = np.where(chars > 0, np.maximum(chars - SHINGLE + 1, 1), 0)
    of = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(of)) + np.repeat(first[:-1] - (np.cumsum(count) - count), count)
    edge = np.append(heads, len(data))
    start, end = edge[at], edge[np.minimum(at + SHINGLE, first[1:][of])]
    sums = np.concatenate((np.zeros(1, dtype=_U), np.cumsum(_BYTE_VALUES[data] * _powers(_P, len(data)), dtype=_U)))
    return mix((sums[end] - sums[start]) * _powers(_P_INV, len(data) + 1)[start]), of


def _sorted(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Distinct sort keys, 16 bits of the text's number and 48 of the hash, in order."""
    key = (of.astype(_U) << _U(48)) | (hashes >> _U(16))
    key.sort()
    return key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces (first, end) of about PIECE_BYTES and at most PIECE_TEXTS."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + PIECE_BYTES))
        end = min(max(end, at + 1), at + PIECE_TEXTS, len(sizes))
        yield at, end
        at = end


def _bytes(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def band_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bands of at most PIECE_TEXTS texts, and the text of each."""
    key = _sorted(*shingle_hashes(texts))
    n = np.bincount((key >> _U(48)).astype(np.int64), minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    # Sums over neighbours name their set.
    sums = np.concatenate((np.zeros(1, dtype=_U), np.cumsum(mix(key & _U(2**48 - 1)), dtype=_U)))
    cells = np.bincount((key >> _U(48 - RANGE_BITS)).astype(np.int64), minlength=len(texts) << RANGE_BITS)
    beside = (np.cumsum(cells) - cells).reshape(len(texts), -1)
    bands, owners = [], []
    for least, below, rows, points in KINDS:
        mine = np.flatnonzero((n >= least) & (n < below))
        width = np.minimum(rows, n[mine])
        if not points:
            count = n[mine] - width + 1
            row = np.repeat(np.arange(len(mine)), count)
            at = np.arange(len(row)) + np.repeat(first[mine] - (np.cumsum(count) - count), count)
        else:
            at = np.minimum(beside[mine][:, (np.arange(points) << RANGE_BITS) // points], (first[mine] + n[mine] - width)[:, None])
            new = np.concatenate((np.ones((len(mine), 1), dtype=bool), at[:, 1:] != at[:, :-1]), axis=1)
            row, at = np.nonzero(new)[0], at[new]
        bands.append(mix(sums[at + width[row]] - sums[at] + _U(rows * 0x632BE59BD9B4E019 % 2**64)))
        owners.append(mine[row])
    return np.concatenate(bands).view(np.int64), np.concatenate(owners)


@lean
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key) to (part, blob): the bands and ids of many lines, by the first PART_BITS of the band.

    An entry is LOW_BYTES of the band and its id less the one before it; equal bytes of all entries lie together, so most compress to nothing.
    """
    worker_cache("lines")
    held, found = 0, []

    def flush() -> pa.RecordBatch:
        nonlocal held, found
        bands, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        held, found = 0, []
        bands = bands.view(_U)
        part = (bands >> _U(64 - PART_BITS)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        part, bands, ids = part[order], bands[order] >> _U(64 - PART_BITS - 8 * LOW_BYTES), ids[order]
        at = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
        step = ids.copy()
        step[1:] -= ids[:-1]
        step[at[:-1]] = ids[at[:-1]]
        low, step = bands.view(np.uint8).reshape(-1, 8)[:, :LOW_BYTES], step.view(np.uint8).reshape(-1, 8)
        blobs = [low[i:j].T.tobytes() + step[i:j].T.tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[at[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])

    for batch in batches:
        ids, keys = batch.column("id").to_numpy(), batch.column("key")
        for at, end in _runs(_bytes(keys)):
            bands, of = band_hashes(keys.slice(at, end - at))
            order = np.argsort(of, kind="stable")
            found.append((bands[order], ids[at + of[order]]))
            held += len(bands)
            if held >= FLUSH:
                yield flush()
    if held:
        yield flush()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // (LOW_BYTES + 8)
    data = np.frombuffer(blob, dtype=np.uint8)
    low = np.zeros((n, 8), dtype=np.uint8)
    low[:, :LOW_BYTES] = data[: n * LOW_BYTES].reshape(LOW_BYTES, n).T
    step = np.ascontiguousarray(data[n * LOW_BYTES :].reshape(8, n).T).view(np.int64)[:, 0]
    return low.view(_U)[:, 0], np.cumsum(step)


@lean
def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, blob) in order of part to (bucket, id, first): the ids of each bucket with several, but the one met first.

    FLUSH entries are sorted at a time. Of those before only the buckets of the last part and their first ids are kept, so a
    bucket of any size takes no more memory than one of two.
    """
    worker_cache("lines")
    none = np.empty(0, dtype=_U), np.empty(0, dtype=np.int64)
    kept, found, held = none, [], 0

    def look() -> pa.RecordBatch:
        nonlocal kept, found, held
        buckets, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        found, held = [], 0
        order = np.argsort(buckets, kind="stable")
        buckets, ids = buckets[order], ids[order]
        head = np.concatenate(([True], buckets[1:] != buckets[:-1]))
        names, firsts = buckets[head], ids[head]
        known = np.zeros(len(names), dtype=bool)
        if len(kept[0]):
            at = np.minimum(np.searchsorted(kept[0], names), len(kept[0]) - 1)
            known = kept[0][at] == names
            firsts[known] = kept[1][at[known]]
        first = firsts[np.cumsum(head) - 1]
        chosen = ids != first
        last = names[-1] >> _U(8 * LOW_BYTES)
        old = kept[0] >> _U(8 * LOW_BYTES) == last
        new = (names >> _U(8 * LOW_BYTES) == last) & ~known
        names, firsts = np.concatenate((kept[0][old], names[new])), np.concatenate((kept[1][old], firsts[new]))
        order = np.argsort(names)
        kept = names[order], firsts[order]
        return pa.RecordBatch.from_arrays([pa.array(buckets[chosen].view(np.int64)), pa.array(ids[chosen]), pa.array(first[chosen])], names=["bucket", "id", "first"])

    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
            low, ids = _unpack(blob.as_buffer())
            found.append((low | _U(part << 8 * LOW_BYTES), ids))
            held += len(ids)
            if held >= FLUSH:
                yield look()
    if held:
        yield look()


def sharing(lines: DataFrame) -> DataFrame:
    """Buckets of lines with bands in common, as :func:`link` takes them; ``lines``: (id, key), no nulls.

    Bands are dealt and sorted packed, many in a row: a row for each takes several times the time and disk.
    """
    packed = lines.select("id", "key").mapInArrow(_pack, "part int, blob binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(_share, "bucket long, id long, first long")


def _common(x: pa.Array, y: pa.Array, share: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each x, of each y, and of both, counting one in ``share`` of all hashes."""
    sides = []
    for texts in (x, y):
        h, of = shingle_hashes(texts)
        if share > 1:
            few = h < _U(2**64 // share)
            h, of = h[few], of[few]
        sides.append(_sorted(h, of))
    either = np.concatenate(sides)
    either.sort(kind="stable")
    both = either[1:][either[1:] == either[:-1]]
    return tuple(np.bincount((k >> _U(48)).astype(np.int64), minlength=len(x)) for k in (*sides, both))


def alike(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Whether each x and y have shingle sets of Jaccard similarity of at least 0.8."""
    least, of = SIMILAR
    most = sum(np.maximum(pc.utf8_length(t).to_numpy(zero_copy_only=False).astype(np.int64) - SHINGLE + 1, 1) for t in (x, y))
    # Pairs alike differ in a ninth of their sizes at most, all hashes told; many pairs differ in more among a few of the hashes already.
    a, b, both = _common(x, y, 4)
    out = (a + b - 2 * both) * of <= (of - 2 * least) * most
    left = np.flatnonzero(out)
    if len(left):
        a, b, both = _common(x.take(pa.array(left)), y.take(pa.array(left)))
        out[left] = of * both >= least * (a + b)
    return out


@lean
def _check_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, x, y) to the pairs whose texts x and y are alike."""
    worker_cache("lines")
    for batch in batches:
        x, y = (batch.column(c).cast(pa.large_string()) for c in ("x", "y"))
        for at, end in _runs(_bytes(x) + _bytes(y)):
            chosen = pa.array(alike(x.slice(at, end - at), y.slice(at, end - at)))
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, end - at).filter(chosen) for c in ("a", "b")], names=["a", "b"])


@lean
def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key) to (id, key, n, wide, c0, ...): how many distinct shingles a line has, its wide outline if it has one, and a bit for each range of their hashes, set if an odd number lies there."""
    worker_cache("lines")
    for batch in batches:
        keys = batch.column("key")
        for at, end in _runs(_bytes(keys)):
            key = _sorted(*shingle_hashes(keys.slice(at, end - at)))
            n = np.bincount((key >> _U(48)).astype(np.int64), minlength=end - at)
            column = (key >> _U(48 - OUTLINE_BITS + COLUMN_BITS)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1]))[: len(key)])
            odd = np.zeros((end - at) * len(_CELLS), dtype=_U)
            if len(key):
                odd[column[first]] = np.bitwise_xor.reduceat(_U(1) << (key >> _U(48 - OUTLINE_BITS) & _U((1 << COLUMN_BITS) - 1)), first)
            odd = odd.view(np.int64).reshape(end - at, -1)
            columns = [batch.column("id").slice(at, end - at), keys.slice(at, end - at), pa.array(n), pa.array(_wide(key, n), pa.binary()), *[pa.array(np.ascontiguousarray(c)) for c in odd.T]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "n", "wide", *_CELLS])


def _wide(key: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parities like an outline's, by the low bits of the hashes; empty for texts of fewer than WIDE shingles."""
    end, low = np.cumsum(n), key & _U(2**32 - 1)
    out = [b""] * len(n)
    for i in np.flatnonzero(n >= WIDE).tolist():
        ranges = 1 << int(n[i] - 1).bit_length()
        odd = np.bincount((low[end[i] - n[i] : end[i]] & _U(ranges - 1)).astype(np.int64), minlength=ranges) & 1
        out[i] = np.packbits(odd.astype(bool), bitorder="little").tobytes()
    return out


def _apart(x: bytes, y: bytes) -> int:
    """In how many ranges the parities of two wide outlines differ; the wider is folded to the ranges of the other."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    bits, few = 8 * max(len(x), len(y)), 8 * min(len(x), len(y))
    if len(x) < len(y):
        a, b = b, a
    while bits > few:
        bits //= 2
        a = (a >> bits) ^ (a & ((1 << bits) - 1))
    return (a ^ b).bit_count()


@lean
def _check_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n, x, y) to the pairs that can be alike by their wide outlines x and y; n: the sizes of the two."""
    worker_cache("lines")
    least, of = SIMILAR
    for batch in batches:
        sides = (batch.column(c).to_pylist() for c in ("n", "x", "y"))
        chosen = pa.array([not x or not y or of * _apart(x, y) <= (of - 2 * least) * n for n, x, y in zip(*sides, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(chosen) for c in ("a", "b")], names=["a", "b"])


def _sliced(pairs: DataFrame, step: Callable[[DataFrame], DataFrame], scratch: list[DataFrame]) -> DataFrame:
    """``step`` of written pairs (a, b), SLICE at a time, each written before the next; what is written is added to ``scratch``.

    As the pairs' number is known, few of them are sent to the texts, not the texts to them.
    """
    spark = pairs.sparkSession
    pairs = staged(pairs.select("a", "b"), "pairs", spark)
    many = max(1, -(-pairs.count() // SLICE))
    parts = [staged(step(pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(many)) == k) if many > 1 else pairs), "links", spark) for k in range(many)]
    forget(pairs)
    scratch.extend(parts)
    return functools.reduce(DataFrame.union, parts)


_CELLS = [f"c{i}" for i in range(1 << OUTLINE_BITS - COLUMN_BITS)]


def _checker(texts: DataFrame, scratch: list[DataFrame] | None = None):
    """From pairs (a, b) of line ids, those that are alike; ``texts``: as :func:`_outline` gives them. Tables written are added to ``scratch``.

    Lines differ in a shingle at least in each range of which one holds an odd number and the other an even one. Pairs whose sizes
    differ in more than a ninth of their sum, or that differ in more ranges, cannot be alike, so their texts stay where they are.
    Long lines are held to their wide outlines next, an eighth of a text's size.
    """
    scratch = [] if scratch is None else scratch
    least, of = SIMILAR
    apart = " + ".join(f"bit_count(a{c} ^ b{c})" for c in _CELLS)
    may_be = f"{of} * greatest(abs(an - bn), {apart}) <= {of - 2 * least} * (an + bn)"
    sides = [texts.select(F.col("id").alias(x), F.col("n").alias(f"{x}n"), *[F.col(c).alias(f"{x}{c}") for c in _CELLS]) for x in ("a", "b")]

    def beside(close: DataFrame, what: str) -> DataFrame:
        x, y = (texts.select(F.col("id").alias(i), F.col("n").alias(f"{i}n"), F.col(what).alias(side)) for i, side in (("a", "x"), ("b", "y")))
        return close.join(x, "a").join(y, "b")

    def wide(close: DataFrame) -> DataFrame:
        return beside(close, "wide").select("a", "b", (F.col("an") + F.col("bn")).alias("n"), "x", "y").mapInArrow(_check_wide, "a long, b long")

    def whole(close: DataFrame) -> DataFrame:
        return beside(close, "key").select("a", "b", "x", "y").mapInArrow(_check_lines, "a long, b long")

    def compare(close: DataFrame) -> DataFrame:
        return _sliced(_sliced(close, wide, scratch), whole, scratch)

    def check(pairs: DataFrame) -> DataFrame:
        return compare(pairs.join(sides[0], "a").join(sides[1], "b").where(may_be).select("a", "b"))

    check.traits, check.may_be, check.sure, check.many = texts.select("id", "n", *_CELLS), may_be, whole, compare
    return check


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1) -> DataFrame:
    """One row per line: doc_id, line_no, class_doc, class_line, kept.

    The class of a line is the first line (by document, then line) of its
    component; that line alone is kept. Blank lines, and lines of fewer than
    ``min_words`` words, are classes of their own. Null ids sort first. Equal
    rows of ``docs`` repeat their lines; the copies at the same position share
    the verdict of that position. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    lines = split_lines(docs, min_words=min_words)
    at = F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("decimal(19,0)") * F.lit(_STEP).cast("decimal(11,0)") + F.col("line_no").cast("decimal(10,0)")
    at = at.cast("decimal(31,0)")
    every = lines.select("doc_id", "line_no", *[F.when(F.col("key").isNotNull(), F.xxhash64(F.lit(i), "key")).alias(f"h{i}") for i in (1, 2)], "key")
    # 128 bits name a line.
    distinct = every.where("key is not null").groupBy("h1", "h2", "key").agg(F.min(at).alias("at"), F.count("*").alias("n"))
    table = staged(distinct.select(F.monotonically_increasing_id().alias("lid"), "h1", "h2", "at", "n", "key"), "lines", spark)
    texts = table.select(F.col("lid").alias("id"), "key")
    kept_texts = []

    def checker(ids: DataFrame):
        outlined = texts.join(ids, "id", "left_semi").mapInArrow(_outline, "id long, key string, n long, wide binary, " + ", ".join(f"{c} long" for c in _CELLS))
        kept_texts.append(staged(outlined, "texts", spark))
        return _checker(kept_texts[0], kept_texts)

    found = link(staged(sharing(texts), "members", spark), checker)
    for t in kept_texts:
        forget(t)
    # Only lines that occur twice or are linked can lose an occurrence.
    heads = table.join(found.withColumnRenamed("node", "lid"), "lid", "left").where("n > 1 or root is not null")
    heads = heads.select("h1", "h2", "at", F.coalesce("root", "lid").alias("root"))
    first = heads.groupBy("root").agg(F.min("at").alias("class_at"))
    heads = staged(heads.join(first, "root").select("h1", "h2", "class_at"), "heads", spark)
    forget(table)
    out = every.drop("key").join(heads, ["h1", "h2"], "left").withColumn("at", at).withColumn("class_at", F.coalesce("class_at", "at"))
    class_doc = F.floor(F.col("class_at") / F.lit(_STEP).cast("decimal(11,0)")).cast("decimal(20,0)")
    return out.select(
        "doc_id",
        "line_no",
        F.when(class_doc != -(2**63), class_doc.cast("long")).alias("class_doc"),
        F.when(F.col("class_at") == F.col("at"), F.col("line_no")).otherwise((F.col("class_at") - class_doc * F.lit(_STEP).cast("decimal(11,0)")).cast("int")).alias("class_line"),
        (F.col("class_at") == F.col("at")).alias("kept"),
    )


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1) -> DataFrame:
    """``docs`` without the lines that are not kept; columns stay as they are.

    A document whose every line with words is a copy of lines elsewhere is
    dropped; one that lost no line is unchanged, whatever its text.
    ``id_col`` must identify rows: copies of an id share its first row's verdict.
    """
    spark = docs.sparkSession
    lost = classify(docs, id_col, text_col, min_words).where("not kept").select("doc_id", "line_no")
    names = set(docs.columns)
    mine, gone = (next(f"{x}{i}" for i in range(len(names) + 1) if f"{x}{i}" not in names) for x in ("lost_id_", "lost_lines_"))
    lost = staged(lost.groupBy(F.col("doc_id").alias(mine)).agg(F.collect_set("line_no").alias(gone)), "lost", spark)
    kept = docs.join(lost, F.col(f"`{id_col}`").eqNullSafe(F.col(mine)), "left")
    kept = kept.withColumn(mine, fenced(F.when(F.col(gone).isNotNull(), F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n", -1))))
    rest = F.array_join(F.expr(f"transform(array_except(sequence(0, size({mine}) - 1), {gone}), i -> get({mine}, i))"), "\n")
    kept = kept.withColumn(mine, fenced(F.when(F.col(gone).isNotNull(), rest))).where(F.col(gone).isNull() | F.col(mine).rlike(r"\S"))
    return kept.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(f"`{text_col}`")).otherwise(F.col(mine))).select(*[F.col(f"`{c}`") for c in docs.columns])
