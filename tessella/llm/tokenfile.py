"""A file format of token ids: documents in order, ids in compressed blocks.

A file is a table of segments. A segment is a run of whole documents: how many
ids the file holds before it, the documents' ids and lengths, and one or more
blocks of :mod:`tessella.llm.idcoder`, each with its own model and checksum.
Any segment can be read alone. Files are ranges of the document ids and are
numbered in order; where each begins follows from their totals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import lean
from tessella.llm.idcoder import BLOCK_IDS, decode_block, encode_block
from tessella.llm.tokenize import tokenizer

SEGMENT_SCHEMA = "file int, segment int, start long, n_ids long, doc_ids array<long>, n_tokens array<long>, blocks binary"
BATCH_CHARS = 1 << 21


def write(docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Tokenize every whole text (null: empty), append ``end_id``, and write all ids in ascending order of document id.

    Null ids come first; rows that repeat an id follow each other in order of
    text. Files are dealt by range, so their sizes follow the number of
    documents; a task holds one segment of ids at a time.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, number = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4")
        keys, docs_ids, held, start, segment = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, start, segment
            ids = np.concatenate(docs_ids)
            blocks = b"".join(encode_block(ids[i : i + BLOCK_IDS], vocabulary) for i in range(0, len(ids), BLOCK_IDS))
            row = {"file": number, "segment": segment, "start": start, "n_ids": len(ids), "doc_ids": list(keys), "n_tokens": [len(x) for x in docs_ids], "blocks": blocks}
            keys.clear(), docs_ids.clear()
            start, segment, held = start + len(ids), segment + 1, 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("file", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("blocks", pa.binary())])
        for batch in batches:
            names, texts, at = batch.column(0).to_pylist(), batch.column(1), 0
            while at < len(names):
                part, size = [], 0
                while at + len(part) < len(names) and (not part or size < BATCH_CHARS):
                    part.append(texts[at + len(part)].as_py() or "")
                    size += len(part[-1])
                for key, ids in zip(names[at : at + len(part)], t.encode(part), strict=True):
                    keys.append(key)
                    docs_ids.append(np.concatenate((ids, end)))
                    held += len(ids) + 1
                    if held >= BLOCK_IDS:
                        yield flush()
                at += len(part)
        if docs_ids:
            yield flush()

    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    n = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    dealt.mapInArrow(run, SEGMENT_SCHEMA).write.parquet(path)


def _decode(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, at, found = [], 0, 0
            while found < row["n_ids"]:
                part, at = decode_block(row["blocks"], at)
                ids.append(part)
                found += len(part)
            yield make(row, np.concatenate(ids))


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files; start counts the ids of all documents before.

    Without ``with_ids`` the ids are decoded and summed, but stay in the worker.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    # One row per file: as many as there were writing tasks.
    totals = sorted((r.file, r.n) for r in segments.groupBy("file").agg(F.sum("n_ids").alias("n")).collect())
    base, bases = 0, {}
    for file, n in totals:
        bases[file], base = base, base + n

    def make(row: dict, ids: np.ndarray) -> pa.RecordBatch:
        lengths = np.asarray(row["n_tokens"], dtype=np.int64)
        ends = np.cumsum(lengths)
        parts = [ids[e - n : e] for e, n in zip(ends, lengths, strict=True)]
        starts = bases[row["file"]] + row["start"] + ends - lengths
        columns = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(starts), "n_tokens": pa.array(lengths), "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())}
        if with_ids:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return segments.mapInArrow(lean(lambda batches: _decode(batches, make)), schema)
