"""Chunking documents for retrieval."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "doc_id long, idx int, chunk string, heading string, start_char int, end_char int"


def sentences(docs: DataFrame, per_chunk: int = 5) -> DataFrame:
    """Chunks of ``per_chunk`` sentences joined by a space, JVM-side."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+"), lambda s: s != "")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / per_chunk).cast("int")), lambda i: F.array_join(F.slice("s", i * per_chunk + 1, per_chunk), " "))
    return docs.withColumn("s", parts).where(F.size("s") > 0).select("doc_id", F.posexplode(groups).alias("idx", "chunk"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """Non-blank lines as chunks."""
    return docs.select("doc_id", F.posexplode(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n+"), lambda x: F.trim(x)), lambda x: x != "")).alias("idx", "chunk"))


def by_regex(docs: DataFrame, pattern: str) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), pattern, -1), lambda x: F.trim(x) != "")).alias("idx", "chunk"))


def linked(chunks: DataFrame) -> DataFrame:
    """With chunk ids and those of the neighbours."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    name = F.format_string("chunk_%04d", F.col("idx"))
    c = chunks.withColumn("chunk_id", name)
    return c.withColumn("prev_id", F.lag("chunk_id").over(w)).withColumn("next_id", F.lead("chunk_id").over(w))


def stats(chunks: DataFrame) -> DataFrame:
    tokens = F.greatest(F.lit(1), F.floor(F.length("chunk") / 4).cast("int"))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(tokens).alias("total_tokens"), F.round(F.avg(tokens), 6).alias("avg_tokens"), F.max(tokens).alias("max_tokens"), F.min(tokens).alias("min_tokens"))


def _split_oversized(text: str, most: int, overlap: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(text):
        end = min(at + most, len(text))
        if end < len(text):
            for mark in ("\n\n", "\n", " "):
                cut = text.rfind(mark, at + most // 2, end)
                if cut > at:
                    end = cut
                    break
        yield at, end
        if end >= len(text):
            return
        at = max(end - overlap, at + 1)


def _markdown_sections(text: str) -> list[tuple[str, int, int]]:
    marks = [(m.start(), m[1].strip()) for m in re.finditer(r"(?m)^#{1,6}\s+(.+)$", text)]
    edges = ([(0, "")] if not marks or marks[0][0] else []) + marks
    ends = [m for m, _ in edges[1:]] + [len(text)]
    return [(h, a, b) for (a, h), b in zip(edges, ends, strict=True) if text[a:b].strip()]


def sized(docs: DataFrame, strategy: str = "topic", most: int = 1000, overlap: int = 200, least: int = 50) -> DataFrame:
    """Chunks of at most ``most`` characters (columns of SCHEMA): ``topic`` by headings, ``fixed`` by paragraphs.

    Small pieces are merged forward, large ones split at the best break with an
    overlap of at most half a chunk. Texts that are null or blank give no rows.
    """
    overlap = min(overlap, most // 2)

    def chunk(text: str):
        if strategy == "topic":
            parts = _markdown_sections(text)
        else:
            parts = [("", m.start(), m.end()) for m in re.finditer(r"(?s)\S.*?(?=\n{2,}|\Z)", text)]
        merged: list = []
        for h, a, b in parts:
            if merged and (merged[-1][2] - merged[-1][1] < least or (strategy != "topic" and b - merged[-1][1] <= most)):
                merged[-1] = (merged[-1][0] or h, merged[-1][1], b)
            else:
                merged.append((h, a, b))
        for h, a, b in merged:
            for x, y in _split_oversized(text[a:b], most, overlap) if b - a > most else [(0, b - a)]:
                yield h, a + x, a + y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py() or ""
                rows = [(key, i, t[a:b], h, a, b) for i, (h, a, b) in enumerate(chunk(t))] if t.strip() else []
                if rows:
                    cols = list(zip(*rows, strict=True))
                    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t_) for c, t_ in zip(cols, types, strict=True)], names=["doc_id", "idx", "chunk", "heading", "start_char", "end_char"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
