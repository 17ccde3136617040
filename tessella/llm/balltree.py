"""Exact top-k by inner product: ball trees per shard, branch and bound.

A task cuts its rows into shards of bounded size and builds a ball tree over
each. A query visits nodes in order of the largest inner product their ball
allows and stops at the first that cannot beat its current k-th score, which it
carries from shard to shard. Tasks return k rows per query, of which the best k
are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a leaf and of a shard; queries of a block, whose vectors are sent to all tasks.
LEAF, SHARD, BLOCK = 64, 65536, 4096


class BallTree:
    """A tree over integer vectors (n, d) with their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        self.nodes: list[tuple] = []  # center, radius, left or None, right, begin, end
        points = vectors.astype(np.float64)

        def build(begin: int, end: int) -> int:
            part = points[order[begin:end]]
            center = part.mean(0)
            radius = float(np.sqrt(((part - center) ** 2).sum(1).max()))
            me = len(self.nodes)
            self.nodes.append(None)
            left = right = None
            if end - begin > LEAF and radius > 0:
                axis = int(np.argmax(part.var(0)))
                middle = (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(part[:, axis], middle)]
                left, right = build(begin, begin + middle), build(begin + middle, end)
            self.nodes[me] = (left, right, begin, end)
            self.centers.append((me, center, radius))
            return me

        self.centers: list = []
        build(0, len(ids))
        self.centers.sort(key=lambda x: x[0])
        self.center = np.stack([c for _, c, _ in self.centers])
        self.radius = np.array([r for _, _, r in self.centers])
        del self.centers
        self.ids, self.vectors = ids[order], vectors[order]
        self.points = self.vectors.astype(np.float64)
        # Inner products below 2**53 are exact in floating point.
        self.exact = float(np.abs(self.points).max(initial=0)) if len(ids) else 0.0

    def search(self, query: np.ndarray, query_id: int, k: int, best: list[tuple[int, int]]) -> None:
        """Improve ``best``, a heap of (score, -id) of at most k rows other than the query's own."""
        q = query.astype(np.float64)
        norm = float(np.sqrt(q @ q))
        bounds = self.center @ q + self.radius * norm
        bounds += 1e-9 * (np.abs(bounds) + self.radius * norm + 1)
        wide = self.exact * float(np.abs(q).max(initial=0)) * len(q) >= 2**53
        queue = [(-bounds[0], 0)]
        while queue:
            bound, at = heapq.heappop(queue)
            if len(best) == k and -bound < best[0][0]:
                return
            left, right, begin, end = self.nodes[at]
            if left is not None:
                heapq.heappush(queue, (-bounds[left], left))
                heapq.heappush(queue, (-bounds[right], right))
                continue
            scores = self.vectors[begin:end] @ query if wide else (self.points[begin:end] @ q).astype(np.int64)
            for i in np.flatnonzero(scores >= best[0][0]) if len(best) == k else range(end - begin):
                row = int(self.ids[begin + i])
                if row == query_id:
                    continue
                item = (int(scores[i]), -row)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)


def quantized(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): floor(256 * x) of every component, without vectors that are null or hold null, NaN or infinite components."""
    x = F.col(vector_col)
    whole = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(F.coalesce(whole, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * 256)).alias("v"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query's k best candidates, ties to the smaller id.

    Both tables are (id, v) as :func:`quantized` makes them. A candidate with
    the query's id or another length is not compared; equal query ids are asked
    once; candidates that repeat an id count each. Queries are taken to the
    driver in blocks of BLOCK, and each block is one pass over the candidates.
    """
    found = None
    block: list = []

    def ask(block: list) -> DataFrame:
        lengths: dict[int, list] = {}
        for r in block:
            lengths.setdefault(len(r.v), []).append(r)
        asked = {n: (np.array([r.id for r in rows]), np.array([r.v for r in rows], dtype=np.int64).reshape(len(rows), n)) for n, rows in lengths.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, list] = {int(i): [] for ids, _ in asked.values() for i in ids}
            held: dict[int, tuple[list, list, int]] = {}

            def settle(n: int) -> None:
                ids, flat, _ = held.pop(n)
                tree = BallTree(np.concatenate(ids), np.concatenate(flat))
                for query_id, q in zip(*asked[n], strict=True):
                    tree.search(q, int(query_id), k, best[int(query_id)])

            for batch in batches:
                sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                ids = batch.column(0).to_numpy()
                for n in np.unique(sizes):
                    if int(n) not in asked:
                        continue
                    rows = np.flatnonzero(sizes == n)
                    values = batch.column(1).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), n)
                    for at in range(0, len(rows), SHARD):
                        part = held.setdefault(int(n), ([], [], 0))
                        part[0].append(ids[rows[at : at + SHARD]])
                        part[1].append(values[at : at + SHARD])
                        held[int(n)] = (part[0], part[1], part[2] + len(part[0][-1]))
                        if held[int(n)][2] >= SHARD:
                            settle(int(n))
            for n in list(held):
                settle(n)
            out = [(q, -i, s) for q, rows in best.items() for s, i in rows]
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

        return candidates.mapInArrow(run, "query_id long, vec_id long, score long")

    for row in queries.dropDuplicates(["id"]).toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            found, block = ask(block) if found is None else found.union(ask(block)), []
    if block or found is None:
        found = ask(block) if found is None else found.union(ask(block))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""
