"""Helpers the training-data operators share: tables, the shared folder, connected components."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.shared import shared_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_CACHES: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What ``owner`` keeps in this Python worker between tasks. Asking for it empties what other operators left."""
    for other, held in _CACHES.items():
        if other != owner:
            held.clear()
    return _CACHES.setdefault(owner, {})


def lean(run: Callable) -> Callable:
    """A function over Arrow batches, after which its worker gives freed memory back to the machine.

    Spark keeps workers for later tasks, and allocators keep what was freed: idle workers then hold the peaks of tasks
    long over, beside the executor and whatever runs in it next.
    """

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    """Return freed memory to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fenced(value: Column) -> Column:
    """``value``, computed where it is written.

    Spark pushes a later filter below a projection by copying the projection's
    expressions into it, which repeats costly array work inside lambdas. It
    leaves non-deterministic projections alone; the condition is always true.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of any executor without
    repeating what went before, and Spark learns the table's true size.
    """
    spark = spark or df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # shuffle files serve this write alone
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a table from :func:`staged` that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph, by distributed union-find.

    ``edges`` holds long pairs. Returns (node, root) for every node that has an
    edge to another node; root is the smallest id of the component. Null ends
    and loops are ignored; repeated edges are harmless; no edges give no rows.

    Alternating large-star and small-star steps rewire every node to the
    smallest neighbour until nothing changes. Each step is one partially
    aggregated minimum and one join that adaptive execution can split, so a
    hub of any degree never has to fit in one task. Every round's edges are
    written to the shared folder.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct()
    now = staged(pairs, "cc", spark)
    before = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of u goes to the smallest of u and its neighbours.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e")).select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct()
        after = staged(small, "cc", spark)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(now)
        now = after
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


#: Turns of stars, each around fresh centers, before members of different components are compared pair by pair.
STAR_TURNS = 3


def shared(bands: DataFrame) -> DataFrame:
    """Members of the buckets with several ids, but their smallest: (bucket, id, first), written.

    ``bands``: (bucket, id), both long. Buckets are never gathered: the smallest
    id is a partially aggregated minimum, joined to the members by a join that
    adaptive execution can split.
    """
    spark = bands.sparkSession
    ends = bands.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    ends = staged(ends, "ends", spark)  # its shuffle is gone before that of the members
    members = staged(bands.join(ends, "bucket").where("id <> first"), "members", spark)
    forget(ends)
    return members


def link(members: DataFrame, checker: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Classes of near-duplicates from buckets of candidates.

    ``members``: (bucket, id, first), all long, a written table that is deleted
    here: the ids of each bucket with several, but one of them, ``first``. ``checker`` takes the ids (id) that share a bucket with others
    and gives a function from distinct pairs (a, b) of them to the pairs that
    are similar enough, so it can fetch what it compares once. The function may bear ``traits``, a table (id, ...), and
    ``may_be``, a condition on that table's columns, named with a or b before, which every pair similar enough meets: others
    are then dropped where they arise, not dealt first; ``sure``, the function for pairs that meet it, and ``many``, that for any number of them. Returns (node, root) as :func:`components` does.

    Each member is compared with its bucket's first. Where that leaves a bucket in several components,
    fresh centers serve, STAR_TURNS turns at most, for the members of other
    components; what is then still apart is compared pair by pair, members of
    different components only, so no link is lost.
    """
    spark = members.sparkSession
    verify = checker(members.select("id").union(members.select("first")).distinct())
    stars = members.select(F.least("first", "id").alias("a"), F.greatest("first", "id").alias("b")).distinct()
    good = staged(verify(stars).select("a", "b"), "links", spark)
    found = components(good)
    # What a center has been compared with needs no further look at it, so it leaves its bucket.
    rest = members.drop("first")
    left = None
    for turn in range(STAR_TURNS):
        of = rest.join(found.select(F.col("node").alias("id"), "root"), "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
        torn = of.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
        before, left = left, staged(of.join(torn, "bucket"), "torn", spark)
        if before is not None:
            forget(before)
        if turn == STAR_TURNS - 1 or left.isEmpty():
            break
        centers = left.groupBy("bucket").agg(F.min("id").alias("a"), F.min_by("root", "id").alias("center_root"))
        around = left.join(centers, "bucket")
        news = staged(verify(around.where("root <> center_root").select("a", F.col("id").alias("b")).distinct()).select("a", "b"), "links", spark)
        if not news.isEmpty():
            more = staged(good.union(news).distinct(), "links", spark)
            forget(good)
            good, found = more, components(more)
        forget(news)
        rest = around.where("id > a").select("bucket", "id")
    marked = left.join(verify.traits, "id") if hasattr(verify, "traits") else left
    of = [c for c in marked.columns if c not in ("bucket", "id", "root")]
    x, y = (marked.select("bucket", F.col("id").alias(side), F.col("root").alias(f"r{side}"), *[F.col(c).alias(f"{side}{c}") for c in of]) for side in ("a", "b"))
    apart = x.join(y, "bucket").where("ra <> rb and a < b").where(getattr(verify, "may_be", "true"))
    # What ``may_be`` let through here needs no second look at the traits.
    verify = getattr(verify, "many", getattr(verify, "sure", verify))
    more = staged(verify(apart.select("a", "b").distinct()).select("a", "b"), "links", spark)
    if not more.isEmpty():
        found = components(good.union(more))
    for table in (members, left, good, more):
        forget(table)
    return found
