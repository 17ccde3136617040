"""WARC records and Merkle audits of their fixity.

A file of records is hashed record by record. Leaves are hashed together by
ordered ranges of offsets, ranges by groups of neighbours, up to one root per
file and one for the collection. Replicas whose roots agree need no further
look; otherwise only branches that mismatch are followed, level by level, down
to the records that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import forget, staged

#: Bytes of an offset range, children of an inner node, and records of a file.
RANGE_BYTES, FANOUT, FILE_RECORDS = 1 << 16, 16, 2048
_NO_FILE = -(2**62)
_VERSION, _END = "WARC/1.0\r\n", "\r\n\r\n"


def record(url: Column, body: Column) -> Column:
    """A WARC/1.0 resource record as text; null parts are empty."""
    payload = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "))
    return F.concat(head, F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def leaves(records: DataFrame, id_col: str, record_col: str = "record") -> DataFrame:
    """(file, id, offset, size, hash) of every record.

    Records lie in files by runs of FILE_RECORDS consecutive ids, in order of
    id, then hash; offsets count bytes within the file. A file's records are
    bounded in number, so the window that sums offsets is too, except for
    records that repeat one id. Null ids and null records take no part.
    """
    rows = records.where(F.col(id_col).isNotNull() & F.col(record_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.octet_length(record_col).cast("long").alias("size"), F.sha2(record_col, 256).alias("hash"))
    rows = rows.withColumn("file", F.floor(F.col("id") / F.lit(FILE_RECORDS)))
    before = Window.partitionBy("file").orderBy("id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file", "id", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), "size", "hash")


def _shape(*sides: DataFrame) -> tuple[int, int, int]:
    """Nodes of offset ranges in the largest file, first file, and number of files, over all replicas."""
    both = sides[0]
    for x in sides[1:]:
        both = both.union(x)
    most, last, first = both.agg(F.max("offset"), F.max("file"), F.min("file")).first()
    return (most or 0) // RANGE_BYTES + 1, first or 0, (last or 0) - (first or 0) + 1


def tree(leaf_rows: DataFrame, shape: tuple[int, int, int] | None = None) -> list[DataFrame]:
    """Levels of the tree, from offset ranges to one node per file and on to the one root of the collection: (level, file, node, hash) each.

    Level 0 nodes hash the ordered leaves that begin in one range of offsets,
    with their offsets; upper nodes hash FANOUT neighbours. File roots become
    the children of collection nodes (file null). Groups are bounded by the
    range and the fan-out. With one ``shape`` trees of replicas have the same
    levels, whatever a replica lacks. Every level is a written table
    (``staged_at``), so the plan of one does not hold those of all below it.
    """
    nodes, first, files = shape or _shape(leaf_rows)

    def fold(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "hash"))), lambda x: F.concat_ws(":", *[x[c].cast("string") for c in order], x["hash"])), ",")
        return df.groupBy(*keys).agg(F.sha2(joined, 256).alias("hash"))

    def above(level: DataFrame) -> DataFrame:
        return staged(fold(level.withColumnRenamed("node", "child").withColumn("node", F.floor(F.col("child") / F.lit(FANOUT))), ["file", "node"], ["child"]), "level")

    level = staged(fold(leaf_rows.withColumn("node", F.floor(F.col("offset") / F.lit(RANGE_BYTES))), ["file", "node"], ["offset"]), "ranges")
    levels = [level]
    while nodes > 1:
        level = above(level)
        levels.append(level)
        nodes = -(-nodes // FANOUT)
    level = staged(level.select(F.lit(None).cast("long").alias("file"), (F.col("file") - F.lit(first)).alias("node"), "hash"), "files")
    levels.append(level)
    while files > 1:
        level = above(level)
        levels.append(level)
        files = -(-files // FANOUT)
    out = [x.select(F.lit(i).alias("level"), "file", "node", "hash") for i, x in enumerate(levels)]
    for x, level in zip(out, levels, strict=True):
        x.staged_at = level.staged_at
    return out


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records that differ between two replicas, both from :func:`leaves`.

    (id, file, offset, size, expected, found): offset and size are those of the
    left replica, or of the right where the left lacks the record; ``expected``
    or ``found`` is null where a replica lacks the record. The collection's
    roots are compared first; a level is joined with the mismatching nodes
    above it, so equal branches are never opened. Of records that share an id,
    those with equal hashes go together and only the others count, one for one
    in order of hash. Replicas that agree give no rows; an empty replica lacks all records.
    """
    spark = left.sparkSession
    left, right = staged(left, "left", spark), staged(right, "right", spark)
    shape = _shape(left, right)
    a, b = tree(left, shape), tree(right, shape)

    def mismatches(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = (t.select(F.coalesce("file", F.lit(_NO_FILE)).alias("file"), "node", "hash") for t in (x, y))
        return x.join(y.withColumnRenamed("hash", "other"), ["file", "node"], "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node")

    # Nodes of the collection have no file; the lowest of its levels holds the files' roots.
    first, collection = shape[1], _levels(shape[0])
    nodes = staged(mismatches(a[-1], b[-1]), "nodes", spark)
    used = [left, right, *a, *b, nodes]
    for i in range(len(a) - 2, -1, -1):
        if i + 1 == collection:
            within, parent = nodes.select((F.col("node") + F.lit(first)).alias("file"), F.lit(0).cast("long").alias("parent")), F.lit(0).cast("long")
        else:
            within, parent = nodes.select("file", F.col("node").alias("parent")), F.floor(F.col("node") / F.lit(FANOUT))
        below = [t.withColumn("file", F.coalesce("file", F.lit(_NO_FILE))).withColumn("parent", parent).join(within, ["file", "parent"], "left_semi").drop("parent") for t in (a[i], b[i])]
        nodes = staged(mismatches(*below), "nodes", spark)
        used.append(nodes)
    keys = nodes.distinct()
    x, y = (t.withColumn("node", F.floor(F.col("offset") / F.lit(RANGE_BYTES))).join(keys, ["file", "node"], "left_semi").drop("node") for t in (left, right))
    same = Window.partitionBy("file", "id", "hash").orderBy("offset")
    x, y = (t.withColumn("nth", F.row_number().over(same)) for t in (x, y))
    y = y.select("file", "id", "hash", "nth", F.col("offset").alias("o2"), F.col("size").alias("s2"))
    alone = staged(x.join(y, ["file", "id", "hash", "nth"], "full").where("size is null or s2 is null"), "alone", spark)
    for t in used:
        forget(t)
    turn = Window.partitionBy("file", "id").orderBy("hash", "nth")
    lacking, extra = alone.where("s2 is null").withColumn("turn", F.row_number().over(turn)), alone.where("size is null").withColumn("turn", F.row_number().over(turn))
    lacking = lacking.select("file", "id", "turn", F.col("hash").alias("expected"), "offset", "size")
    both = lacking.join(extra.select("file", "id", "turn", F.col("hash").alias("found"), "o2", "s2"), ["file", "id", "turn"], "full")
    return both.select("id", "file", F.coalesce("offset", "o2").alias("offset"), F.coalesce("size", "s2").alias("size"), "expected", "found")


def _levels(nodes: int) -> int:
    """Levels of a file's tree over so many offset ranges."""
    n = 1
    while nodes > 1:
        nodes, n = -(-nodes // FANOUT), n + 1
    return n


def write_files(records: DataFrame, path: str, record_col: str = "record") -> None:
    """Write records from :func:`record` as gzipped WARC files, one per partition; null records are left out."""
    record = F.col(f"`{record_col}`")
    body = F.left(record, F.length(record) - 4)  # the line separator closes a record
    records.where(record.isNotNull()).select(body.alias("value")).write.option("lineSep", _END).option("compression", "gzip").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, type, size, body, whole, record) of the records of WARC files, gzipped or plain.

    ``whole`` says that the body has the length its header declares: records
    that were cut, or whose body itself holds a version line, are not whole.
    Splitting at version lines keeps one record in memory, not one file.
    """
    rows = spark.read.option("lineSep", _VERSION).text(path).where(F.length("value") > 0)
    head, rest = F.substring_index("value", _END, 1), F.substr("value", F.instr("value", _END) + 4)
    named = lambda n: F.trim(F.regexp_extract(head, rf"(?im)^{n}:([^\r\n]*)", 1))
    rows = rows.select(named("WARC-Target-URI").alias("url"), named("WARC-Type").alias("type"), named("Content-Length").try_cast("long").alias("size"), rest.alias("rest"), F.concat(F.lit(_VERSION), "value").alias("record"))
    ended = F.col("rest").endswith(_END)
    rows = rows.withColumn("body", F.when(ended, F.left("rest", F.length("rest") - 4)).otherwise(F.col("rest")))
    return rows.select("url", "type", "size", "body", F.coalesce((F.octet_length("body") == F.col("size")) & ended, F.lit(False)).alias("whole"), "record")


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A replica of ``pages`` with one byte changed in a fixed 1 % of the records, for drills: sizes stay."""
    hit = (F.col("page_id") % 101 == 7) & (F.length("html") > 0)
    return pages.withColumn("html", F.when(hit, F.overlay("html", F.lit("~"), F.lit(1), F.lit(1))).otherwise(F.col("html")))


def drill(pages: DataFrame) -> DataFrame:
    """Audit ``pages`` against :func:`damaged_copy`: the located records."""
    sides = [leaves(p.select("page_id", record(F.col("url"), F.col("html")).alias("record")), "page_id") for p in (pages, damaged_copy(pages))]
    return audit(*sides).withColumnRenamed("id", "page_id")


ORACLE_SQL = f"""
with p as (
  select page_id, floor(page_id / {FILE_RECORDS}.0)::bigint file, coalesce(url, '') url, coalesce(html, '') html,
    case when length(html) > 0 then '~' || html[2:] else coalesce(html, '') end bad from pages where page_id is not null),
r as (
  select *, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' h, chr(13) || chr(10) || chr(13) || chr(10) e from p),
t as (select page_id, file, html, bad, h || strlen(html) || e || html || e rec, h || strlen(bad) || e || bad || e other from r),
o as (select *, coalesce(sum(strlen(rec)) over (partition by file order by page_id rows between unbounded preceding and 1 preceding), 0)::bigint as "offset", strlen(rec)::bigint size from t)
select page_id, file, "offset", size, sha256(rec) expected, sha256(other) found from o where rec <> other and page_id % 101 = 7"""
