"""Link-graph traversal, robots rules, sitemaps, URL patterns and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import url as U
from tessella.shared import use_shared_checkpoints


def bfs_levels(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): level-synchronous breadth-first traversal of edges(src, dst) from seeds(node).

    Each level is one join and one anti join against what was seen, and is
    checkpointed to the shared folder where the session names one.
    """
    spark = edges.sparkSession
    use_shared_checkpoints(spark)
    seen = frontier = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        frontier = edges.join(frontier, edges.src == frontier.node).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def best_first(edges: DataFrame, seeds: DataFrame, scores: DataFrame, budget: int, batch: int = 10) -> DataFrame:
    """(node, step): repeatedly visit the ``batch`` best unvisited nodes of the frontier, at most ``budget`` in all."""
    spark = edges.sparkSession
    use_shared_checkpoints(spark)
    visited, frontier, step = None, seeds.select("node").distinct(), 0
    while step * batch < budget:
        take = frontier.join(scores, "node", "left").orderBy(F.desc_nulls_last("score"), "node").limit(min(batch, budget - step * batch)).select("node", F.lit(step).alias("step")).checkpoint()
        if take.isEmpty():
            break
        visited = take if visited is None else visited.union(take)
        frontier = frontier.union(edges.join(take, edges.src == take.node).select(F.col("dst").alias("node"))).distinct().join(visited, "node", "left_anti").checkpoint()
        step += 1
    return visited


def robots_rules(text: DataFrame, agent: str = "*") -> DataFrame:
    """(host, path, allowed) rules of the groups for ``agent`` in robots(host, body)."""
    lines = text.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("n", "line"))
    kv = lines.withColumn("k", F.lower(F.trim(F.split_part(F.col("line"), F.lit(":"), F.lit(1))))).withColumn("v", F.trim(F.regexp_replace(F.regexp_replace("line", "^[^:]*:", ""), "#.*$", "")))
    order = Window.partitionBy("host").orderBy("n")
    is_agent = (F.col("k") == "user-agent").cast("int")
    kv = kv.where(F.col("k").isin("user-agent", "allow", "disallow")).withColumn("starts", (is_agent == 1) & (F.coalesce(F.lag(is_agent).over(order), F.lit(0)) == 0))
    kv = kv.withColumn("g", F.sum(F.col("starts").cast("int")).over(order))
    mine = F.max(((F.col("k") == "user-agent") & (F.lower("v") == agent)).cast("int")).over(Window.partitionBy("host", "g")) == 1
    return kv.withColumn("mine", mine).where(F.col("mine") & (F.col("k") != "user-agent") & (F.col("v") != "")).select("host", F.col("v").alias("path"), (F.col("k") == "allow").alias("allowed"))


def robots_verdict(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths(host, path) with ``allowed``: the longest matching rule, ties and none to allow. ``*`` and ``$`` are wildcards."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("rule", r"[.+()\[\]{}|^?\\]", r"\\$0"), r"\*", ".*"))
    r = rules.select(F.col("host").alias("h"), F.col("path").alias("rule"), F.col("allowed").alias("ok"))
    hit = paths.join(r, F.col("host") == F.col("h"), "left").withColumn("hit", F.col("rule").isNotNull() & F.regexp_like("path", F.coalesce(pattern, F.lit("^$"))))
    return hit.groupBy("host", "path").agg(F.coalesce(F.max_by("ok", F.when(F.col("hit"), F.struct(F.length("rule"), F.col("ok")))), F.lit(True)).alias("allowed"))


def sitemap_entries(xml: DataFrame) -> DataFrame:
    """(source, loc, lastmod, changefreq, priority 0.5 if absent) of sitemap(source, xml)."""
    blocks = xml.select("source", F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<url>(.*?)</url>"), F.lit(1))).alias("u"))
    tag = lambda t: F.trim(F.regexp_extract("u", rf"(?is)<{t}>(.*?)</{t}>", 1))
    return blocks.select("source", tag("loc").alias("loc"), tag("lastmod").alias("lastmod"), tag("changefreq").alias("changefreq"), F.coalesce(F.expr("try_cast(nullif(trim(regexp_extract(u, '(?is)<priority>(.*?)</priority>', 1)), '') as double)"), F.lit(0.5)).alias("priority"))


def url_patterns(pages: DataFrame) -> DataFrame:
    """URL templates with counts and mean depth, most frequent first by count, then template."""
    t = pages.select(U.template("url").alias("template"), U.path_depth("url").alias("depth"))
    return t.groupBy("template").agg(F.count("*").alias("n"), F.round(F.avg("depth"), 6).alias("avg_depth"))


def citations(docs: DataFrame) -> DataFrame:
    """(doc_id, number, url, label, n): distinct links of Markdown text, numbered by first occurrence; images left out."""
    t = F.regexp_replace(F.coalesce("md", F.lit("")), r"!\[[^\]]*\]\([^)]*\)", "")
    found = F.regexp_extract_all(t, F.lit(r"\[([^\]]+)\]\(([^)\s]+)[^)]*\)"), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(found).alias("i", "m")).select("doc_id", "i", F.regexp_extract("m", r"\[([^\]]+)\]", 1).alias("label"), F.regexp_replace(F.regexp_extract("m", r"\]\(([^)\s]+)", 1), "#.*$|/+$", "").alias("url"))
    rows = rows.where(~F.col("url").rlike("^(mailto:|$)") & (F.length("url") >= 10))
    g = rows.groupBy("doc_id", "url").agg(F.count("*").alias("n"), F.min("i").alias("i"), F.max_by("label", F.struct(F.length("label"), -F.col("i"))).alias("label"))
    return g.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))).select("doc_id", "number", "url", "label", "n")
