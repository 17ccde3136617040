"""Sources: tables of pages, robots.txt and sitemap bodies, SERP and JSON search responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) from Parquet."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, body): one row per file; gzip is read as it is."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("source"), F.col("value").alias("body"))


def sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    return text_files(spark, path).withColumnRenamed("body", "xml")


def cached(requests: DataFrame, cache: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Split requests(url, format) into (hits, misses) against cache(url, format, expires_at, ...); hits need no fetch."""
    fresh = cache.where(F.col("expires_at") > F.to_timestamp(F.lit(now)))
    return requests.join(fresh, ["url", "format"]), requests.join(fresh, ["url", "format"], "left_anti")


def serp_links(results: DataFrame, least: int = 8) -> DataFrame:
    """(query, position, url, title) from result pages(query, html): first of each URL, titles of ``least`` characters."""
    link = r"""(?is)<a\s[^>]*href=["'](https?://[^"']+)["'][^>]*>(.*?)</a>"""
    rows = results.select("query", F.posexplode(F.regexp_extract_all("html", F.lit(link), F.lit(0))).alias("i", "m"))
    rows = rows.select("query", "i", F.regexp_extract("m", link, 1).alias("url"), F.trim(F.regexp_replace(F.regexp_extract("m", link, 2), "<[^>]+>", "")).alias("title")).where(F.length("title") >= least)
    first = rows.groupBy("query", "url").agg(F.min(F.struct("i", "title")).alias("f"))
    from pyspark.sql import Window

    return first.select("query", F.row_number().over(Window.partitionBy("query").orderBy("f.i")).alias("position"), "url", F.col("f.title").alias("title"))


def is_blocked(html) -> F.Column:
    """Whether a result page is a block page."""
    return F.lower(html).rlike("captcha|unusual traffic|robot check|access denied|are you a human|verify you are|too many requests|blocked|automated queries|security check|rate limit")


RESPONSE = "array<struct<url:string,title:string,content:string,score:double,publishedDate:string>>"


def json_results(responses: DataFrame, limit: int) -> DataFrame:
    """(query, position, url, title, snippet) from JSON search responses(query, body): distinct URLs, in order."""
    from pyspark.sql import Window

    rows = responses.select("query", F.posexplode(F.from_json(F.get_json_object("body", "$.results"), RESPONSE)).alias("i", "r")).where("r.url <> ''")
    first = rows.groupBy("query", F.col("r.url").alias("url")).agg(F.min(F.struct("i", "r.title", "r.content")).alias("f"))
    position = F.row_number().over(Window.partitionBy("query").orderBy("f.i"))
    return first.select("query", position.alias("position"), "url", F.col("f.title").alias("title"), F.col("f.content").alias("snippet")).where(F.col("position") <= limit)
