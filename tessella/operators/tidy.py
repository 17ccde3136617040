"""Text without boilerplate or hollow sections, references of a text, best blocks, distributions, and the state of circuit breakers.

Null texts count as empty and give no rows where a row is a thing found. Rows
that repeat a document id are treated each as a document of its own, except in
:func:`top_blocks`, whose input names blocks by id. Empty tables give empty results.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.blocks import BOILERPLATE
from tessella.operators.state import micros

_HEADING = r"[ \t]*#{1,6}[ \t]+\S[^\n]*"
#: Seconds that a cached answer of a kind stays good.
TTL = {"page": 3600, "search": 1800, "crawl": 7200, "map": 86400, "extract": 3600, "metadata": 7200}
FORMAT_TTL = {"markdown": 3600, "json": 3600, "html": 1800, "screenshot": 900}
DEFAULT_TTL = 3600


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def without_boilerplate(c: Column | str) -> Column:
    """Non-blank lines that are no boilerplate, as blocks apart; lines under ten characters always stay."""
    lines = F.filter(F.split(_text(c), "\n", -1), lambda x: F.trim(x) != "")
    return F.array_join(F.filter(lines, lambda x: (F.length(x) < 10) | ~x.rlike(BOILERPLATE)), "\n\n")


def without_hollow_sections(c: Column | str) -> Column:
    """Without Markdown headings that nothing but blank lines follows, up to the next heading or the end."""
    t = F.regexp_replace(_text(c), rf"\A(?:{_HEADING}(?:\n|\z)(?=\s*(?:#{{1,6}}[ \t]+\S|\z)))+", "")
    return F.regexp_replace(t, rf"\n{_HEADING}(?=\s*\n{_HEADING}|\s*\z)", "")


def without_short_sections(c: Column | str, least: int = 5) -> Column:
    """Without Markdown sections of fewer words than ``least`` below their heading; text before the first heading stays."""
    parts = F.split(_text(c), rf"\n(?={_HEADING}(?:\n|\z))", -1)
    body = lambda s: F.regexp_replace(s, rf"\A{_HEADING}", "")
    long = lambda s: ~s.rlike(rf"\A{_HEADING}") | (F.size(F.regexp_extract_all(body(s), F.lit(r"\S+"), F.lit(0))) >= least)
    return F.array_join(F.filter(parts, long), "\n")


def numbered_references(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, number, url, title) of reference definitions ``[1]: url "title"`` in order; repeated numbers stay."""
    found = F.regexp_extract_all(_text("md"), F.lit(r'(?m)^\[\d+\]:\s*\S+(?:\s+"[^\n]+")?\s*$'), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(found).alias("i", "m"))
    part = lambda n: F.regexp_extract("m", r'^\[(\d+)\]:\s*(\S+)(?:\s+"([^\n]+)")?', n)
    return rows.select("doc_id", part(1).cast("long").alias("number"), part(2).alias("url"), part(3).alias("title")).where(F.length("url") >= least)


def raw_urls(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, idx, url) of addresses in the running text, outside Markdown links and images, without closing punctuation."""
    plain = F.regexp_replace(_text("md"), r"!?\[[^\]]*\]\([^)]*\)", "")
    found = F.regexp_extract_all(plain, F.lit(r"""https?://[^\s<>"')\]]+"""), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(found).alias("idx", "m"))
    return rows.select("doc_id", "idx", F.regexp_replace("m", r"[.,;:!?]+$", "").alias("url")).where(F.length("url") >= least)


def footnotes(docs: DataFrame) -> DataFrame:
    """(doc_id, label, url, title) of footnotes ``[^x]: ...`` that hold an address; the title is the rest of the note, or the address."""
    found = F.regexp_extract_all(_text("md"), F.lit(r"(?m)^\[\^[^\]]+\]:[^\n]+$"), F.lit(0))
    rows = docs.select("doc_id", F.explode(found).alias("m")).select("doc_id", F.regexp_extract("m", r"^\[\^([^\]]+)\]", 1).alias("label"), F.trim(F.regexp_extract("m", r"^\[\^[^\]]+\]:([^\n]+)$", 1)).alias("note"))
    rows = rows.withColumn("url", F.regexp_replace(F.regexp_extract("note", r"""(https?://[^\s<>"')\]]+)""", 1), r"[.,;:!?]+$", "")).where("url <> ''")
    title = F.regexp_replace(F.trim(F.replace("note", "url", F.lit(""))), "^[-–—]+|[-–—]+$", "")
    return rows.select("doc_id", "label", "url", F.when(title == "", F.col("url")).otherwise(title).alias("title"))


def top_blocks(scores: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best blocks of every document with a score above 0, ties to the earlier: (doc_id, rank, idx, score)."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "idx")
    return scores.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("doc_id", "rank", "idx", "score")


def changefreq_distribution(entries: DataFrame) -> DataFrame:
    """(changefreq, n); entries without one are left out."""
    return entries.where("changefreq <> ''").groupBy(F.lower("changefreq").alias("changefreq")).agg(F.count("*").alias("n"))


def score_distribution(rows: DataFrame, score_col: str = "score") -> DataFrame:
    """(bucket, n) over five ranges of scores in 0..1; null scores are left out."""
    s = F.col(score_col)
    bucket = F.when(s < 0.2, "0.0-0.2").when(s < 0.4, "0.2-0.4").when(s < 0.6, "0.4-0.6").when(s < 0.8, "0.6-0.8").otherwise("0.8-1.0")
    return rows.where(s.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def level_summary(levels: DataFrame) -> DataFrame:
    """(depth, n_nodes, n_so_far) of a traversal's (node, depth); levels are few, so one window runs over them."""
    per = levels.groupBy("depth").agg(F.count("*").alias("n_nodes"))
    return per.withColumn("n_so_far", F.sum("n_nodes").over(Window.orderBy("depth")))


def ttl_seconds(kind: Column, by_format: bool = False) -> Column:
    """Time to live of a content kind, or of an output format; unknown and null ones get the default."""
    out = F
    for name, seconds in (FORMAT_TTL if by_format else TTL).items():
        out = out.when(kind == name, seconds)
    return out.otherwise(DEFAULT_TTL)


def circuit_breaker(calls: DataFrame, failures: int = 5, recovery: float = 60.0, successes: int = 2) -> DataFrame:
    """(call_id, state, admitted): what a breaker per ``key`` does with each call(key, call_id, ts, ok), in order of ts, then call_id.

    Closed: ``failures`` in a row open it. Open: calls are refused until
    ``recovery`` seconds after the last failure, then it is half open. Half
    open: a failure opens it again, ``successes`` close it. A fold over the
    calls of one key, in time order and batch by batch, so a key of any length
    takes bounded memory; null times come first and count as time 0. ``ts`` holds
    seconds, or times with or without a zone, which are compared in microseconds.
    """
    kind = calls.schema["ts"].dataType.typeName()
    timed = kind in ("timestamp", "timestamp_ntz", "date")
    time = F.unix_micros("ts") if kind == "timestamp" else micros("ts") if timed else F.col("ts").cast("double")
    wait = recovery * 1_000_000 if timed else recovery

    def fold(batches):
        key, state, bad, good, last = None, "closed", 0, 0, 0
        for pdf in batches:
            out = []
            for k, ts, ok in zip(pdf["key"], pdf["s"], pdf["ok"], strict=True):
                if k != key:
                    key, state, bad, good, last = k, "closed", 0, 0, 0
                if state == "open" and ts - last >= wait:
                    state, good = "half_open", 0
                out.append((state, state != "open"))
                if state == "open":
                    continue
                if not ok:
                    bad, last = bad + 1, ts
                    state = "open" if state == "half_open" or bad >= failures else state
                elif state == "half_open":
                    good += 1
                    state, bad = ("closed", 0) if good >= successes else (state, bad)
                else:
                    bad = 0
            yield pd.DataFrame({"call_id": pdf["call_id"], "state": [s for s, _ in out], "admitted": [a for _, a in out]})

    rows = calls.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "call_id", F.coalesce(time, F.lit(0 if timed else 0.0)).alias("s"), F.coalesce("ok", F.lit(False)).alias("ok"))
    return rows.repartition("key").sortWithinPartitions("key", "s", "call_id").mapInPandas(fold, "call_id long, state string, admitted boolean")
