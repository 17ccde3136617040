"""Sinks: JSON lines, Markdown with front matter, sanitised HTML, cache tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.html import sanitize


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Struct fields as columns, at any depth; arrays stay."""

    def walk(schema: T.StructType, prefix: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema.fields:
            at = (*prefix, f.name)
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, at)
            else:
                out.append(F.col(".".join(f"`{x}`" for x in at)).alias(separator.join(at)))
        return out

    return df.select(*walk(df.schema, ()))


def drop_empty(df: DataFrame, key: str) -> DataFrame:
    """(key, fields): a map of the string forms of all columns that are neither null nor empty."""
    pairs = F.create_map(*[x for c in df.columns if c != key for x in (F.lit(c), F.col(c).cast("string"))])
    return df.select(key, F.map_filter(pairs, lambda _, v: v.isNotNull() & ~v.isin("", "[]", "{}")).alias("fields"))


def truncated(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def write_jsonl(df: DataFrame, path: str, include: list[str] | None = None, exclude: list[str] = ()) -> None:
    df.select(*[c for c in (include or df.columns) if c not in exclude]).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def markdown(meta: dict[str, str], body: str, links: str | None = None) -> Column:
    """A document with YAML front matter from columns ``meta`` (name: column), the body, and at most 50 links."""
    quoted = [F.concat(F.lit(f'{k}: "'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"')) for k, c in meta.items()]
    parts = [F.lit("---"), *quoted, F.lit("---"), F.lit(""), F.coalesce(F.col(body), F.lit(""))]
    if links:
        rows = F.transform(F.slice(links, 1, 50), lambda x: F.concat(F.lit("- ["), x["text"], F.lit("]("), x["url"], F.lit(")")))
        parts.append(F.when(F.size(links) > 0, F.concat(F.lit("\n## Links\n"), F.array_join(rows, "\n"))))
    return F.concat_ws("\n", *parts)


def html_page(title: str, body: str) -> Column:
    return F.concat(F.lit("<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>"), F.col(title), F.lit("</title></head><body>"), sanitize(body), F.lit("</body></html>"))


def cache_rows(results: DataFrame, ttl_seconds: int, now: str) -> DataFrame:
    """Rows to append to a cache: those without error, with the time they expire."""
    return results.where("error is null").withColumn("expires_at", F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(now))) + ttl_seconds))


def image_format(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 12))
    return F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("52494646") & head.endswith("57454250"), "webp").when(head.startswith("474946"), "gif").otherwise("unknown")
