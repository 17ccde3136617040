"""Outlines, phrases, bibliographies, schema mining, JSON repair, recovery of pruned blocks, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.blocks import STOP

_HEADING = r"(?m)^(#{1,6})[ \t]+([^\n]+)$"
from tessella.shared import use_shared_checkpoints


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, level, title) of Markdown headings."""
    rows = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_HEADING), F.lit(0))).alias("idx", "h"))
    return rows.select("doc_id", "idx", F.length(F.regexp_extract("h", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("h", "^#+", "")).alias("title"))


def toc(docs: DataFrame, deepest: int = 3) -> DataFrame:
    """(doc_id, toc): an indented list of the headings down to a level."""
    h = headings(docs).where(F.col("level") <= deepest)
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), "title")
    return h.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("toc"))


def breadcrumbs(docs: DataFrame) -> DataFrame:
    """Headings with the path of titles above them: the last heading so far of every smaller level."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    h = headings(docs)
    for k in range(1, 6):
        # The last heading of level k counts if none of a smaller level came after it.
        at = F.max(F.when(F.col("level") == k, F.col("idx"))).over(w)
        reset = F.max(F.when(F.col("level") < k, F.col("idx"))).over(w)
        name = F.last(F.when(F.col("level") == k, F.col("title")), True).over(w)
        h = h.withColumn(f"up{k}", F.when((F.col("level") > k) & (at > F.coalesce(reset, F.lit(-1))), name))
    path = F.concat_ws(" > ", *[f"up{k}" for k in range(1, 6)], "title")
    return h.select("doc_id", "idx", "level", "title", path.alias("breadcrumb"))


def key_phrases(docs: DataFrame, n: int = 10, least: int = 2, most: int = 5) -> DataFrame:
    """The n most frequent runs of ``least`` to ``most`` words between stop words; ties in order of the phrase."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(STOP) | (F.length(w) < 2), "|").otherwise(w)), " ")
    runs = F.filter(F.transform(F.split(marked, r"\|"), lambda x: F.trim(x)), lambda p: F.size(F.split(p, " ")).between(least, most))
    c = docs.select("doc_id", F.explode(runs).alias("phrase")).groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "phrase")
    return c.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def bibliography(citations: DataFrame, style: str = "markdown") -> DataFrame:
    """(doc_id, bibliography) from numbered citations: markdown, apa, plain or bibtex."""
    host = F.regexp_extract("url", r"^[a-z]+://(?:www\.)?([^/]+)", 1)
    line = {
        "markdown": F.concat(F.lit("["), "number", F.lit("] ["), "label", F.lit("]("), "url", F.lit(")")),
        "apa": F.concat(host, F.lit(". "), "label", F.lit(". Retrieved from "), "url"),
        "plain": F.concat(F.lit("["), "number", F.lit("] "), "label", F.lit(" - "), "url"),
        "bibtex": F.concat(F.lit("@misc{ref"), "number", F.lit(", title={"), "label", F.lit("}, url={"), "url", F.lit("}}")),
    }[style]
    rows = F.transform(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))), lambda x: x["line"])
    return citations.groupBy("doc_id").agg(F.array_join(rows, "\n").alias("bibliography"))


def repeated_elements(pages: DataFrame, least: int = 3) -> DataFrame:
    """(page_id, element, n): tag.class pairs that occur ``least`` times or more, candidates for a schema's base."""
    tags = F.regexp_extract_all("html", F.lit(r"""<([a-z][a-z0-9]*)(?:\s[^>]*?class=["']([\w-]+)[^>]*|[^>]*)>"""), F.lit(0))
    one = pages.select("page_id", F.explode(tags).alias("t"))
    name, cls = F.regexp_extract("t", "^<([a-z][a-z0-9]*)", 1), F.regexp_extract("t", r"""class=["']([\w-]+)""", 1)
    return one.groupBy("page_id", F.concat(name, F.when(cls != "", F.concat(F.lit("."), cls)).otherwise("")).alias("element")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def repair_json(c: Column) -> Column:
    """The first JSON object or array of a model's answer, fences and trailing commas removed; null if none parses."""
    body = F.regexp_replace(c, r"(?s)^.*?```(?:json)?\s*(.*?)```.*$", "$1")
    body = F.regexp_replace(F.regexp_extract(body, r"(?s)([\[{].*[\]}])", 1), r",\s*([\]}])", "$1")
    return F.when(F.call_function("try_parse_json", body).isNotNull() & (body != ""), body)


def schema_of(json_schema: dict) -> T.StructType:
    """A StructType from a JSON Schema object."""

    def kind(s: dict) -> T.DataType:
        t = s.get("type", "string")
        if t == "array":
            return T.ArrayType(kind(s.get("items", {})))
        if t == "object":
            return T.StructType([T.StructField(k, kind(v)) for k, v in s.get("properties", {}).items()])
        return {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}.get(t, T.StringType())

    return kind({"type": "object", **json_schema})


def validation_errors(c: Column, json_schema: dict) -> Column:
    """Messages for fields that a JSON string lacks or holds with another type; empty if it is valid."""
    checks = []
    pattern = {"integer": r"^-?\d+$", "number": r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$", "boolean": "^(true|false)$", "array": r"(?s)^\[.*\]$", "object": r"(?s)^\{.*\}$"}
    for name, s in json_schema.get("properties", {}).items():
        v = F.get_json_object(c, f"$.{name}")
        if name in json_schema.get("required", []):
            checks.append(F.when(v.isNull(), F.lit(f"missing: {name}")))
        if s.get("type") in pattern:
            checks.append(F.when(v.isNotNull() & ~v.rlike(pattern[s["type"]]), F.lit(f"not {s['type']}: {name}")))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def css_to_xpath(css: str) -> str:
    """XPath of a simple selector: tag, .class, #id, tag.class, and descendants."""
    steps = []
    for part in css.split():
        tag, _, rest = (part.partition(".") if "." in part else part.partition("#"))
        mark = "." in part
        steps.append(f"{tag or '*'}" + (f"[contains(@class,'{rest}')]" if mark and rest else f"[@id='{rest}']" if rest else ""))
    return "//" + "//".join(steps)


def recovered(kept: DataFrame, margin: float = 0.1, threshold: float = 0.48) -> DataFrame:
    """Pruned blocks whose neighbours on both sides are kept and whose score is within ``margin`` stay too."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    both = F.coalesce(F.lag("kept").over(w), F.lit(False)) & F.coalesce(F.lead("kept").over(w), F.lit(False))
    return kept.withColumn("recovered", ~F.col("kept") & both & (F.col("score") >= threshold - margin))


def clusters(pairs: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, cluster): connected components of pairs(a, b), by spreading the least label; checkpointed each round."""
    spark = pairs.sparkSession
    use_shared_checkpoints(spark)
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("x", "y").distinct()
    label = both.select(F.col("x").alias("node")).distinct().withColumn("cluster", F.col("node"))
    for _ in range(rounds):
        near = both.join(label, both.y == label.node).groupBy("x").agg(F.min("cluster").alias("m"))
        new = label.join(near, label.node == near.x).select("node", F.least("cluster", "m").alias("cluster"), (F.col("m") < F.col("cluster")).alias("moved")).checkpoint()
        label = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return label
