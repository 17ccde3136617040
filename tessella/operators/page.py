"""Page operators over pages(page_id, url, html): one parse per page, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.functions import htmltree as H

PARSED = (
    "page_id long, url string, title string, description string, canonical string, lang string, author string, keywords string, "
    "headings array<struct<level:int,text:string>>, links array<struct<url:string,text:string,domain:string,is_internal:boolean>>, "
    "tables array<array<array<string>>>, main_text string, markdown string, word_count long"
)


def parse_pages(pages: DataFrame) -> DataFrame:
    """Metadata, headings, links, tables, main text and Markdown of every page; null HTML is empty."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = pages.sparkSession.createDataFrame([], PARSED).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                root = H.parse(r["html"])
                m = H.metadata(root)
                row = {k: m[k] for k in ("title", "description", "canonical", "lang", "author", "keywords")}
                row |= {"page_id": r["page_id"], "url": r["url"], "headings": H.headings(root), "links": H.links(root, r["url"] or ""), "tables": [H.table_rows(t) for t in H.select(root, "table")]}
                main = H.main_content(root)
                text = H.clean(main.text())
                out.append(row | {"main_text": text, "markdown": H.markdown(main), "word_count": len(text.split())})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def extract_css(pages: DataFrame, base: str, fields: dict[str, dict]) -> DataFrame:
    """Rows (page_id, item, fields map) for every element that ``base`` selects.

    A field is ``{selector, type: text | attribute | html, attribute, default, transform}``;
    transforms are lowercase, uppercase, strip and title.
    """
    return _records(pages, lambda root: H.select(root, base), lambda n, f: H.select(n, f["selector"]) if f.get("selector") else [n], fields)


def extract_xpath(pages: DataFrame, base: str, fields: dict[str, dict]) -> DataFrame:
    """As :func:`extract_css`, with ``xpath`` in place of ``selector``."""
    return _records(pages, lambda root: H.xpath(root, base), lambda n, f: H.xpath(n, f["xpath"]), fields)


def _records(pages: DataFrame, rows, find, fields: dict[str, dict]) -> DataFrame:
    change = {"lowercase": str.lower, "uppercase": str.upper, "strip": str.strip, "title": str.title}

    def value(found, f):
        if not found:
            return f.get("default")
        x = found[0]
        if isinstance(x, str):
            v = x
        elif f.get("type") == "attribute":
            v = x.attrs.get(f["attribute"], f.get("default"))
        else:
            v = H.clean(x.text())
        return change[f["transform"]](v) if v is not None and f.get("transform") else v

    def run(batches):
        for batch in batches:
            out = [(r["page_id"], i, [(k, value(find(n, f), f)) for k, f in fields.items()]) for r in batch.to_pylist() for i, n in enumerate(rows(H.parse(r["html"])))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.map_(pa.string(), pa.string()))], names=["page_id", "item", "fields"]
            )

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, item int, fields map<string,string>")
