"""HTML scalars by regular expressions, as Columns. Null counts as empty."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&amp;": "&"}
BLOCKS = "p|div|br|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|blockquote|pre|hr|main|aside|form"


def _html(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip_tags(c, keep: list[str] = ()) -> Column:
    tag = rf"<(?!/?(?:{'|'.join(keep)})\b)[^>]*>" if keep else "<[^>]+>"
    return F.regexp_replace(_html(c), f"(?i){tag}", "")


def strip_specific_tags(c, tags: list[str]) -> Column:
    t = _html(c)
    for tag in tags:
        t = F.regexp_replace(F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", ""), rf"(?i)</?{tag}\b[^>]*>", "")
    return t


_NUMERIC = r"(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});"


def _character(code: Column) -> Column:
    """The character of a numeric reference; an ampersand stays escaped for the named pass, what is no character is U+FFFD."""
    n = F.when(code.startswith("x") | code.startswith("X"), F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(code).cast("int")
    good = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    return F.when(code.isNull(), None).when(n == 38, "&amp;").when(good, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd")


def decode_entities(c) -> Column:
    """Decimal and hexadecimal references, and named entities of common use; others stay. Nothing is decoded twice."""
    t = _html(c)
    codes, gaps = F.regexp_extract_all(t, F.lit(_NUMERIC), F.lit(1)), F.split(t, _NUMERIC, -1)
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(_character(F.get(codes, i)), F.lit("")))), "")
    t = F.when(t.rlike(_NUMERIC), joined).otherwise(t)
    for name, value in ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(value))
    return t


def encode_entities(c, quote: bool = True) -> Column:
    t = _html(c)
    for value, name in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&#39;")] if quote else []):
        t = F.replace(t, F.lit(value), F.lit(name))
    return t


def without_hidden(c) -> Column:
    """Without comments, scripts and styles."""
    t = F.regexp_replace(_html(c), r"(?s)<!--.*?-->", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?is)<script\b[^>]*>.*?</script>", ""), r"(?is)<style\b[^>]*>.*?</style>", "")


def extract_text(c) -> Column:
    """Visible text; block tags become line ends."""
    t = F.regexp_replace(without_hidden(c), rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    t = decode_entities(F.regexp_replace(t, "<[^>]+>", ""))
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def raw_title(c) -> Column:
    """The title as written, references undecoded."""
    return F.regexp_extract(_html(c), r"(?is)<title[^>]*>(.*?)</title>", 1)


def title(c) -> Column:
    return F.trim(decode_entities(raw_title(c)))


def clean(c) -> Column:
    return F.regexp_replace(without_hidden(c), r"(?i)<([a-z][a-z0-9]*)\b[^>]*>\s*</\1>", "")


def sanitize(c) -> Column:
    t = F.regexp_replace(_html(c), r"(?is)<(script|style|iframe|object|embed|form)\b[^>]*>.*?</\1>", "")
    t = F.regexp_replace(t, r"(?i)</?(?:script|style|iframe|object|embed|form|link|meta|base)\b[^>]*>", "")
    t = F.regexp_replace(t, r"""(?i)\s+on[a-z]+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "")
    return F.regexp_replace(t, r"""(?i)(href|src)\s*=\s*(["']?)\s*(?:javascript|data|vbscript):[^"'>\s]*""", "$1=$2")


def hrefs(c) -> Column:
    """Every a-href value in order, fragments, scripts and mail left out."""
    found = F.regexp_extract_all(_html(c), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return F.filter(found, lambda h: (h != "") & ~h.rlike("^(?i)(#|javascript:|mailto:|tel:)"))


def images(c) -> Column:
    return F.regexp_extract_all(_html(c), F.lit(r"""(?i)<img\s[^>]*?src\s*=\s*["']([^"']*)["']"""), F.lit(1))


def meta_tags(c) -> Column:
    """map of meta name or property to content; the last wins."""
    tags = F.regexp_extract_all(_html(c), F.lit(r"(?i)<meta\s[^>]*>"), F.lit(0))
    attr = lambda t, a: F.regexp_extract(t, rf"""(?i)(?:{a})\s*=\s*["']([^"']*)["']""", 1)
    rows = F.filter(F.transform(tags, lambda t: F.struct(F.lower(attr(t, "name|property")).alias("k"), attr(t, "content").alias("v"))), lambda s: s["k"] != "")
    keys = F.array_distinct(F.transform(rows, lambda s: s["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(rows, lambda s: s["k"] == k), -1)["v"]))


def canonical(c) -> Column:
    tag = F.regexp_extract(_html(c), r"""(?i)(<link\s[^>]*rel\s*=\s*["']canonical["'][^>]*>)""", 1)
    return F.regexp_extract(tag, r"""(?i)href\s*=\s*["']([^"']*)["']""", 1)


def is_html(c) -> Column:
    return _html(c).rlike(r"(?is)<(!doctype\s+html|html|head|body|div|p|span|a|h[1-6]|table|ul|ol)\b")


def is_well_formed(c) -> Column:
    """Opening and closing tags of every name are as many, void and self-closing tags left out."""
    void = "|".join(sorted("wbr track source meta link input img hr embed col br base area".split()))
    names = lambda p: F.array_sort(F.transform(F.regexp_extract_all(without_hidden(c), F.lit(p), F.lit(1)), lambda x: F.lower(x)))
    return names(rf"(?i)<((?!(?:{void})\b)[a-z][a-z0-9]*)\b(?:[^>]*[^/>])?>") == names(rf"(?i)</((?!(?:{void})\b)[a-z][a-z0-9]*)\s*>")


def collapse_spaces(c) -> Column:
    return F.regexp_replace(_html(c), " {2,}", " ")


def word_count(c) -> Column:
    """Words of the visible text."""
    return F.size(F.regexp_extract_all(extract_text(c), F.lit(r"\S+"), F.lit(0)))


def char_count(c) -> Column:
    """Characters of the visible text."""
    return F.length(extract_text(c))


def encoding(raw: Column | str) -> Column:
    """Encoding of HTML bytes: byte order mark, else the charset that a tag in the first 4 KiB names, else utf-8 (null and empty too)."""
    b = F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.lit("").cast("binary"))
    head = F.decode(F.substring(b, 1, 4096), "ISO-8859-1")
    tag = F.regexp_extract(head, r"""(?i)<meta[^>]*charset=["']?([^"'\s;>]+)""", 1)
    content = F.regexp_extract(head, r"""(?i)content=["'][^"']*charset=([^"'\s;]+)""", 1)
    mark = F.hex(F.substring(b, 1, 3))
    return F.when(mark == "EFBBBF", "utf-8").when(mark.startswith("FFFE") | mark.startswith("FEFF"), "utf-16").when(tag != "", tag).when(content != "", content).otherwise("utf-8")


def decode_bytes(raw: Column | str) -> Column:
    """HTML bytes as text by :func:`encoding`, unknown ones as utf-8; bytes that do not fit become U+FFFD."""

    @F.pandas_udf("string")
    def run(data: pd.Series, names: pd.Series) -> pd.Series:
        def one(b: bytes, name: str) -> str:
            try:
                return b.decode(name, errors="replace")
            except LookupError:
                return b.decode("utf-8", errors="replace")

        return pd.Series([one(b, n) for b, n in zip(data, names, strict=True)], dtype=object)

    return run(F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.lit("").cast("binary")), encoding(raw))
