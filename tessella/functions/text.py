"""Text scalars as Columns: counts, language, tokens, truncation, similarity.

Null text counts as empty; counts are then 0 and strings empty.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[一-鿿぀-ゟ゠-ヿ가-힯]"
BLANK = r"[\s\x1c-\x1f\x85\xa0  -     　]+"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(c: Column | str) -> Column:
    """Runs of non-blank characters, in order."""
    return F.filter(F.split(_text(c), BLANK, -1), lambda w: w != "")


def count_words(c: Column | str) -> Column:
    """Words; in mostly CJK text every CJK character counts as one."""
    t = _text(c)
    cjk = F.regexp_count(t, F.lit(CJK))
    return F.when(cjk > F.length(t) * 0.3, cjk + F.size(words(F.regexp_replace(t, CJK, " ")))).otherwise(F.size(words(t)))


def count_sentences(c: Column | str) -> Column:
    return F.size(F.filter(F.split(_text(c), r"[.!?…]+", -1), lambda s: F.regexp_replace(s, BLANK, "") != ""))


def count_paragraphs(c: Column | str) -> Column:
    return F.size(F.filter(F.split(_text(c), r"\n{2,}", -1), lambda s: F.regexp_replace(s, BLANK, "") != ""))


def count_characters(c: Column | str, include_spaces: bool = True) -> Column:
    return F.length(_text(c)) if include_spaces else F.length(F.translate(_text(c), " \t\n", ""))


def estimate_tokens(c: Column | str, chars_per_token: float = 4.0) -> Column:
    """Length over 4, or over 1.5 where more than 30 % is CJK or Thai."""
    t = _text(c)
    dense = F.regexp_count(t, F.lit(r"[一-鿿぀-ゟ゠-ヿ가-힯฀-๿]"))
    n = F.length(t)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.when(dense > n * 0.3, n / 1.5).otherwise(n / chars_per_token)).cast("int")))


def detect_language(c: Column | str, sample: int = 1000) -> Column:
    """Script shares over 10 % of a sample, then function words, else ``en``."""
    s = F.substring(_text(c), 1, sample)
    bar = F.length(s) * 0.1
    n = lambda r: F.regexp_count(s, F.lit(r))
    kana = n(r"[぀-ヿ]")
    has = lambda ws: F.lower(s).rlike(rf"(?<![\p{{L}}\p{{N}}_])({ws})(?![\p{{L}}\p{{N}}_])")
    latin = n("[a-zA-Z]") > bar
    return (
        F.when(s == "", "en")
        .when(n(r"[฀-๿]") > bar, "th")
        .when(kana > bar, "ja")
        .when((n(r"[一-鿿]") > bar) & (kana == 0), "zh")
        .when(n(r"[가-힯ᄀ-ᇿ]") > bar, "ko")
        .when(n(r"[؀-ۿݐ-ݿ]") > bar, "ar")
        .when(n(r"[Ѐ-ӿ]") > bar, "ru")
        .when(latin & has("das|der|die|ein|eine|ist|nicht|und"), "de")
        .when(latin & has("des|du|est|et|la|le|les|un|une"), "fr")
        .when(latin & has("del|el|en|es|las|los|un|una|y"), "es")
        .when(latin & has("as|da|de|do|e|o|os|um|uma|é"), "pt")
        .otherwise("en")
    )


def analyze(c: Column | str, split: Column | None = None) -> Column:
    """A struct of eleven statistics of a text; ``split`` is a column that holds :func:`words` of it, if there is one."""
    w = words(c) if split is None else split
    n, s = F.size(w), count_sentences(c)
    unique = F.size(F.array_distinct(F.transform(w, lambda x: F.regexp_replace(F.lower(x), r"^[.,!?;:]+|[.,!?;:]+$", ""))))
    letters = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    return F.struct(
        F.length(_text(c)).alias("char_count"),
        count_characters(c, False).alias("char_count_no_spaces"),
        n.alias("word_count"),
        s.alias("sentence_count"),
        count_paragraphs(c).alias("paragraph_count"),
        (letters / F.greatest(n, F.lit(1))).alias("avg_word_length"),
        (n / F.greatest(s, F.lit(1))).alias("avg_sentence_length"),
        estimate_tokens(c).alias("estimated_tokens"),
        detect_language(c).alias("language"),
        unique.alias("unique_words"),
        (unique / F.greatest(n, F.lit(1))).alias("lexical_diversity"),
    )


def normalize_whitespace(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_text(c), BLANK, " "))


def clean_text(c: Column | str) -> Column:
    """Without control and zero-width characters; one space at most, two line ends at most, lines trimmed."""
    t = F.regexp_replace(_text(c), r"[​-‏⁠﻿]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.array_join(F.transform(F.split(t, "\n", -1), lambda x: F.trim(x)), "\n")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def truncate(c: Column | str, most: int = 200, suffix: str = "...") -> Column:
    """At most ``most`` characters, cut at the last space if that keeps over half."""
    t = _text(c)
    head = F.substring(t, 1, most - len(suffix))
    space = F.length(head) - F.instr(F.reverse(head), " ")
    at_word = F.when((F.instr(head, " ") > 0) & (space > (most - len(suffix)) * 0.5), F.left(head, space)).otherwise(head)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(at_word), F.lit(suffix)))


def truncate_tokens(c: Column | str, most: int = 1000, suffix: str = "\n\n[... truncated]") -> Column:
    """Cut by the share of estimated tokens that fits, less five per cent."""
    t, tokens = _text(c), estimate_tokens(c)
    keep = F.floor(F.length(t) * (F.lit(most) / tokens) * 0.95).cast("int")
    return F.when(tokens <= most, t).otherwise(F.concat(F.rtrim(F.left(t, keep)), F.lit(suffix)))


def slugify(c: Column | str, most: int = 80, separator: str = "-") -> Column:
    s = F.regexp_replace(F.lower(_text(c)), r"[^\p{L}\p{N}_\s-]", "")
    s = F.regexp_replace(s, r"[\s_-]+", separator)
    s = F.regexp_replace(F.left(s, F.lit(most)), rf"^{separator}+|{separator}+$", "")
    return s


def is_mostly_empty(c: Column | str, threshold: float = 0.9) -> Column:
    t = _text(c)
    return (F.length(t) == 0) | (F.length(F.trim(F.regexp_replace(t, r"^\s+|\s+$", ""))) / F.greatest(F.length(t), F.lit(1)) < 1 - threshold)


def indent(c: Column | str, prefix: str = "  ") -> Column:
    return F.concat(F.lit(prefix), F.replace(_text(c), F.lit("\n"), F.lit("\n" + prefix)))


def word_set(c: Column | str) -> Column:
    return F.array_distinct(words(F.lower(_text(c))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct words; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 0.0).otherwise(both / union)


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def readability(c: Column | str) -> Column:
    """Flesch reading ease clamped to 0..100; syllables are vowel groups, less a silent e."""
    w = F.filter(F.transform(words(F.lower(_text(c))), lambda x: F.regexp_replace(x, "[^a-z]", "")), lambda x: x != "")
    syllables = F.aggregate(
        w, F.lit(0), lambda n, x: n + F.greatest(F.lit(1), F.regexp_count(x, F.lit("[aeiouy]+")) - F.when(x.endswith("e") & (F.regexp_count(x, F.lit("[aeiouy]+")) > 1), 1).otherwise(0))
    )
    n, s = F.size(w), F.greatest(count_sentences(c), F.lit(1))
    ease = 206.835 - 1.015 * (n / s) - 84.6 * (syllables / F.greatest(n, F.lit(1)))
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), ease)))


def _arrow(f, *columns) -> Column:
    """``f`` on the strings of Arrow batches, null as empty."""

    @F.pandas_udf("string")
    def run(*parts: pd.Series) -> pd.Series:
        return pd.Series([f(*row) for row in zip(*parts, strict=True)], dtype=object)

    return run(*[_text(c) for c in columns])


def normalize_unicode(c: Column | str, form: str = "NFC") -> Column:
    import unicodedata

    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown normalization form: {form!r}")
    return _arrow(lambda x: unicodedata.normalize(form, x), c)


def remove_accents(c: Column | str) -> Column:
    """Decomposed, without combining marks."""
    return F.regexp_replace(normalize_unicode(c, "NFD"), r"\p{Mn}", "")


def dedent(c: Column | str) -> Column:
    """Without the white space that all lines begin with; blank lines become empty."""
    from textwrap import dedent as strip

    return _arrow(strip, c)


def wrap(c: Column | str, width: int = 80) -> Column:
    """Lines of at most ``width`` characters, broken at blanks where possible."""
    from textwrap import fill

    return _arrow(lambda x: fill(x, width=width), c)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two texts' word counts; 0 where either has no words."""
    import math
    import re
    from collections import Counter

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = (Counter(re.findall(r"\w+", z.lower())) for z in (p, q))
            norm = math.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values()))
            out.append(sum(v * q[k] for k, v in p.items()) / norm if norm else 0.0)
        return pd.Series(out, dtype=float)

    return run(_text(a), _text(b))


def looks_like_url(c: Column | str) -> Column:
    return _text(c).rlike("^(?:https?|ftp)://")


def looks_like_html(c: Column | str) -> Column:
    t = F.regexp_replace(_text(c), r"^\s+", "")
    return t.rlike("^<(?:!DOCTYPE|html|div|p)") | F.left(t, F.lit(500)).contains("<html")


def looks_like_markdown(c: Column | str) -> Column:
    """Whether a line begins like a heading, bold text, a link, a fence, a list item or a quotation."""
    return _text(c).rlike(r"(?m)^(?:#{1,6}\s|\*\*.+\*\*|\[.+\]\(.+\)|```|\s*[-*+]\s|>)")
