"""Personal data in text, with DataFrame functions alone.

Regular expressions propose spans, checksums confirm them (Luhn for cards,
mod-97 for IBANs) and context words in the neighbouring text move the score.

Patterns are written so that Java's matcher neither recurses nor rescans:
separators inside a number or a host name are first replaced, one character for
one character, by non-characters, after which one character class matches the
whole candidate. Positions follow from the lengths of gaps and matches, summed
in blocks, so that cost stays near-linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import fenced

#: Non-characters (never valid in interchanged text) that stand for separators while matching.
SPACE, DASH, DOT = "﷐", "﷑", "﷒"
MARKS = SPACE + DASH + DOT

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{DOT}{_LOCAL}]))[{DOT}{_LOCAL}]++@[A-Za-z0-9-]+{DOT}[A-Za-z0-9{DOT}-]+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"(?<![0-9{SPACE}{DASH}])[0-9][0-9{SPACE}{DASH}]{{11,36}}(?![0-9{SPACE}{DASH}])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Score of a confirmed span, what a context word adds, and the words.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT_BONUS = 0.3
CONTEXT_CHARS = 40
CONTEXT = {
    "email": r"e-?mail|contact|write to|courriel|correo",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": r"card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": r"phone|\btel\b|call|mobile|fax|telefon|tél",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social security|tax id",
}
#: Spans of the added kinds below this score are not reported; base kinds always are.
MIN_SCORE = 0.5
#: What may stand between the items of a list, which share the context of the first.
_LISTED = r"^[^\p{L}\p{N}]*(?:(?:and|or|und|oder|et|ou|y|o)[^\p{L}\p{N}]+)?$"
_BLOCK = 512


def _marked(text: Column, kind: str) -> Column:
    """``text`` with the separators that may stand inside a ``kind`` replaced; as many code points."""
    if kind == "email":
        return F.regexp_replace(F.translate(text, MARKS, "???"), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    if kind == "card":
        spaced = F.regexp_replace(F.translate(text, MARKS, "???"), r"(?<=[0-9])\x20(?=[0-9])", SPACE)
        return F.regexp_replace(spaced, r"(?<=[0-9])-(?=[0-9])", DASH)
    return text


def _hint(kind: str, text: Column) -> Column:
    """A cheap necessary condition for a match."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]")
    return text.rlike({"card": r"[0-9][0-9\x20-]{10}", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}[kind])


def _running(values: str) -> str:
    """SQL: for each element the sum of those before it, in blocks of ``_BLOCK``."""
    block = f"slice({values}, c * {_BLOCK} + 1, {_BLOCK})"
    return f"""if(size({values}) = 0, filter(array(0L), x -> false), flatten(transform(
        array(transform(sequence(0, cast((size({values}) - 1) div {_BLOCK} as int)), c -> aggregate({block}, 0L, (s, x) -> s + x))),
        sums -> flatten(transform(sequence(0, size(sums) - 1), c -> aggregate({block},
            named_struct('p', aggregate(slice(sums, 1, c), 0L, (s, x) -> s + x), 'o', filter(array(0L), x -> false)),
            (s, x) -> named_struct('p', s.p + x, 'o', concat(s.o, array(s.p))), s -> s.o))))))"""


_DIGITS = "regexp_replace(x, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": r"x rlike '^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\\.0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$'",
    "card": f"length({_DIGITS}) between 12 and 19 and luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) between 9 and 15",
    "iban": """aggregate(split(concat(substring(replace(x, ' ', ''), 5), substring(replace(x, ' ', ''), 1, 4)), ''), 0,
        (r, c) -> case when c = '' then r when c between '0' and '9' then (r * 10 + ascii(c) - 48) % 97 else (r * 100 + ascii(c) - 55) % 97 end) = 1""",
    "ssn": r"x rlike '^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)'",
}


def _told(df: DataFrame, kind: str, m: str, g: str, out: str) -> DataFrame:
    """Add ``out``: for each match in ``m`` 'L' if a context word of ``kind`` tells of it; ``g`` holds the gaps around the matches.

    The context is CONTEXT_CHARS of the text to either side, across other
    matches (ten of them are longer than that). The items of a list follow the first.
    """
    n = CONTEXT_CHARS
    sides = {
        f"{out}_b": fenced(F.expr(f"transform({m}, (x, j) -> right(concat(right(element_at({g}, j + 1), {n}), right(x, {n})), {n}))")),
        f"{out}_a": fenced(F.expr(f"transform({m}, (x, j) -> left(concat(left(x, {n}), left(element_at({g}, j + 2), {n})), {n}))")),
    }
    before = f"right(concat(array_join(slice({out}_b, greatest(1, i - 9), least(i, 10)), ''), right(element_at({g}, i + 1), {n})), {n})"
    after = f"left(concat(left(element_at({g}, i + 2), {n}), array_join(slice({out}_a, i + 2, 10), '')), {n})"
    word, listed = (x.replace(chr(92), chr(92) * 2) for x in (CONTEXT[kind], _LISTED))
    codes = f"""array_join(transform({m}, (x, i) -> case when lower(concat({before}, ' ', {after})) rlike '{word}' then 'L'
        when i > 0 and length(element_at({g}, i + 1)) <= {n} and lower(element_at({g}, i + 1)) rlike '{listed}' then 'a' else 'n' end), '')"""
    carried = F.split(F.regexp_replace(F.expr(codes), r"(?:(?<=L)|(?!^)\G)a", "L"), "")
    return df.withColumns(sides).withColumn(out, fenced(carried)).drop(*sides)


def find_spans(df: DataFrame, text_col: str = "text", out_col: str = "pii_spans") -> DataFrame:
    """Add ``out_col``: array<struct<start, ord, kind, end, score, base>> sorted by start, then kind.

    Offsets count code points from 0, end exclusive. Within a kind, matches are
    leftmost and do not overlap; spans of different kinds may. Null and empty
    texts give an empty array; rows are neither dropped nor joined; other
    columns pass through (those named ``__pii_*`` are reserved).
    """
    cols = df.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    first = {"__pii_text": text}
    df = df.withColumns(first)
    found, gaps = {}, {}
    for k in KINDS:
        t = F.col("__pii_text")
        marked = _marked(t, k)
        found[f"__pii_m_{k}"] = F.when(_hint(k, t), F.regexp_extract_all(marked, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none)
        gaps[f"__pii_g_{k}"] = F.when(F.size(f"__pii_m_{k}") > 0, F.split(marked, PATTERNS[k], -1)).otherwise(none)
    df = df.withColumns(found).withColumns(gaps)
    steps = {f"__pii_s_{k}": F.expr(f"zip_with(__pii_m_{k}, slice(__pii_g_{k}, 1, size(__pii_m_{k})), (x, g) -> cast(length(x) + length(g) as bigint))") for k in KINDS}
    df = df.withColumns(steps)
    starts = {f"__pii_p_{k}": F.expr(f"zip_with({_running(f'__pii_s_{k}')}, slice(__pii_g_{k}, 1, size(__pii_m_{k})), (c, g) -> c + length(g))") for k in KINDS}
    df = df.withColumns(starts)
    for k in KINDS:
        df = _told(df, k, f"__pii_m_{k}", f"__pii_g_{k}", f"__pii_t_{k}")
    parts = []
    for i, k in enumerate(KINDS):
        score = f"round({SCORES[k]} + if(element_at(__pii_t_{k}, i + 1) = 'L', {CONTEXT_BONUS}, 0.0), 2)"
        least = "" if k in BASE_KINDS else f" and s.score >= {MIN_SCORE}"
        parts.append(f"""transform(filter(transform(__pii_m_{k}, (x, i) -> named_struct(
            'start', element_at(__pii_p_{k}, i + 1), 'ord', {i}, 'kind', '{k}', 'end', element_at(__pii_p_{k}, i + 1) + length(x),
            'score', if({_VALID[k]}, cast({score} as double), -1D), 'base', {str(k in BASE_KINDS).lower()})), s -> s.score >= 0{least}), s -> s)""")
    return df.withColumn(out_col, fenced(F.expr(f"array_sort(concat({', '.join(parts)}))"))).select(*[F.col(f"`{c}`") for c in cols if c != out_col], out_col)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace every confirmed span in ``text_col`` by ``<KIND>``; columns and rows stay as they are.

    Kinds are replaced in the order of ``KINDS``, so a kind sees the
    placeholders of earlier ones. Added kinds are replaced where their score
    reaches ``MIN_SCORE``. A null text stays null.
    """
    cols = df.columns
    df = df.withColumn("__pii_t", F.col(f"`{text_col}`"))
    for k in KINDS:
        t = F.col("__pii_t")
        keep = "true" if k in BASE_KINDS else f"{SCORES[k]} + if(element_at(__pii_l, i + 1) = 'L', {CONTEXT_BONUS}, 0.0) >= {MIN_SCORE}"
        df = df.withColumn("__pii_k", _marked(t, k)).withColumn("__pii_m", F.when(_hint(k, t), F.regexp_extract_all("__pii_k", F.lit(PATTERNS[k]), F.lit(0))))
        df = df.withColumn("__pii_g", F.when(F.size("__pii_m") > 0, F.split("__pii_k", PATTERNS[k], -1)))
        if k not in BASE_KINDS:
            df = _told(df, k, "__pii_m", "__pii_g", "__pii_l")
        joined = F.expr(f"""array_join(transform(__pii_g, (g, i) -> concat(g, array_join(transform(filter(array(try_element_at(__pii_m, i + 1)), x -> x is not null),
            x -> if({_VALID[k]} and {keep}, '<{k.upper()}>', x)), ''))), '')""")
        df = df.withColumn("__pii_t", fenced(F.when(F.size("__pii_m") > 0, F.translate(joined, MARKS, " -.")).otherwise(t))).drop("__pii_k", "__pii_m", "__pii_g", "__pii_l")
    return df.withColumn(text_col, F.col("__pii_t")).select(*[F.col(f"`{c}`") for c in cols])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, their hash, and all spans as text."""
    found = find_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    shown = "concat(s.kind, ':', s.start, ':', s.`end`)"
    count = lambda k: F.expr(f"cast(size(filter(pii_spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(F.expr(f"array_join(transform(filter(pii_spans, s -> s.base), s -> {shown}), ',')"), 256).alias("base_sha256"),
        F.expr(f"array_join(transform(pii_spans, s -> {shown}), ',')").alias("spans"),
        *[count(k) for k in ADDED_KINDS],
        F.expr("array_join(transform(pii_spans, s -> cast(s.score as string)), ',')").alias("scores"),
    )
