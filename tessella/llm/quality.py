"""Quality rules: a threshold table compiled into one projection.

Every rule names a measure and its lowest and highest accepted value. The
measures (lengths, symbols, stop words, lines, repetition) are Column
expressions, so the whole verdict is one projection of the scan: no user
function, no shuffle, no join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import fenced

#: White space that ends a word, and a word.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Function words of the languages of the corpus; text that is prose holds some.
STOP_WORDS = (
    "the of and to in is that for it was on are be with as this by from or an at not have "
    "der die das und ist von für mit den im ein eine nicht zu auf "
    "le la les de et des un une est que pour dans sur avec du "
    "el los las y del por una con para es se no"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text if ``low <= measure <= high``; a bound of None does not apply."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Measures by name, in terms of the base columns; a text without words gets 0.
MEASURES = {
    "mean_word_chars": "try_divide(word_chars, n_words)",
    "symbols_per_word": "try_divide(n_symbols, n_words)",
    "exclaims_per_word": "try_divide(n_exclaims, n_words)",
    "stop_word_share": "try_divide(n_stop_words, n_words)",
    "upper_share": "try_divide(n_upper, n_letters)",
    "letter_share": "try_divide(n_letters, word_chars)",
    "dup_line_share": "try_divide(n_dup_lines, n_lines)",
}
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbols_per_word", high=0.3),
    Rule("exclamations", "exclaims_per_word", high=0.5),
    Rule("stop_words", "stop_word_share", low=0.02),
    Rule("capitals", "upper_share", high=0.5),
    Rule("letters", "letter_share", low=0.6),
    Rule("repeated_lines", "dup_line_share", high=0.5),
)

_GRAMS = "sequence(0, size(__q_words) - 3)"


def base_measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts that rules are made of (all long), from the whole of ``text_col``.

    A null text counts as empty. Words are maximal runs without white space.
    ``n_repeat_words`` counts the words that lie in a three-word window found at
    least twice in the text: windows are sorted with their positions, so the
    cost is n log n in the words of one text, and nothing leaves the row.
    Columns named ``__q_*`` and those of the counts are replaced.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("__q_text", t)
    df = df.withColumn("__q_words", F.regexp_extract_all("__q_text", F.lit(WORD), F.lit(0)))
    df = df.withColumn("__q_lines", F.filter(F.split("__q_text", "\n", -1), lambda x: x.rlike(WORD)))
    # 64-bit hashes of windows with positions, sorted: equal neighbours are repeats.
    df = df.withColumn(
        "__q_grams",
        F.expr(f"if(size(__q_words) < 3, null, array_sort(transform({_GRAMS}, i -> named_struct('h', xxhash64(get(__q_words, i), get(__q_words, i + 1), get(__q_words, i + 2)), 'i', i))))"),
    )
    df = df.withColumn(
        "__q_at",
        F.expr("""sort_array(transform(filter(__q_grams, (g, j) -> (j > 0 and get(__q_grams, j - 1).h = g.h)
            or (j < size(__q_grams) - 1 and get(__q_grams, j + 1).h = g.h)), g -> g.i))"""),
    )
    length_without = lambda chars: F.length("__q_text") - F.length(F.translate("__q_text", chars, ""))
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    counts = {
        "n_words": F.size("__q_words"),
        "word_chars": F.length(F.translate("__q_text", SPACES, "")),
        "n_symbols": length_without(SYMBOLS),
        "n_dup_lines": F.size("__q_lines") - F.size(F.array_distinct("__q_lines")),
        "n_repeat_words": F.expr("""coalesce(aggregate(transform(__q_at, (p, j) -> if(j < size(__q_at) - 1, least(3, get(__q_at, j + 1) - p), 3)), 0, (s, x) -> s + x), 0)"""),
        "n_lines": F.size("__q_lines"),
        "n_exclaims": length_without("!"),
        "n_stop_words": F.expr(f"size(filter(__q_words, w -> lower(w) in ({stops})))"),
        "n_letters": F.length(F.regexp_replace("__q_text", r"[^\p{L}]", "")),
        "n_upper": F.length(F.regexp_replace("__q_text", r"[^\p{Lu}]", "")),
    }
    return df.withColumns({k: fenced(v.cast("long")) for k, v in counts.items()}).drop("__q_text", "__q_words", "__q_lines", "__q_grams", "__q_at")


def compile_rules(rules: tuple[Rule, ...] = RULES) -> dict[str, F.Column]:
    """Threshold table to Columns: one boolean per rule, true where the text passes."""
    out = {}
    for r in rules:
        value = f"coalesce({MEASURES.get(r.measure, r.measure)}, 0)"
        tests = ([f"{value} >= {r.low}D"] if r.low is not None else []) + ([f"{value} <= {r.high}D"] if r.high is not None else [])
        out[r.name] = F.expr(" and ".join(tests) or "true")
    return out


def apply_rules(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add base counts, ``base_failed``, ``failed`` (names of broken rules) and ``kept``.

    Rows are never dropped here; empty and null texts fail the base rules.
    """
    df = base_measures(df, text_col)
    df = df.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    passed = compile_rules(rules)
    df = df.withColumn("failed", F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in passed.items()])))
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the base counts and the verdicts."""
    df = apply_rules(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle_sql() -> str:
    """DuckDB SQL for :func:`digest` over ``documents`` with :data:`RULES`."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = []
    for r in RULES:
        parts = MEASURES[r.measure].removeprefix("try_divide(").rstrip(")").split(", ")
        value = f"(case when {parts[1]} = 0 then 0.0 else {parts[0]}::double / {parts[1]}::double end)"
        tests += ([f"{value} >= {r.low}"] if r.low is not None else []) + ([f"{value} <= {r.high}"] if r.high is not None else [])
    return rf"""
    with w as (
      select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls
      from documents),
    g as (
      select doc_id, i, gram, count(*) over (partition by doc_id, gram) c from (
        select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] gram from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w))),
    r as (
      select doc_id, sum(least(3, coalesce(n - i, 3))) n_repeat_words from (
        select doc_id, i, lead(i) over (partition by doc_id order by i) n from g where c > 1) group by doc_id),
    m as (
      select w.doc_id, len(ws)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint n_repeat_words, len(ls)::bigint n_lines,
        length(regexp_replace(t, '[^!]', '', 'g'))::bigint n_exclaims,
        len(list_filter(ws, lambda x: lower(x) in ({stops})))::bigint n_stop_words,
        length(regexp_replace(t, '[^\p{{L}}]', '', 'g'))::bigint n_letters, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g'))::bigint n_upper
      from w left join r using (doc_id)),
    v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      not base_failed and {' and '.join(tests)} as kept
    from v"""
