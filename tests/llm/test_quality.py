import re
from collections import Counter

from tessella.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


CASES = [None, "", "  \n\t", "a b", "a b c a b c", "x x x x x", "é ü#\n\né ü#\n ", "one two three four one two three", "w " * 30000 + "|" * 5000]


def test_counts_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    for r in quality.digest(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(CASES[r.doc_id]), r
        assert r.base_failed and not r.kept


def test_rules_agree_with_quality_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.digest(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert len(rows) > 50
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.98 * len(rows)


def test_other_columns_and_thresholds(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", 7)], "doc_id long, text string, n_words long")
    row = quality.apply_rules(df, rules=(quality.Rule("short", "n_words", high=3), quality.Rule("any", "n_lines"))).first()
    assert row.n_words == 6 and row.failed == ["short"] and not row.kept


def test_one_projection(spark):
    df = quality.digest(spark.createDataFrame([], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and df.count() == 0
