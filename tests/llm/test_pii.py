import hashlib
import re

from tessella.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    text = text or ""
    spans = sorted((m.start(), i, k, m.end()) for i, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text) if valid(k, m.group()))
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()


CASES = [
    None,
    "",
    "a@b.c_d@e.f x@y a.b@c..d.e x@y.z. é@ü.de",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.2..3.4.5.6 0001.2.3.4 \U0001f600 4111 1111 1111 1111 4111-1111-1111-1111",
    "12--4111111111111111 +1 (375) 555-4393.) +1+2 4111  1111 4111111111111111",
    "+123456789012 " + "1 " * 3000 + "a." * 2000 + "@b.c" + ".d" * 2000,
    "1.2.3.4 " * 1500,
    "4111111111111111\n4111111111111111x4111 1111 1111 111 1",
]


def test_base_spans_equal_a_scan_with_re(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    rows = pii.digest(df.union(df)).collect()
    assert len(rows) == 2 * len(CASES)
    assert all(r.base_sha256 == brute(CASES[r.doc_id]) for r in rows)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.digest(docs).collect()
    assert sum(r.n_email + r.n_card for r in rows) > 0
    assert all(r.base_sha256 == brute(texts[r.doc_id]) for r in rows)


def test_iban_needs_its_checksum_and_ssn_its_context(spark):
    df = spark.createDataFrame([(1, "GB82 WEST 1234 5698 7654 32"), (2, "GB83WEST12345698765432"), (3, "ssn 123-45-6789"), (4, "no 123-45-6789")], "doc_id long, text string")
    rows = {r.doc_id: (r.n_iban, r.n_ssn, r.spans) for r in pii.digest(df).collect()}
    assert rows == {1: (1, 0, "iban:0:27"), 2: (0, 0, ""), 3: (0, 1, "ssn:4:15"), 4: (0, 0, "")}


def test_redact_keeps_rows_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.de, call +1 (375) 555-4393", "x"), (2, None, None), (3, "1-2 3.4", "y")], "doc_id long, text string, start string")
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "mail <EMAIL>, call <PHONE>", "x"), (2, None, None), (3, "1-2 3.4", "y")]


def test_empty_table(spark):
    assert pii.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_items_of_a_list_share_its_context(spark):
    numbers = [f"{200 + i}-45-6{i:03d}" for i in range(30)]
    texts = ["Social security numbers: 123-45-6789, 234-56-7891, 345-67-8912", "ssn: " + "; ".join(numbers[:-1]) + " and " + numbers[-1], "ssn 123-45-6789 was reissued to 234-56-7891", "no 123-45-6789, 234-56-7891", "ssn 123-45-6789. " + "much later text " * 4 + "234-56-7891, 345-67-8912", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_ssn for r in pii.digest(df).collect()} == {0: 3, 1: 30, 2: 2, 3: 0, 4: 1, 5: 0}
    assert {r.doc_id: (r.text or "").count("<SSN>") for r in pii.redact(df).collect()} == {0: 3, 1: 30, 2: 2, 3: 0, 4: 1, 5: 0}
