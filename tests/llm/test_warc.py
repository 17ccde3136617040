import hashlib

from pyspark.sql import functions as F

from tessella.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def leaf(df):
    return warc.leaves(df.select("page_id", warc.record(F.col("url"), F.col("html")).alias("record")), "page_id")


def test_locates_exactly_the_changed_records(spark):
    rows = [(i, f"http://x/{i}", f"body {i} é " * (1 + i % 40)) for i in range(5000)] + [(6000, None, None), (None, "u", "h")]
    bad = [(i, u, ("~" + h[1:]) if i in (0, 17, 2047, 2048, 4999) else h) for i, u, h in rows]
    bad = [r for r in bad if r[0] != 33]
    same = warc.audit(leaf(pages(spark, rows)), leaf(pages(spark, rows)))
    assert same.count() == 0
    found = {r.id: r for r in warc.audit(leaf(pages(spark, rows)), leaf(pages(spark, bad))).collect()}
    assert set(found) == {0, 17, 33, 2047, 2048, 4999} and found[33].found is None
    r = found[17]
    text = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {rows[17][1]}\r\nContent-Type: text/html\r\nContent-Length: {len(rows[17][2].encode())}\r\n\r\n{rows[17][2]}\r\n\r\n"
    assert r.expected == hashlib.sha256(text.encode()).hexdigest() and r.size == len(text.encode())


def test_empty_and_unlike_heights(spark):
    none = leaf(pages(spark, []))
    some = leaf(pages(spark, [(i, "u", "b" * 3000) for i in range(400)]))
    assert warc.audit(none, none).count() == 0
    assert warc.audit(none, some).count() == 400 == warc.audit(some, none).count()


def test_records_that_share_an_id_count_one_for_one(spark):
    """Repeated rows, one damaged record of two of an id, and clashing columns."""
    rows = [(1, "u", "a"), (1, "u", "b"), (2, "u", "c"), (2, "u", "c")]
    for damaged, want in (([(1, "u", "a"), (1, "u", "x"), *rows[2:]], [1]), (rows[:3], [2]), (rows, [])):
        sides = [pages(spark, r).withColumns({c: F.lit("x") for c in ("file", "node", "hash", "nth")}) for r in (rows, damaged)]
        got = warc.audit(*map(leaf, sides)).collect()
        assert [r.id for r in got] == want


def test_files_round_trip(spark, tmp_path):
    rows = [(1, "http://x/1", "line\n\r\n\r\nmore é"), (2, None, None), (3, "http://x/3", "long " * 100_000), (4, "http://x/4", "holds WARC/1.0\r\n itself")]
    records = pages(spark, rows).select("url", "html", warc.record(F.col("url"), F.col("html")).alias("record"))
    warc.write_files(records, f"{tmp_path}/w")
    got = warc.read_files(spark, f"{tmp_path}/w").collect()
    assert sorted((r.url, r.body) for r in got if r.whole) == sorted((u or "", h or "") for _, u, h in rows[:3])
    assert {r.record for r in got if r.whole} == {r.record for r in records.collect()[:3]}
    assert sum(not r.whole for r in got) == 2  # the two parts of the last


def test_no_plan_holds_the_levels_below(spark):
    """Levels are read from written tables, and the result reads one table."""
    rows = [(i, f"http://x/{i}", "body " * 2000) for i in range(0, 40 * 2048, 97)]
    tree = warc.tree(leaf(pages(spark, rows)))
    assert len(tree) >= 5
    assert all("Exchange" not in level._jdf.queryExecution().executedPlan().toString() for level in tree)
    bad = [(i, u, "x" + h if i == 97 else h) for i, u, h in rows]
    out = warc.audit(leaf(pages(spark, rows)), leaf(pages(spark, bad)))
    assert [r.id for r in out.collect()] == [97]
    assert len({f.rsplit("/", 2)[-2] for f in out.inputFiles()}) <= 1
