import pytest
from pyspark.sql import functions as F

from tessella import catalog
from tessella.operators import chunks, graph, page, similarity, tidy
from tessella.plans.pipeline import Pipeline, Registry, default_pipeline
from tessella.sources import readers, writers
from tessella.streaming import events as stream

DUCK = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in DUCK:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted(names) == cols and got == want


def test_html_scalars_of_odd_titles_equal_their_sql(spark, tmp_path):
    import duckdb

    titles = ['<title> token = &quot;1&quot; </title>', "<TITLE lang='x'>a &amp; b &amp;lt; &lt;c&gt; &#39;&#x41;\n</TITLE>", "<title>&amp;amp;</title><title>second</title>", "<title></title>", "no title &quot;"]
    spark.createDataFrame(list(enumerate(titles)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(plain, map(tuple, catalog.QUERIES["html_scalars"](spark, str(tmp_path)).collect())))
    assert got == sorted(map(plain, con.execute(catalog.ORACLES["html_scalars"]).fetchall())) and got[0][1] == "token = &quot;1&quot;"


def test_caches_and_buckets_fold_sorted_rows(spark):
    """Keys, null and long ones too, are folded as their rows pass: no group is made for a key; batches may end within one."""
    import datetime as dt
    import random

    from tessella.operators import state

    rng, day = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 19 == 0 else day + dt.timedelta(microseconds=rng.randrange(0, 4 * 10**11, 10**6)), rng.choice([None, 1, 2, 3])) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long")
    hits, allowed = {}, {}
    for user in (None, 1, 2, 3):
        until, level, last = None, 3, None
        for i, ts, _ in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1] is None, r[1] or day, r[0])):
            t = (ts - day).total_seconds() if ts else -1e13
            hits[i] = until is not None and t < until
            until = until if hits[i] else t + 86_400
            level, last = 3 if last is None else min(3, level + (t - last) / 7200), t
            allowed[i] = level >= 1
            level -= level >= 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for df, want in ((state.cache_hits(events.withColumnRenamed("user_id", "key"), 86_400), hits), (state.token_bucket(events, 3, 1 / 7200), allowed)):
            assert dict(map(tuple, df.collect())) == want
            assert "FlatMapGroups" not in df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def odd_documents(spark, tmp_path):
    """A loader and DuckDB over documents with repeated ids and lengths, no id, no text and no words."""
    import duckdb

    texts = ["bb aa bb cc dd", "dd cc ee ee aa", "aa bb aaa ccc aaa", "", None, "the a of", "ünï ünï 漢字 x y zz9 zz9 _q_"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (3, texts[3]), (4, texts[4]), (5, texts[5]), (None, texts[6]), (7, " ".join(f"w{i * i % 37:03}" for i in range(400)))]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    return con


def test_tfidf_of_odd_documents_equals_its_sql(spark, tmp_path, monkeypatch):
    """With terms sent to all tasks, or joined by shuffle; sent ones take one shuffle of documents, and no window over rows of terms."""
    con = odd_documents(spark, tmp_path)
    want = sorted(map(plain, con.execute(f"select term, weight from ({catalog.ORACLES['tfidf_vectors']}) where doc_id is null or doc_id <> 1").fetchall()))
    for most in (1 << 20, 0):
        monkeypatch.setattr(similarity, "MOST_SENT", most)
        df = catalog.QUERIES["tfidf_vectors"](spark, str(tmp_path))
        assert sorted(plain((r.term, r.weight)) for r in df.collect() if r.doc_id != 1) == want
        assert df.where("doc_id = 1").count() == 5
        assert ("Window" in df._jdf.queryExecution().optimizedPlan().toString()) == (not most)


def test_keywords_of_odd_documents_equal_their_sql(spark, tmp_path):
    """One shuffle, of documents: no row for each word, no window."""
    con = odd_documents(spark, tmp_path)
    df = catalog.QUERIES["keywords_topn"](spark, str(tmp_path))
    key = lambda r: repr((r[0], r[1]))
    pick = "select doc_id, rank, term, tf from ({}) where doc_id is null or doc_id <> 1"
    got = sorted((tuple(r) for r in df.select("doc_id", "rank", "term", "tf").collect() if r.doc_id != 1), key=key)
    assert got == sorted(con.execute(pick.format(catalog.ORACLES["keywords_topn"])).fetchall(), key=key) and len(got) > 10
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and "Aggregate" not in plan


def test_circuit_breaker(spark):
    """Opens after five failures in a row, half opens a minute after the last, closes after two successes; nulls and ties have their place."""
    calls = [("a", i, float(i), False) for i in range(5)] + [("a", 5, 10.0, True), ("a", 6, 64.0, True), ("a", 7, 64.0, True), ("a", 8, 65.0, True), (None, 9, None, None), ("b", 10, 0.0, True)]
    got = {r.call_id: (r.state, r.admitted) for r in tidy.circuit_breaker(spark.createDataFrame(calls, "key string, call_id long, ts double, ok boolean")).collect()}
    assert got == {**{i: ("closed", True) for i in range(5)}, 5: ("open", False), 6: ("half_open", True), 7: ("half_open", True), 8: ("closed", True), 9: ("closed", True), 10: ("closed", True)}
    assert tidy.circuit_breaker(spark.createDataFrame([], "key string, call_id long, ts double, ok boolean")).count() == 0


def test_circuit_breaker_over_times(spark, sf):
    """The query runs on the events' times, and times of either kind give what their seconds give, to the microsecond."""
    calls = [("a", i, float(i), False) for i in range(5)] + [("a", 5, 63.999999, True), ("a", 6, 64.0, True), ("b", 7, 0.0, True)]
    df = spark.createDataFrame(calls, "key string, call_id long, ts double, ok boolean")
    rows = lambda d: sorted(map(tuple, tidy.circuit_breaker(d).collect()))
    want = rows(df)
    assert want[5:7] == [(5, "open", False), (6, "half_open", True)]
    zoned = df.withColumn("ts", F.timestamp_micros(F.round(F.col("ts") * 1_000_000).cast("long")))
    assert rows(zoned) == want == rows(zoned.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    events = spark.read.parquet(f"{sf}/events.parquet")
    got = rows(events.select(F.col("user_id").alias("key"), F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").cast("double").alias("ts"), (F.col("event_id") % 3 != 0).alias("ok")))
    assert sorted(map(tuple, catalog.QUERIES["circuit_breaker"](spark, sf).collect())) == got and len(got) == events.count()


def test_sections(spark):
    cases = [("# A\n# B\ntext", "# B\ntext"), ("x\n# B\n# C", "x"), ("# only", ""), ("a\n\n# H\n\nbody\n# E\n\n", "a\n\n# H\n\nbody\n\n"), ("plain", "plain"), (None, "")]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, v string")
    assert [r[1] for r in sorted(df.select("i", tidy.without_hollow_sections("v")).collect())] == [w for _, w in cases]
    short = [("intro\n# A\none two\n## B\none two three four five six\n", "intro\n## B\none two three four five six\n"), ("# A\nx", ""), (None, "")]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(short)], "i int, v string")
    assert [r[1] for r in sorted(df.select("i", tidy.without_short_sections("v")).collect())] == [w for _, w in short]


def test_chunks_cover_text_within_size(spark):
    text = "intro " * 30 + "\n# A\n" + "alpha beta " * 300 + "\n## B\nshort\n"
    rows = sorted(chunks.sized(spark.createDataFrame([(1, text), (2, None), (3, " ")], "doc_id long, text string")).collect(), key=lambda r: r.idx)
    assert {r.doc_id for r in rows} == {1} and all(len(r.chunk) <= 1000 and text[r.start_char : r.end_char] == r.chunk for r in rows)
    covered = set().union(*(range(r.start_char, r.end_char) for r in rows))
    assert not text[: min(covered)].strip() and all(i in covered or text[i].isspace() for i in range(len(text)))
    assert {r.heading for r in rows} >= {"A"}


def test_simhash_is_close_for_like_texts(spark):
    a = "one two three four five six seven eight nine ten eleven twelve thirteen"
    df = spark.createDataFrame([(a, a + " fourteen", "quite other words stand here and nothing is shared at all")], "a string, b string, c string")
    near, far = df.select(similarity.hamming_similarity(similarity.simhash(F.col("a")), similarity.simhash(F.col("b"))), similarity.hamming_similarity(similarity.simhash(F.col("a")), similarity.simhash(F.col("c")))).first()
    assert near > 0.75 > far


def test_robots(spark):
    rules = graph.robots_rules(spark.createDataFrame([("h", "User-agent: *\nDisallow: /admin\nAllow: /admin/ok # x\nSitemap: s\nUser-agent: other\nDisallow: /")], "host string, body string"))
    paths = spark.createDataFrame([("h", "/admin/settings"), ("h", "/admin/ok/1"), ("h", "/page"), ("i", "/x")], "host string, path string")
    assert {r.path: r.allowed for r in graph.robots_verdict(paths, rules).collect()} == {"/admin/settings": False, "/admin/ok/1": True, "/page": True, "/x": True}


def test_sources_and_sinks(spark, tmp_path):
    r = spark.createDataFrame([("q", '{"results":[{"url":"u1","title":"t"},{"url":"u1","title":"x"},{"url":"u2","title":"v"}]}')], "query string, body string")
    assert [(x.position, x.url, x.title) for x in readers.json_results(r, 5).orderBy("position").collect()] == [(1, "u1", "t"), (2, "u2", "v")]
    df = spark.createDataFrame([(1, (2, "x"), "")], "id int, s struct<a:int,b:string>, e string")
    assert writers.flatten(df).columns == ["id", "s_a", "s_b", "e"]
    assert writers.drop_empty(writers.flatten(df), "id").first().fields == {"s_a": "2", "s_b": "x"}
    writers.write_jsonl(df, f"{tmp_path}/j", exclude=["e"])
    assert spark.read.json(f"{tmp_path}/j").columns == ["id", "s"]


def test_pipeline_and_registry(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    seen = []
    out = default_pipeline().hook("after", lambda n, df: seen.append(n)).run(pages)
    assert out.count() > 0 and seen == ["parse", "filter", "chunk"]
    assert Pipeline().add("a", lambda d: d).insert(0, "b", lambda d: d.limit(1)).remove("a").run(pages).count() == 1
    reg = Registry()
    reg.register("x")(lambda k=1: k)
    assert reg.create("x", k=3) == 3
    css = page.extract_css(pages, "article", {"t": {"selector": "h1"}})
    assert css.count() > 0


def test_streams_equal_batches(spark, sf, tmp_path):
    from tessella.operators import state

    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("event_id").repartitionByRange(3, "event_id").write.parquet(f"{tmp_path}/in")

    def drain(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    src = lambda: stream.read(spark, f"{tmp_path}/in", 10)
    got = drain(stream.tumbling_counts(src()), "complete", "tumbling")
    want = events.groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert got.agg(F.sum("n")).first()[0] == events.count() and got.count() == want.count()
    buckets = {(r.event_id, r.allowed) for r in drain(stream.token_bucket(src(), 3, 1 / 7200), "append", "bucket").collect()}
    assert buckets == {tuple(r) for r in state.token_bucket(events, 3, 1 / 7200).collect()}
