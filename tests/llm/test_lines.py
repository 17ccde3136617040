import math
import random
from collections import Counter, defaultdict

import pyarrow as pa

import corpus_pipeline
from tessella.llm import common, lines, queries


def shingles(line):
    key = line.strip(" ").lower()
    return {key[i : i + 5] for i in range(max(1, len(key) - 4))} if key.strip() else None


def links(sets):
    """All pairs (i, j) of sets with Jaccard similarity of at least 0.8, exactly: similar sets share one of the rarest few elements."""
    count = Counter(x for s in sets for x in s)
    seen, out = defaultdict(list), []
    for i, s in enumerate(sets):
        few = sorted(s, key=lambda x: (count[x], x))[: len(s) - math.ceil(0.8 * len(s)) + 1]
        for j in {j for x in few for j in seen[x]}:
            both = len(s & sets[j])
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                out.append((j, i))
        for x in few:
            seen[x].append(i)
    return out


def components(n, edges):
    root = list(range(n))
    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(docs):
    """The first line of each line's component; docs: sorted (id, text)."""
    rows = [(d, i, x) for d, t in docs for i, x in enumerate((t or "").split("\n"))]
    known = [(k, s) for k, (_, _, x) in enumerate(rows) if (s := shingles(x))]
    root = components(len(known), links([s for _, s in known]))
    first = {k: known[r][0] for (k, _), r in zip(known, root)}
    return {(d, i): rows[first.get(k, k)][:2] for k, (d, i, _) in enumerate(rows)}


def test_equals_all_pairs(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 4
    docs += [(1000, long), (1001, long.replace("sigma tau", "sigma tao", 1)), (1002, None), (1003, ""), (1004, "a b\na b\n\n"), (1005, long + "\n" + long), (1006, "word " * 30000)]
    out = lines.classify(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.line_no): (r.class_doc, r.class_line) for r in out}
    want = brute(docs)
    assert got == want
    assert all(r.kept == (got[r.doc_id, r.line_no] == (r.doc_id, r.line_no)) for r in out)
    assert len({got[1000, 0], got[1001, 0], got[1005, 0], got[1005, 1]}) == 1


def test_recall_against_all_pairs(spark):
    """On the whole of a larger table: no class joins what all pairs keep apart, and few links are lost."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.line_no): (r.class_doc, r.class_line) for r in lines.classify(docs).collect()}
    rows = [(r.doc_id, i, x) for r in docs.orderBy("doc_id").collect() for i, x in enumerate((r.text or "").split("\n"))]
    known = [(d, i, s) for d, i, x in rows if (s := shingles(x))]
    pairs = links([s for _, _, s in known])
    root = components(len(known), pairs)
    assert len(got) == len(rows)
    assert all(root[k] == root[j] for k, j in ((k, first) for k, first in enumerate({(d, i): k for k, (d, i, _) in enumerate(known)}[got[d, i]] for d, i, _ in known)))
    apart = [(a, b) for a, b in pairs if known[a][2] != known[b][2]]
    found = sum(got[known[a][:2]] == got[known[b][:2]] for a, b in apart)
    print(f"links between different lines: {found} of {len(apart)}")
    assert found >= 0.95 * len(apart)
    assert all(got[known[a][:2]] == got[known[b][:2]] for a, b in pairs if known[a][2] == known[b][2])


def test_repeated_rows_and_clashing_columns(spark):
    """Equal rows share verdicts; rows that repeat an id with other texts are compared each; names do not clash."""
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    names = "doc_id long, text string, key string, h1 string, __h string, bands string, lost_id_0 int, line_no int"
    rows = [(1, a, "k", "h", "x", "b", 0, 1), (1, a, "k", "h", "x", "b", 0, 1), (1, b, "k", "h", "x", "b", 0, 1), (2, a + "\nonly here, nowhere else", "k", "h", "x", "b", 0, 1)]
    df = spark.createDataFrame(rows, names)
    got = sorted((r.doc_id, r.line_no, r.class_doc, r.kept) for r in lines.classify(df).collect())
    assert got == [(1, 0, 1, True)] * 3 + [(2, 0, 1, False), (2, 1, 2, True)]
    left = lines.drop_lines(df)
    assert left.columns == df.columns
    assert sorted(r.text for r in left.collect()) == sorted([a, a, b, "only here, nowhere else"])


def test_drop_lines_keeps_first_copies_and_columns(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    df = spark.createDataFrame([(1, f"{a}\nshort", "x"), (2, f"{a}\n{b}", "y"), (3, b, None), (4, None, "z"), (None, "null id", "n")], "doc_id long, text string, lid string")
    out = lines.drop_lines(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, f"{a}\nshort", "x"), (2, b, "y"), (4, None, "z"), (None, "null id", "n")], key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lines.classify(df).count() == 0 and lines.drop_lines(df).count() == 0


def test_lines_that_differ_late_in_long_words_are_kept(spark):
    texts = ["see the full record at https://site.org/item/12345", "see the full record at https://site.org/item/99999", "the hash of this file is 0123456789abcdef0123456789abcdef", "the hash of this file is 0123456789abfedc9876543210fedcba"]
    texts += [" ".join(f"https://example.com/{x}/{n}" for n in ("one", "two", "three", "four", "five", "six")) for x in ("alpha", "omega")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.kept for r in lines.classify(docs).collect())
    assert sorted(map(tuple, lines.drop_lines(docs).collect())) == list(enumerate(texts))
    # Near copies of long words are still found: one letter late in a long line differs.
    long = "a path of many parts is /" + "/".join(f"folder{i}" for i in range(40))
    near = spark.createDataFrame([(1, long), (2, long.replace("folder39", "folder3x"))], "doc_id long, text string")
    assert [(r.doc_id, r.kept) for r in lines.classify(near).orderBy("doc_id").collect()] == [(1, True), (2, False)]


def test_query_and_pipeline_compare_short_lines_and_scripts_without_spaces(spark, tmp_path):
    chinese = "这是一个没有空格的长句子用来检查重复的行是否会被删除而不是永远保留"
    docs = [(1, f"Read more\n{chinese}\n\nfirst"), (2, f"read more \n{chinese}\n\nsecond"), (3, "Read less\n\n第一行"), (4, "page 15\npage 16")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op10_line_dedup(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.line_no): (r.class_doc, r.class_line) for r in out if not r.kept} == {(2, 0): (1, 0), (2, 1): (1, 1)}
    left = corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(map(tuple, left.collect())) == [docs[0], (2, "\nsecond"), docs[2], docs[3]]


def test_lines_of_many_short_words_are_linked(spark):
    """Changes that spare most shingles but touch many words lose no link; each pair has random words of its own."""
    rng = random.Random(5)
    texts, pairs = [], 0
    while pairs < 400:
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2)) for _ in range(rng.randrange(8, 120))]
        line = " ".join(words)
        near = list(line)
        for i in range(rng.randrange(25), len(line), 45):
            near[i] = rng.choice("0123456789")
        a, b = shingles(line), shingles("".join(near))
        if line != "".join(near) and 0.8 <= len(a & b) / len(a | b) < 0.84:
            texts += [line, "".join(near)]
            pairs += 1
    out = lines.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    lost = [r.doc_id for r in out if r.doc_id % 2 and r.class_doc != r.doc_id - 1]
    assert lost == [] and len(out) == 800


def test_alike_equals_sets():
    """Exact on short lines, other scripts, characters of four bytes, repeated shingles and either side of the threshold."""
    rng = random.Random(6)
    xs = ["a", "aaaaaaa", "ab cd", "abcdefghi", "日本語のテキスト", "😀😀x😀y😀", "a" * 50 + "b", "x" * 3000]
    xs += ["".join(rng.choice("ab 日é😀") for _ in range(rng.randrange(5, 60))).strip() or "z" for _ in range(300)]
    ys = [x[: len(x) * 9 // 10] or "q" for x in xs[:150]] + [x + "tail" * rng.randrange(3) for x in xs[150:]]
    xs, ys = ([t.strip(" ") or "z" for t in side] for side in (xs, ys))
    want = [len(shingles(x) & shingles(y)) >= 0.8 * len(shingles(x) | shingles(y)) for x, y in zip(xs, ys, strict=True)]
    assert lines.alike(pa.array(xs, pa.large_string()), pa.array(ys, pa.large_string())).tolist() == want and 20 < sum(want) < 290


def test_shingle_hashes_are_the_same_however_texts_are_mixed():
    """A shingle's hash does not depend on the other characters of its text or batch."""
    texts = ["abcdefgh", "abcdefgh é", "abc", "", "日本語のテキスト", "é abcdefgh", "x" * 5]
    alone = [sorted(lines.shingle_hashes(pa.array([t], pa.large_string()))[0].tolist()) for t in texts]
    for chosen in (range(len(texts)), (0, 6), (1, 2, 4)):
        h, of = lines.shingle_hashes(pa.array([texts[i] for i in chosen], pa.large_string()))
        assert [sorted(h[of == k].tolist()) for k in range(len(chosen))] == [alone[i] for i in chosen]
    assert set(alone[0]) < set(alone[1]) and set(alone[0]) < set(alone[5])


def test_packed_bands_share_as_pairs_do(monkeypatch):
    """Members and firsts of every bucket with several ids, over many flushes and buckets larger than one; ids far apart and out of order."""
    monkeypatch.setattr(lines, "FLUSH", 50)
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(3, 9))) for _ in range(400)] + ["read more now"] * 120
    ids = rng.sample([i + (i % 5 << 33) for i in range(1000)], len(texts))
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 70]), pa.array(texts[i : i + 70])], names=["id", "key"]) for i in range(0, len(texts), 70)]
    blobs = sorted((r for b in lines._pack(iter(batches)) for r in b.to_pylist()), key=lambda r: r["part"])
    packed = [pa.RecordBatch.from_pylist(blobs[i : i + 9], pa.schema([("part", pa.int32()), ("blob", pa.binary())])) for i in range(0, len(blobs), 9)]
    buckets = defaultdict(set)
    for key, i in zip(*(x.tolist() for x in lines.band_hashes(pa.array(texts, pa.large_string()))), strict=True):
        buckets[key].add(ids[i])
    want = sorted(sorted(b) for b in buckets.values() if len(b) > 1)
    got, firsts = defaultdict(list), defaultdict(set)
    for r in (r for b in lines._share(iter(packed)) for r in b.to_pylist()):
        got[r["bucket"]].append(r["id"])
        firsts[r["bucket"]].add(r["first"])
    assert all(len(f) == 1 for f in firsts.values())
    assert sorted(sorted([*members, *firsts[b]]) for b, members in got.items()) == want


def test_unlike_sizes_and_outlines_are_not_fetched(spark):
    """The filter ahead of the texts loses no pair that is alike, and its numbers are those of the sets."""
    rng = random.Random(8)
    xs = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(5, 400))).strip() for _ in range(150)]
    xs += [x[: len(x) * 19 // 20] for x in xs] + [x[len(x) // 2 :] for x in xs] + ["z" * 5000, "ab" * 2000]
    rows = list(enumerate(dict.fromkeys(x.strip() for x in xs if x.strip())))
    out = next(lines._outline(iter([pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([x for _, x in rows])], names=["id", "key"])])))
    assert out.column("n").to_pylist() == [len(shingles(x)) for _, x in rows]
    texts = spark.createDataFrame(out.to_pandas())
    pairs = spark.createDataFrame([(a, b) for a, _ in rows for b, _ in rows if a < b], "a long, b long")
    got = {tuple(r) for r in lines._checker(texts)(pairs).collect()}
    assert got == set(links([shingles(x) for _, x in rows])) and len(got) > 50


def test_long_lines_share_bands_if_alike_and_hardly_else():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    texts, pairs = [], 0
    while pairs < 300:
        line = " ".join(rng.choice(words) for _ in range(rng.randrange(50, 200)))
        near = list(line)
        for i in range(rng.randrange(25), len(line), 45):
            near[i] = rng.choice("0123456789")
        a, b = shingles(line), shingles("".join(near))
        if 0.8 <= len(a & b) / len(a | b) < 0.84:
            texts += [line, "".join(near)]
            pairs += 1
    buckets = defaultdict(set)
    for key, i in zip(*(x.tolist() for x in lines.band_hashes(pa.array(texts, pa.large_string()))), strict=True):
        buckets[key].add(i)
    together = {(i, j) for b in buckets.values() for i in b for j in b if i < j}
    assert all((i, i + 1) in together for i in range(0, len(texts), 2))
    assert len(together) - pairs < 10  # 22 where bands of 5 serve all lengths


def test_pairs_that_cannot_be_alike_are_dropped_in_their_bucket(spark):
    """Of a bucket of unlike lines only pairs that may be alike leave it, and the link among them is found."""
    members = common.staged(spark.createDataFrame([(5, i, 1) for i in range(2, 9)], "bucket long, id long, first long"), "members", spark)
    seen = []

    def checker(ids):
        def verify(pairs):
            seen.append({tuple(r) for r in pairs.select("a", "b").collect()})
            return pairs.where("a = 7 and b = 8")

        verify.traits, verify.may_be = spark.createDataFrame([(i, 10 * min(i, 7)) for i in range(1, 9)], "id long, n long"), "abs(an - bn) <= 1"
        return verify

    assert {tuple(r) for r in common.link(members, checker).collect()} == {(7, 7), (8, 7)}
    assert seen[-1] == {(7, 8)}


def test_outlines_tell_long_lines_apart(spark):
    """Of pairs of long lines that share seven shingles of ten, outlines leave few to be fetched; texts are fetched by two joins beside that of the pairs here (four more where outlines are looked at again)."""
    rng = random.Random(10)
    rows, wanted = [], 0
    while wanted < 200:
        line = "".join(rng.choice("abcdefgh ") for _ in range(240)).strip()
        near = list(line)
        for i in range(rng.randrange(20), len(near), 26):
            near[i] = "0"
        a, b = shingles(line), shingles("".join(near))
        if 0.6 <= len(a & b) / len(a | b) < 0.72:
            rows += [(2 * wanted, line), (2 * wanted + 1, "".join(near))]
            wanted += 1
    out = next(lines._outline(iter([pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([x for _, x in rows])], names=["id", "key"])])))
    texts = spark.createDataFrame(out.to_pandas())
    check = lines._checker(texts)
    of = [c for c in texts.columns if c not in ("id", "key")]
    sides = [texts.select((texts.id / 2).cast("long").alias("pair"), texts.id.alias(x), *[texts[c].alias(f"{x}{c}") for c in of]) for x in ("a", "b")]
    pairs = sides[0].join(sides[1], "pair").where("a < b")
    assert pairs.count() == wanted and pairs.where(check.may_be).count() < 40
    plan = check.sure(pairs.select("a", "b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3 and check.sure(pairs.select("a", "b")).count() == 0


def test_wide_outlines_tell_very_long_lines_apart(spark, monkeypatch):
    """Lines of over 576 shingles pass the outlines of 256 ranges, however unlike; of such pairs few have their texts fetched, none alike is lost, and pairs are compared a few at a time."""
    rng = random.Random(11)
    rows = []
    for k in range(120):
        line = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(700, 1900))).strip()
        near = list(line)
        for i in range(rng.randrange(20), len(near), 22 if k % 2 else 60):
            near[i] = "0"
        rows += [(2 * k, line), (2 * k + 1, "".join(near))]
    out = next(lines._outline(iter([pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([x for _, x in rows])], names=["id", "key"])])))
    texts, text = spark.createDataFrame(out.to_pandas()), dict(rows)
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(120)], "a long, b long")
    want = {(2 * k, 2 * k + 1) for k in range(120) if 5 * len(shingles(text[2 * k]) & shingles(text[2 * k + 1])) >= 4 * len(shingles(text[2 * k]) | shingles(text[2 * k + 1]))}
    written, fetched = common.staged, []
    monkeypatch.setattr(lines, "staged", lambda df, label, spark=None: (lambda t: (fetched.append((label, t.count())), t)[1])(written(df, label, spark)))
    monkeypatch.setattr(lines, "SLICE", 25)
    assert {tuple(r) for r in lines._checker(texts)(pairs).collect()} == want and len(want) >= 60
    met, near = [n for label, n in fetched if label == "pairs"]
    assert met == 120 and near <= len(want) + 6 and len(fetched) == 2 + 5 + -(-near // 25)
