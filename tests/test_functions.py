import pytest
from pyspark.sql import functions as F

from tessella.functions import hashing, html, htmltree, text, url


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column).first()[0]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("https://example.com", "https://example.com/"),
        ("HTTPS://Example.COM/page", "https://example.com/page"),
        ("https://www.example.com/page", "https://example.com/page"),
        ("https://example.com/page#top", "https://example.com/page"),
        ("https://example.com:443/a//b/", "https://example.com/a/b"),
        ("http://example.com:8080/x?utm_source=a&b=2&a=1", "http://example.com:8080/x?a=1&b=2"),
        ("", ""),
        ("not a url at all", "not a url at all"),
        (None, None),
    ],
)
def test_normalize_url(spark, given, want):
    assert one(spark, given, url.normalize("v")) == want


def test_url_parts(spark):
    rows = [("https://docs.example.com/a/b.HTML?x=1&x=2#f",), ("http://www.site.co.uk",), ("https://a.b.example.com/",), ("localhost",), (None,)]
    df = spark.createDataFrame(rows, "v string").select(url.base_domain("v"), url.subdomain("v"), url.path_depth("v"), url.extension("v"), url.query_params("v"))
    got = [tuple(r) for r in df.collect()]
    assert got[0] == ("example.com", "docs", 2, ".html", {"x": ["1", "2"]})
    assert got[1][:2] == ("site.co.uk", "") and got[2][:2] == ("example.com", "a.b") and got[4][:2] == ("", "")


def test_text_vectors(spark):
    cases = [("Hello world", text.count_words("v"), 2), ("สวัสดี ครับ", text.count_words("v"), 2), ("日本語", text.count_words("v"), 3), ("", text.count_words("v"), 0), (None, text.count_words("v"), 0)]
    cases += [("Hello world. How are you? I'm fine!", text.count_sentences("v"), 3), ("Wait... what?", text.count_sentences("v"), 2), ("hello world", text.count_characters("v", False), 10)]
    cases += [("Hello, World!", text.slugify("v"), "hello-world"), ("Python 3.12", text.slugify("v"), "python-312"), ("Hello---", text.slugify("v"), "hello")]
    cases += [("Привет мир", text.detect_language("v"), "ru"), ("こんにちは", text.detect_language("v"), "ja"), ("der Hund und", text.detect_language("v"), "de"), ("", text.detect_language("v"), "en")]
    cases += [("a b c", text.jaccard(text.word_set("v"), text.word_set("v")), 1.0)]
    for given, column, want in cases:
        assert one(spark, given, column) == want, (given, want)


def test_html_scalars(spark):
    cases = [("<p>Hello <b>world</b></p>", html.strip_tags("v"), "Hello world"), ("&amp;&lt;&gt;", html.decode_entities("v"), "&<>"), ("<div><p>a</p></div>", html.is_well_formed("v"), True), ("<div><p>a</div>", html.is_well_formed("v"), False)]
    cases += [('<a onclick="x()" href="javascript:evil()">t</a><script>1</script>', html.sanitize("v"), '<a href=">t</a>'.replace('">', '"">'))]
    for given, column, want in cases:
        assert one(spark, given, column) == want, (given, want)


def test_entities_and_bytes(spark):
    cases = [("&#72;&#101;&#x6C;&#108;&#111; &#x1F600; &#8217;", "Hello 😀 ’"), ("&amp;#72; &#38;lt; &#0; &#xD800;", "&#72; &lt; \ufffd \ufffd"), ("&nope; &", "&nope; &"), (None, "")]
    for given, want in cases:
        assert one(spark, given, html.decode_entities("v")) == want, given
    raw = [(b"\xef\xbb\xbfx", "utf-8"), (b"\xff\xfex\x00", "utf-16"), (b'<meta charset="iso-8859-1">\xe9', "iso-8859-1"), (b"caf\xc3\xa9", "utf-8"), (None, "utf-8"), (b'<meta charset="odd">a', "odd")]
    got = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(raw)], "i int, v binary").select("i", html.encoding("v").alias("e"), html.decode_bytes("v").alias("t")).orderBy("i").collect()
    assert [r.e for r in got] == [e for _, e in raw]
    assert got[2].t.endswith("é") and got[3].t == "café" and got[4].t == "" and got[5].t.endswith("a")
    assert one(spark, "<p>one  two</p><script>x</script>", html.word_count("v")) == 2 and one(spark, "a   b", html.collapse_spaces("v")) == "a b"


def test_more_urls(spark):
    cases = [("https://example.com/docs", url.join(F.col("v"), F.lit("guide")), "https://example.com/guide"), ("https://example.com/a/b", url.join(F.col("v"), F.lit("../c")), "https://example.com/c")]
    cases += [("https://e.com/p?a=1&q=x#f", url.with_params("v", {"q": "te st"}), "https://e.com/p?a=1&q=te+st#f"), ("https://e.com/a b?q=é", url.encode("v"), "https://e.com/a%20b?q=%C3%A9")]
    cases += [("a%20b%C3%A9+%zz", url.decode("v"), "a bé+%zz"), ("https://docs.e.com", url.same_domain(F.col("v"), F.lit("http://e.com")), True), ("", url.same_domain(F.col("v"), F.lit("")), False), ("https://e.com/x.PDF", url.is_file("v"), True)]
    cases += [("https://www.e.com/a/", url.equal(F.col("v"), F.lit("https://e.com/a")), True), (None, url.join(F.col("v"), F.lit("/x")), "/x"), ("http://[bad", url.join(F.col("v"), F.lit("y")), "y")]
    for given, column, want in cases:
        assert one(spark, given, column) == want, (given, want)


def test_more_text(spark):
    cases = [("ﬁle", text.normalize_unicode("v", "NFKC"), "file"), ("café résumé", text.remove_accents("v"), "cafe resume"), ("  a\n   b", text.dedent("v"), "a\n b"), ("aa bb cc", text.wrap("v", 5), "aa bb\ncc")]
    cases += [("a b b", text.cosine("v", F.lit("b a")), 3 / 10**0.5), ("", text.cosine("v", F.lit("x")), 0.0), ("# T", text.looks_like_markdown("v"), True), ("plain", text.looks_like_markdown("v"), False), (" <div>", text.looks_like_html("v"), True), ("ftp://x", text.looks_like_url("v"), True), (None, text.wrap("v"), "")]
    for given, column, want in cases:
        got = one(spark, given, column)
        assert got == pytest.approx(want) if isinstance(want, float) else got == want, (given, want)


def test_hashes(spark):
    import hashlib
    import hmac

    assert one(spark, "x", hashing.hmac_sha256(F.col("v"), b"k")) == hmac.new(b"k", b"x", hashlib.sha256).hexdigest()
    assert one(spark, "x", hashing.hmac_verify(F.col("v"), hashing.hmac_sha256(F.col("v"), b"k"), b"k")) and not one(spark, "x", hashing.hmac_verify(F.col("v"), F.lit(None), b"k"))
    assert one(spark, " https://e.com/ ", hashing.hash_url(F.col("v"))) == hashlib.sha256(b"https://e.com").hexdigest()
    assert one(spark, "john@x.com", hashing.mask_email(F.col("v"))) == "j***n@x.com"
    assert one(spark, "sk-abcdefgh1234", hashing.mask_key(F.col("v"))) == "sk-...1234"


PAGE = """<html lang="en"><head><title>T &amp; t</title><meta name="description" content="d"></head><body><nav><a href="/n">n</a></nav>
<article><h1>Main</h1><p class="x y">One <b>two</b> <a href="p?q=1">three</a><ul><li>a<li>b</ul><table><tr><th>h<th>i<tr><td rowspan=2>1<td>2<tr><td>3</table>
<pre><code class="language-py">x = 1</code></pre>""" + "word " * 40 + "</article></body></html>"


def test_tree():
    root = htmltree.parse(PAGE)
    assert htmltree.metadata(root)["title"] == "T & t" and htmltree.metadata(root)["lang"] == "en"
    assert [n.text() for n in htmltree.select(root, "ul > li")] == ["a", "b"]
    assert htmltree.select(root, "p.x.y b")[0].text() == "two" and htmltree.xpath(root, "//li[2]/text()") == ["b"]
    assert htmltree.xpath(root, "//a/@href") == ["/n", "p?q=1"]
    assert htmltree.table_rows(htmltree.select(root, "table")[0]) == [["h", "i"], ["1", "2"], ["1", "3"]]
    assert [x["url"] for x in htmltree.links(root, "https://e.com/d/x")] == ["https://e.com/n", "https://e.com/d/p?q=1"]
    md = htmltree.markdown(htmltree.main_content(root))
    assert "# Main" in md and "One **two** [three](p?q=1)" in md and "- a\n- b" in md and "| h | i |" in md and "```py\nx = 1\n```" in md
    assert htmltree.markdown(htmltree.parse(None)) == ""
