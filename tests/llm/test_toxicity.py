import random
import tracemalloc
import zlib

import pyarrow as pa
import pytest

from tessella.llm import toxicity


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.digest(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    recall = sum(p for t, p in held if t) / sum(t for t, _ in held)
    specificity = sum(1 - p for t, p in held if not t) / sum(1 - t for t, _ in held)
    print(len(held), recall, specificity)
    assert recall > 0.7 and specificity > 0.98  # a quarter of the toxic labels here are on texts without a telling word


@pytest.fixture(scope="module")
def small_model():
    rng = random.Random(1)
    calm = ["the", "of", "river", "stone", "garden", "walk", "evening", "paper", "window", "music"]
    rude = ["horrible", "stinking", "worthless"]
    texts, labels = [], []
    for i in range(400):
        words = [rng.choice(calm) for _ in range(60)]
        if i % 2:
            words[rng.randrange(60)] = rng.choice(rude)
        texts.append(" ".join(words))
        labels.append(i % 2)
    return toxicity.train(texts, labels)


def test_misspellings_share_vectors(small_model):
    assert (small_model.scores(pa.array(["you stinkingg paper", "such worthles music", "horible evening"])) > 0.5).all()


@pytest.mark.xfail(reason="known fault: on this small vocabulary, short clean texts score above 0.5")
def test_short_clean_texts_stay_below(small_model):
    assert (small_model.scores(pa.array(["the river walk", "paper", "music of stone", "walk " * 20000])) < 0.5).all()


def test_texts_without_words_stay_below(small_model):
    assert (small_model.scores(pa.array([None, "", " \n "], pa.string())) < 0.5).all()


def test_repeated_rows_count_once_in_training(spark):
    """Equal rows, and rows of one id with other texts, score each; the model is that of the distinct ids."""
    docs = spark.createDataFrame([(i, f"calm words number {i} " * 9 + ("horrible " if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 as quality", "cast(doc_id % 2 as int) as toxic")
    again = toxicity.fit(docs.union(docs), labels)
    assert (toxicity.fit(docs, labels).effect == again.effect).all()
    assert toxicity.digest(docs.union(docs), labels).count() == 120


def test_no_labels_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some text", 3.0), (2, None, None)], "doc_id long, text string, toxicity double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.digest(docs, labels).collect()] == [0, 0]
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.digest(docs.limit(0), labels).count() == 0


def test_windows_late_in_a_text_and_rare_words_are_learned():
    rng = random.Random(2)
    calm = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(300)]
    late = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(40)]
    rude = ["horrible", "stinking", "worthless"]
    texts, labels = [], []
    for i in range(200):
        words = [rng.choice(calm) for _ in range(1100 if i % 2 else 160)]
        if i % 2:
            words[1000:1012] = [w for w in rude for _ in range(4)]
        else:
            words += [rng.choice(late) for _ in range(40)]
        texts.append(" ".join(words))
        labels.append(i % 2)
    for i in (1, 3, 5, 7):
        texts[i] += " vyxwuzt"  # in four of a hundred toxic texts
    model = toxicity.train(texts, labels)
    # Words only ever seen late in toxic texts, late in clean ones, and in a few texts all carry weight.
    for word in [*rude, *late, "vyxwuzt"]:
        assert (model.effect[toxicity.bags(pa.array([word])).buckets] != 0).all(), word


def test_training_memory(monkeypatch):
    """The sample's n-grams are not held twice over; small pieces and few epochs leave them the bulk of the peak."""
    monkeypatch.setattr(toxicity, "EPOCHS", (1, 1))
    monkeypatch.setattr(toxicity, "BATCH_BYTES", 1 << 16)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(2000)) for _ in range(160)]
    tracemalloc.start()
    try:
        toxicity.train(texts, [i % 2 for i in range(160)])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 * sum(map(len, texts))


def test_training_takes_little_beside_the_sample(monkeypatch):
    """As it is set, training on a sample of a megabyte stays below 50 MB: neither a batch in the making nor a window's name beside every n-gram adds much."""
    monkeypatch.setattr(toxicity, "EPOCHS", (1, 1))
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(1000)) for _ in range(160)]
    tracemalloc.start()
    try:
        toxicity.train(texts, [i % 2 for i in range(160)])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 50 << 20


def test_training_runs_outside_the_driver(spark, monkeypatch):
    """The driver holds neither the sample's texts nor their n-grams; the model is that of training on the same rows here."""
    docs = spark.createDataFrame([(i, f"calm words number {i} " * 9 + ("horrible " if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 as quality", "cast(doc_id % 2 as int) as toxic")
    rows = [(r.text, r.doc_id % 2) for r in docs.orderBy("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    want = toxicity.train(*map(list, zip(*rows, strict=True)))
    monkeypatch.setattr(toxicity, "bags", None)  # of the driver alone
    got = toxicity.fit(docs, labels)
    assert (got.effect == want.effect).all() and got.offset == want.offset
