import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tessella.llm import minhash


def counts(text):
    words = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", (text or "").lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(docs):
    sets = [(i, counts(t)) for i, t in sorted(docs, key=lambda x: x[0])]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and similarity(a, b) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def test_classes_equal_all_pairs(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base = " ".join(f"w{i}" for i in range(300))
    docs += [(5000 + i, base.replace(f" w{i * 7 + 3} ", f" x{i} ")) for i in range(20)]
    docs += [(6000, None), (6001, ""), (6002, "a b"), (6003, "A, b!"), (6004, "a b c d e f"), (6005, "same " * 20000), (6006, "same " * 19000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.classes(df).collect()}
    assert got == brute(docs)
    assert len({got[5000 + i] for i in range(20)}) == 1 and got[6000] != got[6001] and got[6002] == got[6003] and got[6005] == got[6006]


def test_signatures_estimate_weighted_similarity():
    a = "the cat sat on the mat and the dog lay down beside it " * 3 + " ".join(f"u{i}" for i in range(60))
    b = "the cat sat on the mat and the dog lay down beside it " * 2 + " ".join(f"u{i}" for i in range(10, 70))
    slots, doc = minhash.shingle_slots(pa.array([a, b, ""]))
    sig = minhash.dart_signatures(slots, doc, 3, 4096)
    assert abs((sig[0] == sig[1]).mean() - similarity(counts(a), counts(b))) < 0.035
    assert (sig[2] == 0).all() and (sig[:2] != 0).all()
    assert minhash.shingle_slots(pa.array([], pa.string()))[0].shape == (0,)
    assert np.bincount(doc).tolist() == [sum(counts(a).values()), sum(counts(b).values())]


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(3, text, "a"), (1, text, "b"), (2, "other words here", "c"), (None, text, "d"), (4, None, "e")], "doc_id long, text string, id string")
    assert sorted(map(str, minhash.keep_one(df).select("doc_id", "id").collect())) == sorted(map(str, df.where("doc_id is null or doc_id <> 3").select("doc_id", "id").collect()))
    assert minhash.keep_one(df.limit(0)).count() == 0
