import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def padded(lengths):
    return sum(n if n & (n - 1) == 0 else 1024 for n in lengths)


def test_short_documents_fill_sequences(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(4000)], "doc_id long, text string").coalesce(1)
    lengths = Counter()
    for r in packing.pack_documents(docs, PATH).collect():
        lengths[r.sequence_id] += r.length
    assert padded(lengths.values()) <= 1.05 * sum(lengths.values())


@pytest.mark.parametrize("cuttable", [True, False])
def test_loss_limit_binds_on_conversations(spark, sf, cuttable):
    """Assistant turns bear loss; repeated rows and clashing columns do no harm."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("conv_id * 1000 + turn as doc_id", "text", "role = 'assistant' as loss")
    turns = turns.union(turns.limit(5)).withColumns({c: F.lit("x") for c in ("offset", "start", "sequence_id")})
    bears = {r.doc_id: r.loss for r in turns.collect()}
    limits = (1024, 64, 200)
    rows = packing.pack_documents(turns, PATH, loss_col="loss", limits=limits, cuttable=cuttable).collect()
    sums = {}
    for r in rows:
        tokens, segments, loss = sums.get(r.sequence_id, (0, 0, 0))
        sums[r.sequence_id] = (tokens + r.length, segments + 1, loss + r.length * bears[r.doc_id])
    assert all(x <= y for s in sums.values() for x, y in zip(s, limits, strict=True))
    assert any(s[2] > 150 for s in sums.values())
    # Every id of every row, repeated ones too, lies in one piece.
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    if not cuttable:
        assert all(r.length == r.doc_tokens for r in rows if r.doc_tokens <= 200)


def test_every_id_once_and_no_gaps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "½ naïve <|endoftext|> x"), (None, "no id"), (9004, "word " * 20000)] + [(10_000 + i, "") for i in range(3000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(odd)
    t = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(docs, PATH).collect()
    ids = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4") for r in docs.collect()}
    seen, sequences = {}, {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for group, length_of in ((seen, lambda k: len(ids[k])), (sequences, lambda k: None)):
        for key, pieces in group.items():
            at = 0
            for start, length in sorted(pieces):
                assert start == at and length > 0
                at += length
            assert at == length_of(key) if length_of(key) else at <= 1024
    assert set(seen) == set(ids) and all(len(p) <= packing.SEGMENTS for p in sequences.values())
    total = sum(map(len, ids.values()))
    # The contract pads a sequence to 1024, except at a power of two.
    assert padded(sum(n for _, n in p) for p in sequences.values()) <= 1.03 * total


@pytest.mark.parametrize("cuttable", [True, False])
def test_limits_hold_together(cuttable):
    rng = np.random.default_rng(3)
    placed = []
    p = packing.Packer(lambda *x: placed.append(x), limits=(100, 4, 30), cuttable=cuttable)
    loss = {i: rng.random(n) < rng.random() for i, n in enumerate(rng.integers(1, 250, 300))}
    for i, flags in loss.items():
        p.add(i, len(flags), flags)
    p.finish()
    assert sum(length for _, _, length, _, _ in placed) == sum(map(len, loss.values()))
    for s in {x[3] for x in placed}:
        mine = [x for x in placed if x[3] == s]
        assert len(mine) <= 4 and sum(x[2] for x in mine) <= 100
        assert sum(int(loss[e][a : a + n].sum()) for e, a, n, _, _ in mine) <= 30


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
