import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import idcoder, tokenfile
from tessella.llm.tokenize import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["½ naïve İ ΑΣ \x85 a　b", "don't we'll  \n\n x 'S 12345 !!'s", "ß ÀÉ…“x” —y", "<|endoftext|>", "a <|endoftext|> b", "", None]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(spark, sf, name):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    for text, ids in zip(texts, WordTokenizer(path).encode(texts), strict=True):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 300, 5000, 70_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) - 1, 49_407)
    ids[n // 2 :] = ids[: n - n // 2]
    data = idcoder.encode_block(ids, 49_408)
    out, end = idcoder.decode_block(b"xx" + data, 2)
    assert (out == ids).all() and end == len(data) + 2
    if n == 70_000:
        assert len(data) < 1.6 * n
        broken = bytearray(data)
        broken[len(data) // 2] ^= 4
        with pytest.raises(ValueError):
            idcoder.decode_block(bytes(broken))


def test_file_holds_all_documents_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(list(enumerate(ODD, 5000)) + [(7, "again"), (None, "first")], "doc_id long, text string"))
    path = f"file:///tmp/checkpoints/tessella/tokens-{uuid.uuid4().hex}"
    tokenfile.write(docs, path, PATH, 49_408, end_id=2, files=5)
    rows = sorted(tokenfile.read(spark, path).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(PATH)
    want = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    at = 0
    for r, d in zip(rows, want, strict=True):
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (d.doc_id, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)


def test_empty(spark):
    path = f"file:///tmp/checkpoints/tessella/tokens-{uuid.uuid4().hex}"
    tokenfile.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH, 49_408, end_id=2)
    assert tokenfile.read(spark, path).count() == 0


def test_a_large_block_takes_few_steps(monkeypatch):
    """Two million ids are coded in about 130 steps over all lanes (512 before), and come back whole; ids are found as a search finds them."""
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.zipf(1.3, 1 << 21), 49_407).astype("<u4")
    steps = []
    look = idcoder._Model.look
    monkeypatch.setattr(idcoder._Model, "look", lambda m, *a: steps.append(1) or look(m, *a))
    blocks = [idcoder.encode_block(ids[i : i + idcoder.BLOCK_IDS], 49_408) for i in range(0, len(ids), idcoder.BLOCK_IDS)]
    assert len(steps) < 150
    assert (np.concatenate([idcoder.decode_block(b)[0] for b in blocks]) == ids).all()
    model = idcoder._Model(49_408)
    model.counts += np.bincount(ids[:70_000], minlength=49_408)
    model._rebuild()
    values = np.concatenate((rng.integers(0, 1 << 22, 20_000), [0, (1 << 22) - 1], model.cum[:-1], model.cum[1:] - 1))
    assert (model.find(values) == np.searchsorted(model.cum, values, side="right") - 1).all()


def test_coding_and_reading_do_no_needless_work(spark, sf, monkeypatch):
    """Half a million ids are mixed for in few rows, into fewer bytes than mixing in every row took; damage is told; ids that nobody wants stay in the worker."""
    rng = np.random.default_rng(6)
    ids = np.minimum(rng.zipf(1.3, 1 << 19), 49_407).astype("<u4")
    ids[1 << 18 :] = ids[: 1 << 18]
    mixed = []
    mix = idcoder._Model.mix
    monkeypatch.setattr(idcoder._Model, "mix", lambda m: mixed.append(1) or mix(m))
    block = idcoder.encode_block(ids, 49_408)
    assert len(mixed) < 50 and (idcoder.decode_block(block)[0] == ids).all()
    for at in (30, len(block) // 2, len(block) - 3):
        with pytest.raises(ValueError):
            idcoder.decode_block(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :])
    path = f"file:///tmp/checkpoints/tessella/tokens-{uuid.uuid4().hex}"
    tokenfile.write(spark.read.parquet(f"{sf}/documents.parquet").limit(50), path, PATH, 49_408, end_id=2, files=2)
    bare, whole = tokenfile.read(spark, path, with_ids=False), tokenfile.read(spark, path)
    assert sorted(bare.collect()) == sorted(whole.drop("ids").collect()) and bare.columns == whole.columns[:-1] and bare.count() == 50


def test_words_of_every_character_cut_here_are_the_librarys():
    """Each character of texts that are cut here, alone and inside words, gives the library's ids by way of its model."""
    from tessella.llm import tokenize

    signs = [chr(c) for c in range(0x2100) if tokenize._SAFE.fullmatch(chr(c))]
    texts = ["".join(signs), *signs, *[f"ab{c}d e{c}{c} {c}x9" for c in signs]]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        library, words = Tokenizer.from_file(path), WordTokenizer(path)
        assert [x.tolist() for x in words.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert words.memory.held > 0
