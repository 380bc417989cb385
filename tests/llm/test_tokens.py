"""Encoding against the tokenizers library, coder and file round trips."""

import functools
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import bpe, range_coder, token_file

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids_ string"


tokenizer = functools.cache(bpe.tokenizer)


def library(path, texts):
    return [e.ids for e in tokenizer(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_real_documents(spark, sf_dir, name):
    path = bpe.public_path(name)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [x.tolist() for x in bpe.Encoder(path).encode(texts)]
    assert got == library(path, texts)


@pytest.mark.parametrize("name", FILES)
def test_hard_texts(name):
    path, rng = bpe.public_path(name), random.Random(1)
    texts = ["", " ", "<|endoftext|> a <|startoftext|>", "it's WE'LL 's''s'", "a\x1cb\x85c\xa0d", "İSTANBUL ΣΑΣ ǅ", "é é", "  two  spaces \n\n x", "日本語 12345 ½²", "😀🎉 ok"]
    for n in (300, 600, 1500, 5000):
        texts += ["a" * n, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)), "thething" * (n // 8), "é" * n, "=-" * (n // 2), " " * n + "x", "1" * n, "".join(rng.choice("éàüß日本語д") for _ in range(n))]
    for long, leaf in ((512, 256), (16, 8), (40, 3)):
        got = [x.tolist() for x in bpe.Encoder(path, long=long, leaf=leaf).encode(texts)]
        for t, a, b in zip(texts, got, library(path, texts)):
            assert a == b, (long, t[:40])


ALPHABET = st.sampled_from(list("ab's tremvldE  \n1é.-<|") + ["'ll", "'ve", "  ", "<|endoftext|>", "word "])


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.lists(ALPHABET, max_size=60), max_size=4), leaf_text=st.integers(1, 9))
def test_text_trees(name, parts, leaf_text):
    """Leaves of a few characters, so that every cut, contraction and run of white space meets a join."""
    texts = ["".join(x) for x in parts]
    if (name, leaf_text) not in _small:
        _small[name, leaf_text] = bpe.Encoder(bpe.public_path(name), leaf_text=leaf_text)
    enc = _small[name, leaf_text]
    before = enc.joins
    assert [x.tolist() for x in enc.encode(texts)] == library(bpe.public_path(name), texts)
    assert enc.joins > before or all(len(t) <= leaf_text or "<|" in t for t in texts)


_small: dict = {}


def test_documents_go_through_trees(spark, sf_dir):
    """With the production leaf size, long documents of the table are joined from leaves."""
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    enc = bpe.Encoder(bpe.public_path(FILES[1]))
    assert [x.tolist() for x in enc.encode(texts)] == library(bpe.public_path(FILES[1]), texts)
    assert enc.joins >= sum(-(-len(t) // bpe.LEAF_TEXT) - 1 for t in texts) > 0


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(name, text):
    enc = bpe.encoder(bpe.public_path(name))
    ids = enc.encode([text])[0]
    assert ids.tolist() == library(bpe.public_path(name), [text])[0]
    assert enc.decode([ids])[0] == tokenizer(bpe.public_path(name)).decode(ids.tolist(), skip_special_tokens=False)


def test_small_table(spark, sf_dir):
    path = bpe.public_path(FILES[0])
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30).collect()]
    enc = bpe.Encoder(path, kept=50)
    assert [enc.encode([t])[0].tolist() for t in texts] == library(path, texts)


def test_encode_decode_query(spark, sf_dir):
    path = bpe.public_path(FILES[1])
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = bpe.query(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    tok = bpe.tokenizer(path)
    for r, ids in zip(rows, library(path, [docs[r.doc_id] for r in rows])):
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_decode_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (1, "word " * 30000, "z"), (2, "q" * 9000, None)], SCHEMA)
    rows = bpe.encode_decode(docs, bpe.public_path(FILES[1])).collect()
    assert sorted(len(r.ids) > 0 for r in rows) == [False, False, True, True] and {r.ids_ for r in rows} == {"x", "y", "z", None}
    assert bpe.encode_decode(docs.limit(0), bpe.public_path(FILES[1])).count() == 0


def test_coder_round_trip(monkeypatch):
    rng = np.random.default_rng(2)
    blocks = [np.minimum(rng.zipf(1.2, n), 50256) for n in (0, 1, 2, 255, 700, 5120, 90_000)] + [np.full(900, 7), np.array([0, (1 << 20) - 1, 65536, 131071, 1 << 19]), rng.integers(0, 1 << 20, 40_000)]
    blocks.append(np.tile(np.arange(60_000), 3))
    for lanes, least in ((range_coder.LANES, range_coder.LEAST), (7, 16), (1, 1)):
        monkeypatch.setattr(range_coder, "LANES", lanes)
        monkeypatch.setattr(range_coder, "LEAST", least)
        for b in blocks if lanes > 1 else blocks[:6]:
            coded = range_coder.encode(b.astype(np.uint32))
            assert (range_coder.decode(coded, len(b)) == b).all()
            assert range_coder.encode(b.astype(np.uint32)) == coded  # nothing is left of the blocks before
    with pytest.raises(ValueError):
        range_coder.encode(np.array([1 << 20]))
    with pytest.raises(ValueError):
        range_coder.decode(coded[:-2], len(b))


def test_coder_is_smaller_than_zlib(spark):
    """Whole documents of the 0.01 table: bytes of the coded blocks against zlib on the same blocks."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    ids, _ = bpe.encoder(bpe.public_path(FILES[0])).encode_flat(texts)
    for size in (4096, 1 << 17):
        blocks = [ids[k : k + size] for k in range(0, min(len(ids), 40 * size), size)]
        assert sum(len(range_coder.encode(b)) for b in blocks) < 0.9 * sum(len(zlib.compress(b.tobytes(), 6)) for b in blocks)


def test_crc_of_parts():
    data = np.random.default_rng(3).bytes(5000)
    for cuts in ([], [0], [1], [100, 100, 4000], [4999]):
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        assert token_file.crc_of_parts([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(data)


def test_token_file(spark, sf_dir, tmp_path):
    path = bpe.public_path(FILES[0])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(None, "first"), (100000, None), (100001, "long text " * 20000)], "doc_id long, text string")).repartition(4)
    token_file.write(docs, str(tmp_path / "f"), path, block_ids=16_000)
    assert token_file.read_pieces(spark, str(tmp_path / "f"), with_ids=False).where("seq > 1").count()
    rows = sorted(token_file.summary(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert [r.doc_id for r in rows] == sorted(texts, key=lambda k: -1 if k is None else k)
    start = 0
    for r, ids in zip(rows, library(path, [texts[r.doc_id] for r in rows])):
        ids = np.array(ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    empty = docs.limit(0)
    token_file.write(empty, str(tmp_path / "e"), path)
    assert token_file.summary(spark, str(tmp_path / "e")).count() == 0


def test_names_that_are_taken(spark):
    docs = spark.createDataFrame([(1, "some words", "own", "mine")], "doc_id long, text string, ids string, Decoded string")
    (row,) = bpe.encode_decode(docs, bpe.public_path(FILES[1])).collect()
    assert (row.ids, row.Decoded, row.decoded_) == ("own", "mine", "some</w> words</w>") and len(row.ids_) == 2


def thue_morse(n):
    """Two words that every polynomial hash modulo 2**64 takes for one."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("name", FILES)
def test_words_of_one_polynomial_hash(name):
    texts = [w for n in (256, 512, 1024, 2048, 4096) for w in thue_morse(n)]
    got = [x.tolist() for x in bpe.Encoder(bpe.public_path(name)).encode([*texts, " ".join(texts)])]
    assert got == library(bpe.public_path(name), [*texts, " ".join(texts)])


@pytest.mark.parametrize("name", FILES)
def test_pieces_that_share_a_hash(monkeypatch, name):
    """With hashes of four bits nearly all pieces meet another one in the table."""
    from latticework.llm import pieces

    whole = pieces.hashes_of
    monkeypatch.setattr(pieces, "hashes_of", lambda *x: (whole(*x) & np.uint64(15)) + np.uint64(1))
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 300))) for _ in range(40)) for _ in range(6)]
    enc = bpe.Encoder(bpe.public_path(name), leaf_text=500)
    for _ in range(2):
        assert [x.tolist() for x in enc.encode(texts)] == library(bpe.public_path(name), texts)
