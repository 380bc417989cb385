"""N-gram join against all pairs by brute force."""

import random
import re

import numpy as np
import pyarrow as pa

from latticework.llm import ngram_join, shingles


def brute(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})
    n = len(texts)
    links, label = [0] * n, list(range(n))
    pairs = [(i, j) for i in range(n) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    copies = [next((j for j in range(n) if sets[j] == sets[i]), i) if sets[i] else i for i in range(n)]
    return links, label, copies


def check(spark, texts):
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, digest int").repartition(5)
    rows = {r.doc_id: r for r in ngram_join.join(docs).collect()}
    links, label, copies = brute(texts)
    assert len(rows) == len(texts)
    for k in range(len(texts)):
        assert (rows[k].n_links, rows[k].class_id, rows[k].copy_id) == (links[k], label[k], copies[k]), (k, rows[k])


def test_real_documents(spark, sf_dir):
    check(spark, [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()])


def test_edges_and_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    texts = [None, "", " \n", "a b", "a  b", "a b c d e", "a b c d e f", "x " * 30000, "x " * 40000]
    for k in range(60):
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(120)] = f"v{rng.randrange(9999)}"
        texts.append(" ".join(w))
    texts += [" ".join(base)] * 30
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    check(spark, texts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(docs).count() == 0


def test_words_of_a_sliced_batch():
    texts = pa.array(["skip", "a b", None, "é x\ty  ", "", "end"])[1:]
    first, hashes, a, b = shingles.words(texts)
    assert list(np.diff(first)) == [2, 0, 3, 0, 1]
    again = shingles.words(pa.array(["b a"]))[1]
    assert hashes[0] == again[1] and hashes[1] == again[0]
    folded = shingles.words(pa.array(["Été, ÉTÉ! été"]), folded=True)[1]
    assert len(set(folded)) == 1


def test_prune_limits():
    least = ngram_join.least_matches(0.8)
    assert (np.diff(least) > 0).all() and least[-1] < 0.8 * ngram_join.COMPARED


def test_words_of_one_polynomial_hash(spark):
    """Words that a polynomial modulo 2**64 cannot tell apart are not copies; long and short words have hashes of their own."""
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    texts = [a, b, a[:1024], b[:1024], a[:256], b[:256], "x", "x" * 8, "x" * 9, "x" * 16, "x" * 17, "x" * 256, "x" * 257, "xy", "yx", "a\0", "a", "a\0\0"]
    _, hashes, _, _ = shingles.words(pa.array([" ".join(texts), *texts]))
    assert len(np.unique(hashes)) == len(texts) and (hashes[: len(texts)] == hashes[len(texts) :]).all()
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    rows = {r.doc_id: r for r in ngram_join.join(docs).collect()}
    assert [rows[k].n_links for k in (1, 2)] == [0, 0] and rows[1].copy_id != rows[2].copy_id
