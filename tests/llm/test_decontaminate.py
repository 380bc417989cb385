"""Decontamination against all windows and items by brute force."""

import random
import re
from collections import Counter

import numpy as np

from latticework.llm import decontaminate


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def bag(w):
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(text, items):
    bags = {i: bag(words(t)) for i, t in items.items()}
    df = Counter(s for b in bags.values() for s in b)
    weight = lambda s: 1 + 1 / max(1, df[s])
    w, out = words(text), {}
    for i, t in items.items():
        n = len(words(t))
        for p in range(len(w) - n + 1 if n else 0):
            b = bag(w[p : p + n])
            both = sum(weight(s) * c for s, c in (b & bags[i]).items())
            if both and both / sum(weight(s) * c for s, c in (b | bags[i]).items()) >= 0.8 - 1e-12:
                out[i] = max(out.get(i, 0), both / sum(weight(s) * c for s, c in (b | bags[i]).items()))
    return out


def test_against_all_windows(spark, sf_dir, monkeypatch):
    rng = random.Random(3)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    real = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text) < 4000][:120]
    texts = [None, "", "short text", *real]
    for i, t in items.items():
        w = t.split()
        texts.append(" ".join(real[i].split()[:30] + w + real[i].split()[30:]).upper())
        for k in range(1, 3):
            v = list(w)
            for _ in range(k):
                v[rng.choice([0, 1, len(v) - 1])] = "other"
            texts.append("intro words here " + " ".join(v) + " and then more")
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, hits string").repartition(3)
    for slices in (1, 3):
        monkeypatch.setattr(decontaminate, "MAX_INDEX_ITEMS", 20_000 if slices == 1 else 15)
        got = {r.doc_id: {h.item_id: h.similarity for h in r.hits_} for r in decontaminate.find(docs, bench).collect()}
        assert len(got) == len(texts)
        missed = 0
        for k, t in enumerate(texts):
            if slices == 1:
                want = brute(t, items)
                assert set(got[k]) <= set(want)
                missed += len(set(want) - set(got[k]))
                assert all(abs(got[k][i] - want[i]) < 1e-9 for i in got[k])
            verbatim = [i for i, x in items.items() if " ".join(words(x)) in " ".join(words(t))]
            assert set(verbatim) <= set(got[k])
        assert missed == 0


def test_blocks_find_all_within_the_radius_and_little_else():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 40)) for _ in range(300)]
    index = decontaminate.Index(list(range(300)), texts)
    size = 40
    random_prints = rng.integers(0, 1 << 63, (2000, 2), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (2000, 2), dtype=np.uint64)
    w, _ = index.candidates(size, random_prints)
    assert len(w) < 0.001 * len(random_prints) * len(texts)
    near, want = [], set()
    for k in range(600):  # prints at every distance up to a little more than the radius
        p = index.prints[k % 300].copy()
        for bit in rng.choice(128, k % (decontaminate.RADIUS + 4), replace=False):
            p[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        near.append(p)
    near = np.array(near)
    for k in range(len(near)):
        d = np.bitwise_count(index.prints ^ near[k]).sum(1)
        want |= {(k, int(i)) for i in np.flatnonzero(d <= decontaminate.RADIUS)}
    w, i = index.near(size, near)
    assert set(zip(w.tolist(), i.tolist())) == want and len(want) > 500


def test_columns_by_name(spark):
    bench = spark.createDataFrame([("alpha beta gamma delta epsilon zeta eta", 5, "x")], "question string, no int, item_id string")
    docs = spark.createDataFrame([("h", "so alpha beta gamma delta epsilon zeta eta it is", 3), (None, "other words", 4)], "hits string, body string, item_id int")
    got = decontaminate.find(docs, bench, text_col="body", item_col="no", item_text_col="question")
    assert got.columns == ["hits", "body", "item_id", "hits_"]
    assert sorted((r.item_id, [h.item_id for h in r.hits_]) for r in got.collect()) == [(3, [5]), (4, [])]
    own = docs.withColumnRenamed("body", "text")
    real = spark.createDataFrame([(9, "alpha beta gamma delta epsilon zeta eta")], "item_id long, text string")
    monkey = decontaminate.table
    try:
        decontaminate.table = lambda *_: real
        assert [r.item_id for r in decontaminate.stage(spark, own, "").collect()] == [4]
    finally:
        decontaminate.table = monkey


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a tiny item here"), (1, "a tiny item here"), (None, "x " * 50000), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "Tiny item"), (8, None), (9, "")], "item_id long, text string")
    rows = decontaminate.find(docs, bench).collect()
    assert sorted(len(r.hits) for r in rows) == [0, 0, 1, 1]
    assert decontaminate.find(docs.limit(0), bench).count() == 0
    assert all(not r.hits for r in decontaminate.find(docs, bench.limit(0)).collect())


def brute_short(text, items):
    """As brute, and a text shorter than an item is its one window."""
    out, w = brute(text, items), words(text)
    bags = {i: bag(words(t)) for i, t in items.items()}
    df = Counter(s for b in bags.values() for s in b)
    weight = lambda s: 1 + 1 / max(1, df[s])
    for i, b in bags.items():
        if len(w) < len(words(items[i])):
            own = bag(w)
            s = sum(weight(x) * c for x, c in (own & b).items()) / sum(weight(x) * c for x, c in (own | b).items())
            if s >= 0.8 - 1e-12:
                out[i] = s
    return out


def test_texts_shorter_than_an_item(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    texts = [" ".join(w[a : len(w) - b]) for w in (t.split() for t in items.values()) for a, b in ((0, 1), (2, 0), (1, 3), (0, 12), (0, len(w) - 4))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {h.item_id: h.similarity for h in r.hits} for r in decontaminate.find(docs, bench).collect()}
    n_short = 0
    for k, t in enumerate(texts):
        want = brute_short(t, items)
        assert set(got[k]) == set(want) and all(abs(got[k][i] - want[i]) < 1e-9 for i in want)
        n_short += any(len(words(t)) < len(words(items[i])) for i in want)
    assert n_short >= 2 * len(items)


def test_slices_do_not_change_similarities(spark, monkeypatch):
    rng = random.Random(5)
    common = [[f"c{k}x{j}" for j in range(14)] for k in range(3)]
    items = [(k, " ".join(common[k % 3] + [f"i{k}x{j}" for j in range(20)] + common[(k + 1) % 3])) for k in range(12)] + [(99, None)]
    texts = []
    for _, t in items[:-1]:
        for n in (1, 2):
            v = t.split()
            for _ in range(n):
                v[rng.randrange(len(v))] = "other"
            texts += ["some words before " + " ".join(v) + " and behind", " ".join(v[2:])]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = []
    for most in (20_000, 5):
        monkeypatch.setattr(decontaminate, "MAX_INDEX_ITEMS", most)
        found.append({r.doc_id: sorted((h.item_id, round(h.similarity, 12), h.start, h.length) for h in r.hits) for r in decontaminate.find(docs, bench).collect()})
    assert found[0] == found[1] and sum(map(len, found[0].values())) > 5
    for k, t in enumerate(texts):
        want = brute_short(t, dict(items))
        assert all(abs(s - want[i]) < 1e-9 for i, s, _, _ in found[1][k])
