"""The inverted file and the Hamming table against searches of everything."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from latticework.operators import hashes as H
from latticework.operators import inverted as I
from latticework.operators import similarity as S
from latticework.plans import similarity as plans

SF01 = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("k", "grid", "masked"), [(6, (8, 8), False), (10, None, True)])
def test_recall(spark, k, grid, masked):
    evals, corpus, _ = plans._split(spark, SF01)
    index = I.build(corpus, masked=masked)
    probes = I.probes_needed(evals, corpus, index, k, grid)
    found = I.top_matches(evals, index, k, probes, grid)
    true = S.top_matches(evals, corpus, k, grid=grid, masked=masked)
    got = I.recall(found, true).first()
    assert got.n_true == 100 * k and got.recall >= 0.9
    assert probes < len(index.centroids)


def test_a_third_of_the_rows_in_one_cell(spark, monkeypatch):
    """A crowded cell is split, and with all cells probed the index is the exact search."""
    monkeypatch.setattr(I, "CELL_ROWS", 50)
    monkeypatch.setattr(I, "CELL_EVALS", 3)
    rng = np.random.default_rng(1)
    rows = [(k, ([1.0] * 8 if k % 3 == 0 else rng.normal(0, 1, 8).tolist())) for k in range(600)] + [(601, [0.0] * 8)]
    corpus = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(5)
    evals = corpus.where("vec_id % 20 = 0")
    index = I.build(corpus)
    assert index.parts.agg(F.max("parts")).first()[0] > 3
    found = I.top_matches(evals, index, 5, len(index.centroids))
    key = lambda df: sorted((r.eval_id, r["rank"], r.vec_id, round(r.score, 8)) for r in df.collect())
    want = key(S.top_matches(evals, corpus, 5))
    assert key(found) == want and len(want) == 150
    monkeypatch.setattr(S, "BLOCK", 40)
    monkeypatch.setattr(S, "GROUP", 7)
    assert key(S.top_matches(evals, corpus, 5)) == want


def test_empty_sides(spark):
    none = spark.createDataFrame([], "vec_id long, v array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, v array<double>")
    assert S.top_matches(none, one, 3).collect() == [] and S.top_matches(one, none, 3).collect() == [] and S.top_matches(one, one, 3).collect() == []
    index = I.build(one)
    assert I.probes_needed(one, one, index, 3) == 1 and I.top_matches(none, index, 3, 1).collect() == []


def hash_rows(n, seed):
    rng = np.random.default_rng(seed)
    h = rng.integers(-(1 << 63), (1 << 63) - 1, n)
    h[::3] = 77  # a third is one hash
    h[1::10] = h[2] ^ (1 << rng.integers(0, 62, len(h[1::10])))
    return [(i, int(x), int(n - i)) for i, x in enumerate(h)]


def test_nearest_hash(spark):
    rows = hash_rows(300, 2)
    corpus = spark.createDataFrame(rows, "vec_id long, phash long, frame_idx long")
    evals = corpus.where("vec_id % 7 = 0")
    got = {r.eval_id: (r.vec_id, r.distance) for r in H.nearest(evals, corpus).collect()}
    far = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    for i, h, _ in rows:
        if i % 7 == 0:
            d, _, j = min((far(h, x), place, j) for j, x, place in rows if j != i)
            assert got[i] == (j, d)


@pytest.mark.parametrize("radius", [0, 3, 9, 18])
def test_within(spark, radius):
    rows = hash_rows(120, 3)
    corpus = spark.createDataFrame(rows, "vec_id long, phash long, frame_idx long")
    evals = corpus.where("vec_id % 4 = 0")
    got = sorted(map(tuple, H.within(evals, corpus, radius).collect()))
    far = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    assert got == sorted((i, j, far(h, x)) for i, h, _ in rows if i % 4 == 0 for j, x, _ in rows if i != j and far(h, x) <= radius)


def test_fewer_rows_than_pairs():
    """Random hashes within 21 bits: probes meet a third of the pairs, against more than all of them by bands of two or three bits."""
    per_quarter = [len(H.changes(range(0, m + 1))) / (1 << H.BITS) for m in (5, 5, 4, 4)]
    assert sum(per_quarter) < 0.3


def test_probes_are_not_broadcast(spark):
    """Some hundreds of probes for each query come from a small table: they must not be collected for a broadcast."""
    rows = spark.createDataFrame(hash_rows(300, 5), "vec_id long, phash long, frame_idx long")
    asked = H.probes(rows.select(F.col("vec_id").alias("eval_id"), F.col("phash").alias("_a")), "_a", [range(0, 3)] * 4)
    met = H._met(asked, H.table(rows.select(F.col("phash").alias("_b")).distinct(), "_b"))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
