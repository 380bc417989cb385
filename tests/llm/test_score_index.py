"""Exact top-k search against all inner products."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from latticework.llm import score_index as I

SCHEMA = "vec_id long, embedding array<float>, label int, block int, at int, score string"


def brute(rows, k):
    good = [(n, i, [math.floor(64 * float(np.float32(x))) for x in v]) for n, (i, v, *_) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in good:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, j, v in good if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def rows_of(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [rng.gauss(0, 0.12) for _ in range(16)]
        if i % 9 == 0:
            v = [0.25] * 16  # ties
        out.append((i, v, 1, 5, 6, "x"))
    odd = [(None, [0.1] * 16), (n + 20 - n % 20, None), (4, [None] * 16), (5, [float("nan")] * 16), (6, [float("inf")] * 16), (20, []), (40, [9.5, -3.0]), (20, [0.25] * 16), (20, [0.25] * 16), (60, [4000.0] + [0.0] * 20)]
    return out + [(*x, 1, 5, 6, "x") for x in odd]


@pytest.mark.parametrize(("block", "group"), [(8192, 2048), (32, 8)])
def test_against_all_pairs(spark, monkeypatch, block, group):
    """Nulls, ties, repeated ids and rows, unequal lengths, large components; one block or many."""
    monkeypatch.setattr(I, "BLOCK", block)
    monkeypatch.setattr(I, "GROUP", group)
    rows = rows_of(300)
    index = I.build(spark.createDataFrame(rows, SCHEMA).repartition(3), "vec_id", "embedding", F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, I.search(index).collect())) == brute(rows, 20)


def test_few_rows_and_none(spark):
    rows = rows_of(8)[:8]
    make = lambda r: I.search(I.build(spark.createDataFrame(r, SCHEMA), "vec_id", "embedding", F.col("vec_id") % 20 == 0))
    assert sorted(map(tuple, make(rows).collect())) == brute(rows, 20)
    assert make([]).collect() == [] and make(rows[1:3]).collect() == []


def test_segments_hold_every_component():
    v = np.random.default_rng(1).integers(-500, 500, (70, 9))
    signed, dim, slots = I.segments(v)
    assert list(np.abs(signed)) == sorted(np.abs(signed), reverse=True)
    back = np.zeros(v.shape)
    for s, d, rows in zip(signed, dim, slots):
        back[rows, d] = I.value_of(np.abs(s)) * np.sign(s)
    assert (np.abs(back - v) <= np.abs(v) / 8).all() and (back[np.abs(v) < 8] == v[np.abs(v) < 8]).all()


def test_most_pairs_are_proven_out():
    """Only few pairs of random vectors are scored exactly, and the last rounds are not needed."""
    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(0, 8, (4096, 64))).astype(np.int64)
    rounds = I._rounds(*I.segments(rows), rows.shape)
    none = np.full(200, -1)
    i, j, score, did = I.search_cell(rows, np.arange(4096), rounds, rows[:200] + 1, none, np.full(200, -np.inf), 20)
    all_ = (rows[:200] + 1) @ rows.T
    want = np.lexsort((np.broadcast_to(np.arange(4096), all_.shape), -all_), axis=1)[:, :20]
    assert [sorted(j[i == q]) for q in range(200)] == [sorted(x) for x in want]
    assert did["exact"] < 0.03 * did["pairs"], did
