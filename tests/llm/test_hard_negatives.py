"""Hard negatives against all pairs; curve, zone maps and windows on their own."""

import itertools
import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from latticework.llm import hard_negatives as N
from latticework.llm import vectors as V

SCHEMA = "vec_id long, label int, embedding array<float>, block int, score string"


def brute(rows):
    good = [(n, i, b, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, b, v, *_) in enumerate(rows) if i is not None and b is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, b, q in good:
        if i % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), j, c) for m, j, c, v in good if m != n)
            for p, j, _ in [x for x in scored if x[2] == b][:5]:
                fits = [(s, x) for s, x, c in scored if c != b and 80 * -p <= 100 * -s <= 100 * -p]
                out += [(i, j, r + 1, x, -p, -s) for r, (s, x) in enumerate(fits[:5])]
    return sorted(out)


def rows_of(n, seed=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(12)] for _ in range(6)]
    out = []
    for i in range(n):
        c = centres[i % 6] if i % 5 else [0.0] * 12
        v = [x + rng.gauss(0, 0.05) for x in c] if i % 11 else [0.25] * 12
        out.append((i * 10 % (10 * n) if i % 3 else i * 50, rng.randrange(3), v, 1, "x"))
    odd = [(None, 1, [0.1] * 12), (100, None, [0.1] * 12), (200, 1, None), (300, 1, [None] * 12), (400, 2, [float("nan")] * 12), (500, 2, []), (600, 0, [9.5, -3.0]), (100, 1, [0.25] * 12), (100, 1, [0.25] * 12), (700, 1, [300.0] + [0.0] * 20), (800, 77, [0.3] * 12)]
    return out + [(*x, 1, "x") for x in odd]


def mined(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return N.mine(df.select("vec_id", "label", V.whole(F.col("embedding"), 256).alias("v")), F.col("vec_id") % 100 == 0)


@pytest.mark.parametrize(("block", "zones", "group"), [(512, 256, 1024), (4, 2, 3)])
def test_against_all_pairs(spark, monkeypatch, block, zones, group):
    """Nulls, ties, repeated ids and rows, unequal lengths, negative positives; one block or many."""
    for name, x in (("BLOCK", block), ("ZONES", zones), ("GROUP", group)):
        monkeypatch.setattr(N, name, x)
    rows = rows_of(400)
    want = brute(rows)
    assert sorted(map(tuple, mined(spark, rows).collect())) == want and len(want) > 100


def test_nothing_to_mine(spark):
    assert mined(spark, []).collect() == []
    assert mined(spark, [(1, 1, [0.5], 1, "x"), (2, 2, [0.5], 1, "x")]).collect() == []
    assert mined(spark, [(100, 1, [], 1, "x"), (2, 2, [], 1, "x")]).collect() == []
    assert mined(spark, [(100, 1, [0.5], 1, "x"), (2, 1, [0.5], 1, "x")]).collect() == []


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    order = sorted(range(len(cells)), key=lambda k: N.hilbert(cells, bits)[k].tobytes())
    walk = cells[order]
    assert len({x.tobytes() for x in N.hilbert(cells, bits)}) == len(cells)
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_choose():
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (40, 16))
    rows = np.repeat(centres, 32, axis=0) + rng.integers(-5, 5, (40 * 32, 16))
    label = rng.integers(0, 3, len(rows))
    lo, hi = (f.reduceat(rows, np.arange(0, len(rows), 32), axis=0) for f in (np.minimum, np.maximum))
    labels = [np.unique(label[a : a + 32]).tolist() for a in range(0, len(rows), 32)]
    q, own = rows[::100], label[::100]
    score = q @ rows.T
    top = np.sort(score, axis=1)[:, -20:]
    ends = top[:, :1], top[:, -1:]
    for same in (True, False):
        must = N.needed(q, own, ends, (lo, hi, labels), same)
        hit = (score >= ends[0]) & (score <= ends[1]) & ((own[:, None] == label[None]) == same)
        assert not (hit.reshape(len(q), 40, 32).any(2) & ~must).any()  # no block with a fitting row is left out
        assert must.mean() < 0.3
