"""Numpy kernels against brute force and invariances."""

import itertools
import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.functions import kernels as K

RNG = np.random.default_rng(1)


def png(img: np.ndarray, filters=None) -> bytes:
    channels = 1 if img.ndim == 2 else img.shape[2]
    rows = img.reshape(img.shape[0], -1).astype(int)
    out, above = b"", np.zeros(rows.shape[1], int)
    for y, row in enumerate(rows):
        kind = filters[y % len(filters)] if filters else 0
        left = np.concatenate([np.zeros(channels, int), row[:-channels]])
        corner = np.concatenate([np.zeros(channels, int), above[:-channels]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        out += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_png():
    grey = RNG.integers(0, 256, (9, 13), dtype=np.uint8)
    assert (K.read_png(png(grey)) == grey).all() and (K.read_png(png(grey, [0, 1, 2, 3, 4])) == grey).all()
    rgb = RNG.integers(0, 256, (7, 5, 3), dtype=np.uint8)
    assert (K.read_png(png(rgb, [4, 3, 2, 1])) == rgb[:, :, 0]).all()
    for bad in (b"", b"GIF89a", png(grey)[:40]):
        with pytest.raises(ValueError):
            K.read_png(bad)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    rng = np.random.default_rng(seed)
    c = np.where(rng.random((n, m)) < 0.3, K.NO_MATCH, rng.random((n, m)) * 20)
    r, q = K.assign(c)
    assert len(r) == min(n, m) == len(set(r.tolist())) == len(set(q.tolist()))
    small = c if n <= m else c.T
    best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
    assert abs(c[r, q].sum() - best) <= 1e-9 * max(1, best)


def random_boxes(n, rng=RNG):
    xy = rng.integers(0, 60, (n, 2))
    return np.hstack([xy, xy + rng.integers(5, 40, (n, 2))]).astype(float)


@pytest.mark.parametrize("threshold", [0.1, 0.4])
def test_suppression(threshold):
    b = random_boxes(80)
    keep = K.nms(b, threshold)
    left = K.iou(b[keep], b[keep]) - np.eye(keep.sum())
    assert left.max() <= threshold and K.nms(b[keep], threshold).all()
    for k in np.flatnonzero(~keep):
        assert (K.iou(b[k : k + 1], b[keep & (np.arange(80) < k)]) > threshold).any()
    assert K.iou(np.array([[0, 0, 0, 5.0]]), np.array([[0, 0, 0, 5.0]]))[0, 0] == 0


def test_fusion():
    b = np.array([[0, 0, 10, 10], [1, 0, 11, 10], [50, 50, 60, 60.0]])
    boxes, scores, labels = K.fuse(b, np.array([0.8, 0.4, 0.6]), np.array([0, 0, 1]), np.array([0, 1, 1]), 2)
    assert len(boxes) == 2 and np.allclose(boxes[0], b[0] * 2 / 3 + b[1] / 3) and np.allclose(scores, [0.6, 0.3]) and labels.tolist() == [0, 1]
    # two boxes of one model are one model
    assert np.allclose(K.fuse(b, np.array([0.8, 0.4, 0.6]), np.array([0, 0, 1]), np.array([1, 1, 1]), 2)[1], [0.3, 0.3])


def plain_fusion(rows, models, limit=0.55):
    """Cluster by cluster with whole lists, rows (score, box, label, model) by falling score."""
    def iou(a, b):
        both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        whole = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
        return both / whole if whole > 0 else 0
    groups = []
    for row in rows:
        near = [(iou(row[1], mean(g)), -k) for k, g in enumerate(groups) if g[0][2] == row[2]]
        best = max(near, default=(0, 0))
        if best[0] > limit:
            groups[-best[1]].append(row)
        else:
            groups.append([row])
    return [(mean(g), sum(r[0] for r in g) / len(g) * min(len({r[3] for r in g}), models) / models, g[0][2]) for g in groups]


def mean(group):
    return [sum(r[0] * r[1][k] for r in group) / sum(r[0] for r in group) for k in range(4)]


@pytest.mark.parametrize("seed", range(12))
def test_fusion_against_plain_lists(seed):
    rng = np.random.default_rng(seed)
    n = 60
    b, sc = random_boxes(n, rng), np.sort(rng.random(n))[::-1]
    lab, mod = rng.integers(0, 2, n), rng.integers(0, 3, n)
    boxes, scores, labels = K.fuse(b, sc, lab, mod, 3)
    want = plain_fusion(list(zip(sc.tolist(), b.tolist(), lab.tolist(), mod.tolist())), 3)
    assert np.allclose(boxes, [w[0] for w in want]) and np.allclose(scores, [w[1] for w in want]) and labels.tolist() == [w[2] for w in want]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), max_size=40), st.integers(0, 20))
def test_decimation(hashes, t):
    keep, _ = K.decimate(np.array(hashes, np.int64), t)
    kept = [h for h, k in zip(hashes, keep) if k]
    d = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    assert all(d(a, b) > t for a, b in zip(kept, kept[1:])) and (not hashes or keep[0])
    a, last = K.decimate(np.array(hashes[:7], np.int64), t)
    b, _ = K.decimate(np.array(hashes[7:], np.int64), t, last)
    assert np.concatenate([a, b]).tolist() == keep.tolist()


def frame(h=512, w=1024):
    y, x = np.mgrid[0:h, 0:w]
    img = 90 + 80 * np.sin(x / 37.0) * np.cos(y / 23.0) + RNG.normal(0, 3, (h, w))
    img[:, :50] = 0
    return img.clip(0, 255).astype(np.uint8)


def test_fingerprints():
    img = frame()
    frac, sat, average, dyn, blank = K.quality(img)
    assert abs(average - img[img > 0].mean()) < 0.006
    assert 0.9 < frac < 0.96 and sat < 0.01 and not blank and K.quality(np.zeros((4, 4), np.uint8))[4]
    d = K.descriptor(img)
    assert d.shape == (2048,) and abs(d[d != 0].mean()) < 0.01 and (d == d.astype(np.float16)).all()
    assert not K.descriptor(np.zeros((512, 1024), np.uint8)).any()
    near = np.where(img > 0, img.astype(int) + 1, 0).clip(0, 255).astype(np.uint8)
    dist = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    assert dist(K.perceptual_hash(img), K.perceptual_hash(near)) <= 4 < dist(K.perceptual_hash(img), K.perceptual_hash(img[::-1, ::-1].copy()))
    assert -(1 << 63) <= K.perceptual_hash(img) < 1 << 63
    col, row = K.profiles(img)
    assert col.shape == (1024,) and row.shape == (512,) and not col[:50].any() and abs(col[60] - np.log1p(img[:, 60].astype(float)).mean()) < 0.01
    assert (K.stretch(np.ones((2, 2), np.uint8)) == 0).all() and K.stretch(img).max() == 255


def test_resize_and_regrid():
    img = RNG.random((8, 12))
    assert np.allclose(K.area_resize(img, 4, 6), img.reshape(4, 2, 6, 2).mean((1, 3))) and np.isclose(K.area_resize(img, 5, 7).mean(), img.mean())
    flat = np.full((40, 40), 7.0)
    p = K.polar(flat, 32, 64)
    assert np.allclose(p[p != 0], 7) and p[:, :40].all() and not p[0, -5:].any()
    rings = np.hypot(*np.mgrid[39:-1:-1, 0:40]) + 1
    p = K.polar(rings, 32, 64)
    assert abs(p[5, 20] - p[25, 20]) < 0.1  # a ring is a column
    assert K.quasi_polar(flat, 16, 32).shape == (16, 32)


def test_normalisations():
    img = frame(64, 64).astype(float)
    c = K.contrast(img)
    assert c.min() == 0 and c.max() <= 1 and (c[img == 0] == 0).all() and not K.contrast(np.zeros((3, 3))).any()
    assert np.isclose(K.rescale(img, "minmax")[img > 0].max(), 1) and abs(K.rescale(img, "z")[img > 0].mean()) < 1e-9
    a, b = K.augment(img / 255, 5), K.augment(img / 255, 5)
    assert (a == b).all() and not (a == K.augment(img / 255, 6)).all() and (a >= 0).all() and (a <= 1).all()
    two = K.augment(img / 255, 7, version=2)
    assert not two[:, :50].any()
    # version 2 flips, too, and its ramp may rise as well as fall
    flat = np.full((8, 400), 0.5)
    flat[:4] = 0.25
    flipped, rising = set(), set()
    for seed in range(60):
        a = K.augment(flat, seed, version=2)
        flipped.add(bool(a[:4].mean() > a[4:].mean()))
        rising.add(bool(a[:, 200:].mean() > a[:, :200].mean() + 0.01))
    assert flipped == rising == {True, False}
    r = K.resample_q(np.ones(1024), None)
    assert len(r) == 300 and r[0] == 1 and r[-1] == 0 and np.isclose(r.sum(), 270, atol=2)
    q = np.linspace(0, 5, 20)
    assert np.isclose(K.radial_profile(np.full((20, 20), 3.0), q, q).max(), np.log(4)) and K.angular_profile(np.full((20, 20), 3.0), q, q).max() <= np.log(4) + 1e-9


def test_descriptor_of_partly_covered_cells():
    """Cells are means over the zero-filled image, whatever share of them has data; the log needs 16 valid pixels."""
    img = np.zeros((64, 128))
    img[:, :100] = RNG.integers(5, 200, (64, 100))
    img[::3] = 0
    x = np.where(img > 0, np.log1p(img), 0).reshape(32, 2, 64, 2).mean((1, 3))
    good = (img > 0).reshape(32, 2, 64, 2).mean((1, 3)) > 0.5
    want = np.where(good, (x - x[good].mean()) / x[good].std(), 0).astype(np.float16)
    assert np.allclose(K.descriptor(img).reshape(32, 64), want, atol=2e-3)
    few = np.zeros((32, 64))
    few[0, :10] = np.arange(1, 11)
    assert np.allclose(K.descriptor(few)[:10], (few[0, :10] - 5.5) / np.std(np.arange(1, 11)), atol=2e-3)


def test_equalised_levels():
    levels = np.array([3, 3, 7, 7, 7, 200], np.uint8)
    assert K.equalise_levels(levels).tolist() == [0, 0, 191, 191, 191, 255] and K.equalise_levels(np.full(4, 9, np.uint8)).tolist() == [9] * 4


def test_cubic_regrid():
    y, x = np.mgrid[0:30, 0:40]
    p, r = K.polar_cubic(2.0 * x + 3 * y, 16, 32), np.linspace(0, np.hypot(29, 39), 32)
    a = np.linspace(0, np.pi / 2, 16)
    inside = (np.outer(np.cos(a), r) < 37) & (np.outer(np.sin(a), r) < 27) & (np.outer(np.cos(a), r) > 2) & (np.outer(np.sin(a), r) > 2)
    assert np.allclose(p[inside], (2 * np.outer(np.cos(a), r) + 3 * np.outer(np.sin(a), r))[inside], atol=0.4)  # a plane stays nearly one
    assert K.polar_cubic(np.eye(30), 16, 32)[0, 0] == 1


def resized(img, m, along):
    """One pass of the reduction, pixel by pixel in whole numbers."""
    lines = img if along else img.T
    n = lines.shape[1]
    scale = n / m
    wide = max(scale, 1.0)
    out = np.zeros((len(lines), m), int)
    for k in range(m):
        centre = (k + 0.5) * scale
        at = range(max(int(centre - 3 * wide + 0.5), 0), min(int(centre + 3 * wide + 0.5), n))
        w = []
        for i in at:
            x = (i - centre + 0.5) / wide
            w.append(1.0 if x == 0 else 0.0 if abs(x) >= 3 else math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3))
        whole = [int(v / sum(w) * (1 << 22) + (0.5 if v >= 0 else -0.5)) for v in w]
        for j, line in enumerate(lines.tolist()):
            out[j, k] = min(max((sum(line[i] * v for i, v in zip(at, whole)) + (1 << 21)) >> 22, 0), 255)
    return out if along else out.T


@pytest.mark.parametrize("shape", [(96, 130), (8, 8), (32, 64), (50, 32)])
def test_reduction_pixel_by_pixel(shape):
    img = RNG.integers(0, 256, shape, dtype=np.uint8)
    img[: shape[0] // 3] = 255 * (np.arange(shape[1]) % 2)  # edges that ring beyond 0 and 255
    want = resized(img, 32, True) if shape[1] != 32 else img
    want = resized(want, 32, False) if shape[0] != 32 else want
    assert (K.sinc_resize(img, 32, 32) == want).all()


def test_hashes_of_near_frames_stay_near():
    far = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    img = frame()
    again = np.where(img > 0, np.clip(img.astype(int) + 2, 1, 255), 0).astype(np.uint8)
    assert K.perceptual_hash(img) == K.perceptual_hash(img.copy()) and far(K.perceptual_hash(img), K.perceptual_hash(again)) <= 2


@pytest.mark.parametrize("together", [64, 3])
def test_suppression_of_many_groups(monkeypatch, together):
    """All groups at once keep what each keeps by itself, at every threshold."""
    monkeypatch.setattr(K, "TOGETHER", together)
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 12, 300)
    lo = rng.integers(0, 40, (sizes.sum(), 2)).astype(float)
    boxes = np.hstack([lo, lo + rng.integers(0, 30, lo.shape)])
    begins, limits = np.cumsum(sizes) - sizes, rng.choice([0.0, 0.1, 0.4], (300, 3))
    got = K.nms_groups(boxes, begins, limits)
    for g, (a, n) in enumerate(zip(begins, sizes)):
        for t in range(3):
            assert (got[a : a + n, t] == K.nms(boxes[a : a + n], limits[g, t])).all()


def test_overlapping_pairs(monkeypatch):
    monkeypatch.setattr(K, "PAIRS", 97)
    rng = np.random.default_rng(5)
    for few in (0, 20, 1000):
        boxes, group = [], []
        for n in (90, 70):
            lo = rng.integers(-80, 300, (n, 2)).astype(float)
            boxes.append(np.hstack([lo, lo + rng.integers(0, 150, (n, 2))]))
            group.append(np.sort(rng.choice([0, 0, 0, 2, 3], n)))
        (a, b), (u, v) = boxes, group
        i, j = K.overlapping(a, b, u, v, 64.0, few)
        want = [(x, y) for x in range(90) for y in range(70) if u[x] == v[y] and (np.maximum(a[x, :2], b[y, :2]) < np.minimum(a[x, 2:], b[y, 2:])).all()]
        assert sorted(zip(i.tolist(), j.tolist())) == want
        assert len(K.overlapping(a[:0], b, u[:0], v, 64.0, few)[0]) == len(K.overlapping(a, b[:0], u, v[:0], 64.0, few)[0]) == 0


def test_best_matching_of_small_components(monkeypatch):
    rng = np.random.default_rng(6)
    for _ in range(300):
        e = np.unique(rng.integers(0, 30, rng.integers(1, 16)))
        rng.shuffle(e)
        a, b, cost, shared = e // 6, e % 6, rng.integers(0, 4, len(e)) / 2, rng.integers(0, 3, len(e)) / 7
        fast = K.best_matching(a, b, cost, shared)
        with monkeypatch.context() as m:
            m.setattr(K, "SMALL", 0)
            slow = K.best_matching(a, b, cost, shared)
        assert sorted(fast.tolist()) == sorted(slow.tolist())
