"""Seeded draws against a plain version that hashes row by row in Python."""

import hashlib
from collections import Counter, defaultdict

from latticework.functions import pixels as X
from latticework.operators import boxes as B
from latticework.operators import curation as C
from latticework.plans import views


def dice(seed, *keys):
    return int(hashlib.md5("|".join(map(str, (seed, *keys))).encode()).hexdigest()[:7], 16) / (1 << 28)


def test_known_boxes(spark, sf_dir):
    rows = B.sample_known(views.boxes(spark, sf_dir), (0.2, 0.3, 0.3, 0.2), 3).select("image_id", "det", "label", "mode", "known").collect()
    images = defaultdict(list)
    for r in rows:
        images[r.image_id].append(r)
    for image, own in images.items():
        d = dice(3, image)
        mode = 0 if d < 0.2 else 1 if d < 0.2 + 0.3 else 2 if d < 0.2 + 0.3 + 0.3 else 3
        order = sorted(own, key=lambda r: (dice(4, image, r.det), r.det))
        part, seen = int(dice(5, image) * len(own)), Counter()
        for place, r in enumerate(order):
            seen[r.label] += 1
            want = [False, place < part, seen[r.label] > 1, True][mode]
            assert (r.mode, r.known) == (mode, want)
    assert {r.mode for r in rows} == {0, 1, 2, 3}


def test_known_boxes_by_default(spark, sf_dir):
    """No image is blank or parted at random, a fifth is known in whole."""
    rows = B.sample_known(views.boxes(spark, sf_dir)).select("image_id", "mode").distinct().collect()
    assert {r.mode for r in rows} == {2, 3} and 0.7 < sum(r.mode == 2 for r in rows) / len(rows) < 0.9


def test_jitter(spark, sf_dir):
    b = views.boxes(spark, sf_dir)
    got = {(r.image_id, r.det): r for r in B.jitter(b, 0.02, 0.1, 5, size=(300.0, 400.0)).collect()}
    for r in b.collect():
        key = (r.image_id, r.det)
        assert (key in got) == (dice(5, *key) > 0.1)
        if key in got:
            cx, cy, w, h = [v + (dice(6 + k, *key) - 0.5) * 0.04 * (300, 400)[k % 2] for k, v in enumerate(((r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2, r.x2 - r.x1, r.y2 - r.y1))]
            moved, g = [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2], got[key]
            assert max(abs(p - q) for p, q in zip(moved, (g.j1, g.j2, g.j3, g.j4))) < 1e-9
            both = max(min(r.x2, moved[2]) - max(r.x1, moved[0]), 0) * max(min(r.y2, moved[3]) - max(r.y1, moved[1]), 0)
            total = (r.x2 - r.x1) * (r.y2 - r.y1) + w * h - both
            assert abs(g.confidence - both / total * (1 + (dice(10, *key) - 0.5) * 0.04)) < 1e-6


def test_cutout(spark, sf_dir):
    for r in B.cutout(views.boxes(spark, sf_dir), 11).collect():
        w, h = r.x2 - r.x1, r.y2 - r.y1
        cx, cy = (r.x1 + r.x2) / 2 + w * (dice(12, r.image_id, r.det) - 0.5) / 2, (r.y1 + r.y2) / 2 + h * (dice(13, r.image_id, r.det) - 0.5) / 2
        assert max(abs(p - q) for p, q in zip((cx - w / 4, cy - h / 4, cx + w / 4, cy + h / 4), (r.j1, r.j2, r.j3, r.j4))) < 1e-9 and 0.5 <= r.confidence < 1


def test_mask_cells(spark, sf_dir):
    rows = X.mask_cells(views.frames(spark, sf_dir), 64, 0.6, 1).collect()
    assert len(rows) == views.frames(spark, sf_dir).count()
    for r in rows:
        drawn = sorted(range(64), key=lambda c: hashlib.md5(f"1|{r.key}|{c}".encode()).hexdigest())
        assert r.masked == sorted(drawn[:38])


def test_balanced_sample(spark, sf_dir):
    f = views.frames(spark, sf_dir)
    scans = defaultdict(list)
    for r in f.orderBy("frame_idx", "ord").collect():
        scans[r.scan].append(r.key)
    names, got = sorted(scans), C.balanced_sample(f, 700).orderBy("draw").collect()
    assert [r.draw for r in got] == list(range(700))
    for r in got:
        scan = names[int(dice(0, r.draw) * len(names))]
        own = scans[scan]
        assert (r.scan, r.key, r.weight) == (scan, own[int(dice(1, r.draw) * len(own))], 1 / len(own))
