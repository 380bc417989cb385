"""Every query against its SQL in DuckDB, and operators against brute force."""

import os
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest

from latticework.functions import kernels as K
from latticework.functions import linked as L
from latticework.functions import ordered as O
from latticework.functions import scans
from latticework.operators import boxes as B
from latticework.operators import curation as C
from latticework.operators import detections as P
from latticework.operators import metrics as E
from latticework.operators import runs as R
from latticework.plans import detections, registry, views

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and np.isnan(v):
        return "~"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted(tuple(plain(v) for v in r) for r in rel.select(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs_without_sql(spark, sf_dir, name):
    a = registry.queries()[name](spark, sf_dir).collect()
    assert a


def test_partitions_do_not_matter(spark, sf_dir):
    f = views.frames(spark, sf_dir)
    one = sorted(map(str, C.manifest_b(f.coalesce(1), 7).collect()))
    assert one == sorted(map(str, C.manifest_b(f.repartition(23), 7).collect()))


def test_bisection_finds_the_nearest_cap(spark, sf_dir):
    f = views.frames(spark, sf_dir)
    cap, n = C.find_cap(f, 500)
    counts = {r.cap: r.n_kept for r in C.scan_cap_counts(f, list(range(max(1, cap - 2), cap + 3))).collect()}
    assert counts[cap] == n and abs(n - 500) <= min(abs(v - 500) for c, v in counts.items() if abs(c - cap) <= 1)


def test_split_bucket(spark):
    df = spark.createDataFrame([("0:a/b",)], "k string")
    assert df.select(C.split_bucket(C.F.col("k"))).first()[0] == 176


def test_match_against_brute_force(spark, sf_dir):
    t, d = views.truths(spark, sf_dir), P.above(P.suppress(views.boxes(spark, sf_dir).select("image_id", "det", *B.XYXY, "score", "label")), 0.1)
    matched = E.match(t, d)
    rows = matched.collect()
    counts = {r.image_id: (r.n_tp, r.n_fp, r.n_fn) for r in E.image_counts(matched).collect()}
    gt, det = {}, {}
    for r in t.collect():
        gt.setdefault(r.image_id, []).append(r)
    for r in d.collect():
        det.setdefault(r.image_id, []).append(r)
    assert {r.image_id for r in rows} <= set(gt)
    by = {}
    for r in rows:
        by.setdefault(r.image_id, []).append(r)
    for image, own in gt.items():
        a = np.array([[x.x1, x.y1, x.x2, x.y2] for x in own])
        p = det.get(image, [])
        found = [r for r in by[image] if r.kind == "tp"]
        assert counts[image] == tuple(sum(r.kind == k for r in by[image]) for k in ("tp", "fp", "fn"))
        levels, scores = {x.gt: x.level for x in own}, {x.det: x.score for x in det.get(image, [])}
        assert all(r.level == levels.get(r.gt) and r.score == scores.get(r.det) for r in by[image])
        assert len(found) + sum(r.kind == "fn" for r in by[image]) == len(own) and len(found) + sum(r.kind == "fp" for r in by[image]) == len(p)
        if p:
            b = np.array([[x.x1, x.y1, x.x2, x.y2] for x in p])
            cost = np.abs((a[:, None, 0] + a[:, None, 2] - b[None, :, 0] - b[None, :, 2]) / 2)
            cost[K.iou(a, b) <= 0.1] = K.NO_MATCH
            i, j = K.assign(cost)
            assert np.isclose(sum(r.cost for r in found), cost[i, j][cost[i, j] < 10].sum())



def test_curve_with_ties_and_many_slices(spark, sf_dir):
    """A third of all detections share one score; the curve is that of a plain walk over the sorted rows."""
    m = views.matches(spark, sf_dir).withColumn("score", C.F.when(C.F.col("det") % 3 == 0, C.F.when(C.F.col("kind") != "fn", 0.25)).otherwise(C.F.col("score")))
    got = {(r.dataset, r["rank"]): r for r in E.curve(m.repartition(7), ["dataset"]).collect()}
    for name in ("organic", "41"):
        rows = m.where(m.dataset == name).collect()
        truth = sum(r.kind != "fp" for r in rows)
        dets = sorted((r for r in rows if r.kind != "fn"), key=lambda r: (-r.score, r.image_id, r.det))
        tp, precision, recall = 0, [], []
        for k, r in enumerate(dets, 1):
            tp += r.kind == "tp"
            precision.append(tp / k)
            recall.append(tp / truth)
        best = np.maximum.accumulate(precision[::-1])[::-1]
        for k, r in enumerate(dets, 1):
            g = got[name, k]
            assert (g.image_id, g.det) == (r.image_id, r.det) and np.isclose(g.recall, recall[k - 1]) and np.isclose(g.interpolated, best[k - 1])
            assert np.isclose(g.recall_before, recall[k - 2] if k > 1 else 0) and np.isclose(g.interpolated_before, best[max(k - 2, 0)])


def test_percentiles(spark):
    rows = [(k % 3, float(k * 7 % 50) if k % 11 else None) for k in range(400)] + [(3, 1.5)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(6)
    got = {r.k: (r.a, r.b) for r in O.percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.9}).collect()}
    for k in range(4):
        own = [v for g, v in rows if g == k and v is not None]
        assert np.allclose(got[k], np.percentile(own, [50, 90]))
    assert O.percentiles(df, [], "v", {"a": 0.1}).collect()[0].a == np.percentile([v for _, v in rows if v is not None], 10)


def test_sweep_metrics_one_by_one(spark, sf_dir):
    t, d = views.truths(spark, sf_dir), views.boxes(spark, sf_dir).select("image_id", "det", *B.XYXY, "score", "label")
    got = {r.segment_iou: r for r in E.suppression_sweep(t, d, [0.4, 0.1]).collect()}
    for iou in (0.4, 0.1):
        m = E.match(t, P.above(P.sweep(d, [iou]).drop("segment_iou"), 0.1)).withColumn("one", C.F.lit(1))
        points = E.curve(m, ["one"])
        best = E.operating_points(points, ["one"]).where("point = 'accuracy'").first()
        want = (E.average_precision(points, ["one"]).first().ap_total, best.recall, best.fp_share)
        assert np.allclose((got[iou].ap_total, got[iou].recall, got[iou].fp_share), want)


def test_sweep_metrics_stores_no_row_per_threshold(spark, sf_dir):
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/latticework"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    detections.sweep_metrics(spark, sf_dir).collect()
    rows = sum(spark.read.parquet(f"{folder}/{x}").count() for x in set(os.listdir(folder)) - before)
    assert 0 < rows <= 2 * spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def test_sweep_metrics_of_crowded_images(spark, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 50)
    rng = np.random.default_rng(3)
    rows = []
    for image, n in [(1, 300)] + [(k, 12) for k in range(2, 30)]:
        lo, size = rng.integers(0, 900 if n > 99 else 150, (n, 2)), rng.integers(10, 120, (n, 2))
        for k in range(n):
            box = [float(x) for x in (*lo[k], *(lo[k] + size[k]))]
            rows.append((image, k, *box, float(rng.integers(0, 20)) / 20, int(rng.integers(0, 2))))
    d = spark.createDataFrame(rows, "image_id long, det long, x1 double, y1 double, x2 double, y2 double, score double, label int")
    t = d.where("det % 3 < 2 AND image_id % 7 > 0").selectExpr("image_id", "det AS gt", "x1 + 3 AS x1", "y1 + 2 AS y1", "x2 + 3 AS x2", "y2 + 2 AS y2", "label", "1 AS level")
    got = {r.segment_iou: r for r in E.suppression_sweep(t, d, [0.4, 0.15, 0.1]).collect()}
    for iou in (0.4, 0.15, 0.1):
        points = E.curve(E.match(t, P.above(P.sweep(d, [iou]).drop("segment_iou"), 0.1)).withColumn("one", C.F.lit(1)), ["one"])
        best = E.operating_points(points, ["one"]).where("point = 'accuracy'").first()
        want = (E.average_precision(points, ["one"]).first().ap_total, best.recall, best.fp_share)
        assert np.allclose((got[iou].ap_total, got[iou].recall, got[iou].fp_share), want)
    assert E.suppression_sweep(t.limit(0), d, [0.4]).collect() == []
    assert [tuple(r) for r in E.suppression_sweep(t, d.limit(0), [0.4, 0.1]).orderBy("segment_iou").collect()] == [(0.1, 0.0, None, None), (0.4, 0.0, None, None)]


def test_empty_inputs(spark, sf_dir):
    b = views.boxes(spark, sf_dir).select("image_id", "det", *B.XYXY, "score", "label").limit(0)
    assert P.suppress(b).count() == 0 and P.fuse_boxes(b.withColumn("model", C.F.lit(0)), 2).count() == 0 and E.match(views.truths(spark, sf_dir).limit(0), b).count() == 0
    assert C.manifest_a(views.frames(spark, sf_dir).limit(0)).count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("spread", [40, 3])
def test_a_scan_of_many_runs(spark, monkeypatch, spread):
    """A third of all frames in one scan: many tasks walk it, and the result is that of one walk, also where runs hardly ever agree."""
    rng = np.random.default_rng(spread)
    rows = [(f"k{i}", "hot" if i % 3 == 0 else f"s{i % 17}", i, i, int(rng.integers(0, 1 << spread))) for i in range(1500)]
    rows += [(f"e{i}", "still", i, 2000 + i, 5 if i < 590 else 255) for i in range(600)]  # no frame is kept for several runs
    frames = spark.createDataFrame(rows, "key string, scan string, frame_idx long, ord long, phash long").repartition(5)
    jobs = {
        "sweep": lambda: sorted(map(str, C.decimation_sweep(frames, [0, 1, 2, 4]).collect())),
        "capped": lambda: sorted(map(str, C.capped(frames, 60).collect())),
        "counts": lambda: sorted(map(str, C.scan_cap_counts(frames, [1, 9, 60, 5000]).collect())),
    }
    whole = {name: job() for name, job in jobs.items()}
    monkeypatch.setattr(L, "RUN_ROWS", 200)
    assert {name: job() for name, job in jobs.items()} == whole
    cut = L.runs(frames, "scan", ["frame_idx", "ord"])
    assert cut.where("scan = 'hot'").select("_slice").distinct().count() > 2
    kept, last = [], None
    for key, scan, *_, h in sorted(rows, key=lambda r: r[2]):
        if scan == "hot" and (last is None or bin(h ^ last).count("1") > 2):
            kept.append(key)
            last = h
    assert sorted(r.key for r in C.flag_decimated(frames, 2).where("scan = 'hot' AND kept").collect()) == sorted(kept)


def best_by_trying(edges):
    """All matchings of a few edges (a, b, cost, overlap): most edges, least cost, most overlap, lowest b for the lowest a."""
    best = None
    for mask in range(1 << len(edges)):
        some = [e for k, e in enumerate(edges) if mask >> k & 1]
        if len({e[0] for e in some}) == len(some) == len({e[1] for e in some}):
            cost = sum((Fraction(e[2]) for e in some), Fraction(0))
            key = (-len(some), cost, -sum(round(e[3] * 1e9) for e in some), sorted(e[:2] for e in some))
            best = key if best is None or key < best else best
    return best[3]


def test_best_matching():
    rng = np.random.default_rng(6)
    for trial in range(150):
        n, m = rng.integers(1, 5, 2)
        at = [(a, b) for a in range(n) for b in range(m) if rng.random() < 0.6][:11]
        cost = rng.integers(0, 3, len(at)) * (0.5 if trial % 2 else 1e-7) + (rng.random(len(at)) * 1e-12 if trial % 3 == 0 else 0)
        edges = [(a, b, float(c), float(o)) for (a, b), c, o in zip(at, cost, rng.integers(1, 4, len(at)) / 4)]
        a, b, c, o = (np.array(x) for x in zip(*edges)) if edges else (np.zeros(0, int),) * 4
        got = K.best_matching(a, b, np.asarray(c, float), np.asarray(o, float))
        assert sorted((int(a[k]), int(b[k])) for k in got) == (best_by_trying(edges) if edges else [])
    # the least cost counts before any overlap, and one more pair before any cost
    one = K.best_matching(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]), np.array([4e-5, 0, 0, 4e-5]), np.array([0.9, 0.11, 0.11, 0.9]))
    assert sorted(one.tolist()) == [1, 2]
    assert sorted(K.best_matching(np.array([0, 0, 1]), np.array([0, 1, 0]), np.array([0.0, 9e9, 9e9]), None).tolist()) == [1, 2]


def test_boxes_meet_on_a_grid(spark):
    """The same overlapping pairs as all against all, each once; an image of many boxes makes few rows."""
    rng = np.random.default_rng(7)
    rows = [(int(i % 2), int(i), *map(float, (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(rng.integers(-50, 300, (400, 4)) % [350, 350, 60, 60])]
    rows += [(0, 900, -500.0, -500.0, 900.0, 900.0), (0, 901, 32.0, 32.0, 32.0, 64.0), (1, 902, 64.0, 0.0, 96.0, 32.0), (1, 903, 96.0, 0.0, 128.0, 32.0)]
    left = spark.createDataFrame(rows, "image_id long, gt long, x1 double, y1 double, x2 double, y2 double")
    right = left.withColumnRenamed("gt", "det").withColumns({"x1": C.F.col("x1") + 3, "x2": C.F.col("x2") + 3})
    near = sorted((r.image_id, r.gt, r.p_det) for r in B.near_pairs(left, right, ["image_id"]).collect())
    every = B.pairs(left, right, ["image_id"]).where((C.F.greatest("x1", "p_x1") < C.F.least("x2", "p_x2")) & (C.F.greatest("y1", "p_y1") < C.F.least("y2", "p_y2")))
    assert near == sorted((r.image_id, r.gt, r.p_det) for r in every.collect())
    assert near == sorted((r.image_id, r.gt, r.p_det) for r in B.near_pairs(left, right, ["image_id"], 7.0).collect())
    costs = E.q_costs(left, right, 0.1).where("cost < 1e7").select("image_id", "gt", "p_det", "cost", "overlap")
    assert sorted(map(str, costs.collect())) == sorted(map(str, E.gated(left, right, 0.1).select(*costs.columns).collect()))
    best = E.assign_by_overlap(E.gated(left, right, 0.0)).collect()
    assert len({(r.image_id, r.gt) for r in best}) == len(best) == len({(r.image_id, r.det) for r in best}) and all(r.overlap > 0 for r in best)


def test_models_of_one_read(spark, sf_dir):
    """F8: the models' matches are made from one pass over the boxes: a task does not read its images once per model."""
    m = detections._model_matches(views.matches(spark, sf_dir))
    assert m._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    n = {r.model: r.n for r in m.groupBy("model").agg(C.F.count("kind").alias("n")).collect()}
    rows = views.matches(spark, sf_dir).collect()
    want = {"a": sum(r.image_id % 2 == 0 or r.kind == "fn" for r in rows), "b": sum(r.image_id % 3 > 0 or r.kind == "fn" for r in rows), "ensemble": len(rows)}
    assert n == want


def test_curve_of_more_rows_has_more_slices(spark, sf_dir, monkeypatch):
    """F8: slices and boxes' partitions are bounded in rows; the curve stays the same."""
    m = views.matches(spark, sf_dir)
    points = lambda df: sorted(map(str, df.collect()))
    want = points(E.curve(m, ["dataset"]))
    dealt, sliced = [], E.sliced
    monkeypatch.setattr(E, "sliced", lambda *a, **b: dealt.append(sliced(*a, **b)) or dealt[-1])
    monkeypatch.setattr(O, "ROWS", 200)
    spread = views.matches(spark, sf_dir, spread=True)
    assert spread.rdd.getNumPartitions() == -(-m.count() // 200)
    assert points(E.curve(spread, ["dataset"])) == want
    assert max(r["count"] for r in dealt[0].groupBy("_slice").count().collect()) < 800


def test_raw_distances_compute_each_term_once(spark):
    """shared terms are columns, not copies inside each expression; the values are those of the plain formulas."""
    rng = np.random.default_rng(4)
    raw = np.vstack([rng.normal(size=(40, 8)), np.tile(rng.normal(size=(5, 4)), 2), np.zeros((1, 8))])
    cols = [f"{n}{k}" for n in "pq" for k in range(4)]
    d = B.raw_distances(spark.createDataFrame(raw.tolist(), ", ".join(f"{c} double" for c in cols)), cols[:4], cols[4:])
    plan = d._jdf.queryExecution().optimizedPlan().toString().upper()
    assert d.columns == [*cols, "diou", "ciou"] and plan.count("EXP(") == 12 and plan.count("ATAN(") == 2
    for r in d.collect():
        (ax, ay, aw, ah), (bx, by, bw, bh) = ([1 / (1 + np.exp(-r[f"{n}{k}"])) for k in range(4)] for n in "pq")
        aw, ah, bw, bh = np.exp([aw, ah, bw, bh])
        side = lambda f, g, a, w, b, v: f(a + w / 2, b + v / 2) - g(a - w / 2, b - v / 2)
        both = max(side(min, max, ax, aw, bx, bw), 0) * max(side(min, max, ay, ah, by, bh), 0)
        i = both / (aw * ah + bw * bh - both)
        gap = ((ax - bx) ** 2 + (ay - by) ** 2) / (side(max, min, ax, aw, bx, bw) ** 2 + side(max, min, ay, ah, by, bh) ** 2)
        v = 4 / np.pi**2 * (np.arctan(bw / bh) - np.arctan(aw / ah)) ** 2
        assert np.isclose(r.diou, 1 - (i - gap)) and np.isclose(r.ciou, 1 - (i - gap - (v * v / (1 - i + v) if i > 0.5 and v > 0 else 0)))


def test_top_k_accuracy_inside_rows(spark, sf_dir):
    """the target's place is found inside its row, without a sort; ties, nulls and targets beyond the classes count as SQL has them."""
    plan = detections.top_accuracy(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate explode" not in plan
    rng = np.random.default_rng(5)
    rows = [([None if rng.random() < 0.2 else float(x) for x in rng.integers(0, 3, 4)], int(t)) for t in rng.integers(-1, 6, 300)] + [([1.0, 2.0], None), ([], 0), (None, 1), ([float("nan"), 9.0], 1)]
    got = {r.k: r.accuracy for r in E.top_k_accuracy(spark.createDataFrame(rows, "scores array<double>, target int"), [1, 2, 3]).collect()}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE l (row INTEGER, target INTEGER, class INTEGER, score DOUBLE)")
    duck.executemany("INSERT INTO l VALUES (?, ?, ?, ?)", [(n, t, c, x) for n, (own, t) in enumerate(rows) for c, x in enumerate(own or [])])
    for k in (1, 2, 3):
        want = duck.sql(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC NULLS LAST, class) AS rk FROM l)
          SELECT 100 * avg(h) FROM (SELECT coalesce(max((class = target AND rk <= {k})::INTEGER), 0) AS h FROM r GROUP BY row)""").fetchall()[0][0]
        assert np.isclose(got[k], want)
    assert [r.accuracy for r in E.top_k_accuracy(spark.createDataFrame([], "scores array<double>, target int"), [1]).collect()] == [0.0]


def test_average_precision_of_nothing_found(spark):
    rows = [("a", 1, 1, "tp", 0.9, 1), ("a", 1, 2, "fn", None, 1), ("b", 2, 1, "fn", None, 2)]
    m = spark.createDataFrame(rows, "dataset string, image_id long, det long, kind string, score double, level int")
    got = {r.dataset: r.ap_total for r in E.average_precision(E.curve(m, ["dataset"]), ["dataset"], m).collect()}
    assert got == {"a": 0.5, "b": 0.0}


@pytest.mark.parametrize("com", [0.01, 3000.0])
def test_smoothing_in_blocks(spark, monkeypatch, com):
    """Gap filling and smoothing equal pandas, whatever the blocks and however long the run."""
    monkeypatch.setattr(scans, "BLOCK", 7)
    monkeypatch.setattr(L, "RUN_ROWS", 150)
    rng = np.random.default_rng(9)
    rows = [(run, "d", i, None if i < gap or rng.random() < 0.4 or 100 <= i < 130 else float(rng.normal())) for run, n, gap in (("long", 200, 30), ("short", 9, 0), ("none", 5, 9)) for i in range(n)]
    log = spark.createDataFrame(rows, "run string, dataset string, epoch long, ap double").repartition(4)
    got = {(r.run, r.epoch): (r.filled, r.smooth) for r in R.interpolated(log, com=com).collect()}
    assert len(got) == len(rows)
    for run in ("long", "short", "none"):
        own = pd.Series([np.nan if v is None else v for r, _, _, v in rows if r == run]).interpolate()
        want = list(zip(own, own.ewm(com=com).mean()))
        found = [tuple(np.nan if v is None else v for v in got[run, i]) for i in range(len(want))]
        assert np.allclose(found, want, rtol=1e-9, atol=1e-9, equal_nan=True)


def test_frames_are_walked_without_a_join(spark, sf_dir):
    """Narrow frames go through the walk as they are; frames with other columns meet its rows, with the same marks."""
    pool = C.pool(views.frames(spark, sf_dir))
    flagged = C.flag_capped(pool, 5)
    assert "Join" not in flagged._jdf.queryExecution().executedPlan().toString()
    wide = C.flag_capped(pool.withColumn("pixels", C.F.lit("x")), 5)
    assert sorted(map(tuple, flagged.collect())) == sorted(tuple(r)[:5] + tuple(r)[6:] for r in wide.collect())
    two_steps = C.flag_decimated(C.even_positions(pool, 5), 1).where("kept").drop("kept")
    assert sorted(map(tuple, C.capped(pool, 5).collect())) == sorted(map(tuple, two_steps.collect()))


def test_percentiles_of_one_frequent_value(spark, monkeypatch):
    """Equal values are counted, so a value that nearly all rows have does not fill a slice."""
    dealt, sliced = [], O.sliced
    monkeypatch.setattr(O, "sliced", lambda *a, **b: dealt.append(sliced(*a, **b)) or dealt[-1])
    values = [0.0] * 900 + [float(k) for k in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = O.percentiles(df, [], "v", {"a": 0.5, "b": 0.905, "c": 1.0}).first()
    assert np.allclose([got.a, got.b, got.c], np.percentile(values, [50, 90.5, 100])) and dealt[0].count() == 100


@pytest.mark.parametrize("few", [64, 3])
def test_images_of_few_boxes_need_no_grid(spark, monkeypatch, few):
    """Whether an image is dealt to cells or not, its overlapping pairs are the same; images of few boxes are joined as they are."""
    monkeypatch.setattr(B, "FEW", few)
    rows = [(i % 5, i, float(i * 37 % 200), float(i * 53 % 150), float(i * 37 % 200 + 70), float(i * 53 % 150 + 70)) for i in range(30) if i % 5 or i < 11]
    left = spark.createDataFrame(rows, "image_id long, gt long, x1 double, y1 double, x2 double, y2 double")
    near = B.near_pairs(left, left.withColumnRenamed("gt", "det"), ["image_id"])
    assert ("_cx" in near._jdf.queryExecution().analyzed().toString()) == (few == 3)
    hit = lambda a, b: a[0] == b[0] and max(a[2], b[2]) < min(a[4], b[4]) and max(a[3], b[3]) < min(a[5], b[5])
    assert sorted((r.image_id, r.gt, r.p_det) for r in near.collect()) == sorted((a[0], a[1], b[1]) for a in rows for b in rows if hit(a, b))
