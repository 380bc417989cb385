"""Post-processing, matching, curve and diagnostic queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import percentiles
from ..functions.store import stored
from ..operators import boxes as B
from ..operators import detections as P
from ..operators import metrics as E
from . import views as V

DET = ("image_id", "det", *B.XYXY, "score", "label")
R = lambda c: F.round(F.col(c) if isinstance(c, str) else c, 6)


def dets(s, d):
    return V.boxes(s, d).select(*DET)


def raw(s, d):
    b = V.boxes(s, d)
    return b.select("image_id", F.col("det").alias("query"), F.array(F.col("score") * 4 - 2, (F.col("cents") % 101) / 25 - 2).alias("logits"), (F.col("x1") / 400).alias("cx"), (F.col("y1") / 400).alias("cy"), ((F.col("x2") - F.col("x1")) / 400).alias("w"), ((F.col("y2") - F.col("y1")) / 400).alias("h"))


def top_k(s, d):
    t = P.top_k(raw(s, d), 5)
    sizes = V.boxes(s, d).select("image_id").distinct().select("image_id", F.lit(1024.0).alias("width"), (F.lit(400.0) + F.col("image_id") % 3 * 56).alias("height"))
    return P.scale(t, sizes).select("image_id", "query", "label", F.col("rank").cast("long").alias("rank"), R("score").alias("score"), *[R(c).alias(c) for c in B.XYXY])


def suppressed(s, d):
    return P.above(P.suppress(dets(s, d)), 0.1)


def pooled(s, d):
    b = V.boxes(s, d)
    return P.pool([b.where("cents % 2 = 1").select(*DET), b.where("cents % 2 = 0").select(*DET)], 0.3)


def fused(s, d):
    f = P.fuse_boxes(V.boxes(s, d).select(*DET, (F.col("cents") % 2).cast("int").alias("model")), 2)
    return f.select("image_id", "n", *[R(c).alias(c) for c in B.XYXY], R("score").alias("score"), "label")


def swept(s, d):
    return P.sweep(dets(s, d), [0.4, 0.3, 0.2, 0.15, 0.1]).groupBy("segment_iou", "label").agg(F.count(F.lit(1)).alias("n"), R(F.sum("score")).alias("score"))


def sweep_metrics(s, d):
    """Threshold, average precision, recall and fp share at the best accuracy."""
    ious = [0.4, 0.3, 0.2, 0.15, 0.1]
    m = E.sweep_curves(E.sweep_flags(V.sides(s, d), ious), ious)
    return m.select("segment_iou", *[R(c).alias(c) for c in ("ap_total", "recall", "fp_share")])


def costs(s, d):
    c = E.q_costs(V.truths(s, d).select("image_id", "gt", *B.XYXY), V.boxes(s, d).select("image_id", "det", *B.XYXY), 0.1)
    return c.select("image_id", "gt", F.col("p_det").alias("det"), R("cost").alias("cost"))


def matched(s, d):
    return E.match(V.truths(s, d), P.above(P.suppress(dets(s, d)), 0.1))


def matched_counts(s, d):
    return E.image_counts(matched(s, d))


def merged(s, d):
    """Counts of the union of two sets, whose images must not meet, and the images that two other sets share."""
    m = V.matches(s, d)
    a, b = (m.where(F.col("image_id") % 2 == k) for k in (0, 1))
    both = E.image_counts(E.merge([a, b])).agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in ("tp", "fp", "fn")])
    shared = E.image_overlap(m.where("image_id % 3 > 0"), m.where("image_id % 5 > 0")).agg(F.count(F.lit(1)).alias("n_shared"))
    wrong = E.image_overlap(a, b).agg(F.count(F.lit(1)).alias("n_wrong"))
    return both.crossJoin(shared).crossJoin(wrong)  # a row each


def q_error(s, d):
    j = B.pairs(V.truths(s, d), V.boxes(s, d).select("image_id", "det", *B.XYXY, "score"), ["image_id"]).where("gt = p_det").withColumnRenamed("p_score", "score")
    return E.mean_q_error(j, 0.3).select("n", R("q_error").alias("q_error"))


def curve(s, d):
    c = E.curve(V.matches(s, d, spread=True), ["dataset"])
    return c.select("dataset", "rank", "image_id", "det", *[R(F.col(x) + 1e-9).alias(x) for x in ("score", "recall", "precision", "interpolated", "accuracy", "fp_share", "recall_low", "recall_med", "recall_high")])


def _with_missed(m):
    """The matches, and truths of a data set without detections."""
    missed = F.when(F.expr("kind = 'fn' AND image_id % 7 = 0"), "missed")
    return m.withColumn("dataset", F.explode(F.array_compact(F.array("dataset", missed))))


def ap(s, d):
    a = E.average_precision(E.curve(_with_missed(V.matches(s, d, spread=True)), ["dataset"]), ["dataset"], _with_missed(V.matches(s, d)))
    return a.select("dataset", *[R(c).alias(c) for c in ("ap_total", "ap_low", "ap_med", "ap_high")])


def operating(s, d):
    o = E.operating_points(E.curve(V.matches(s, d, spread=True), ["dataset"]), ["dataset"])
    return o.select("dataset", "point", *[R(c).alias(c) for c in ("fp_share", "recall", "recall_low", "recall_med", "recall_high", "min_score")])


def _model_matches(m):
    """A row per model that has the match; the table is read once, not once per model."""
    a, b = F.when(F.expr("image_id % 2 = 0 OR kind = 'fn'"), "a"), F.when(F.expr("image_id % 3 > 0 OR kind = 'fn'"), "b")
    return m.withColumn("model", F.explode(F.array_compact(F.array(a, b, F.lit("ensemble")))))


def verdict(s, d):
    keys = ["dataset", "model"]
    aps = E.average_precision(E.curve(_model_matches(V.matches(s, d, spread=True)), keys), keys, _model_matches(V.matches(s, d)))
    v = E.verdict(aps, "ensemble")
    return v.select("dataset", *[R(c).alias(c) for c in ("best_single", "ensemble", "delta")], "verdict")


def strata(s, d):
    return E.recall_strata(V.matches(s, d).withColumn("xc", F.col("xc") * 4)).withColumn("recall", R("recall"))


def fp_profile(s, d):
    f = E.false_positive_profile(V.matches(s, d))
    return f.select("n_images", "n_fp", *[R(c).alias(c) for c in ("mean", "p50", "p90", "share_sure", "share_ring", "per_image")])


def histograms(s, d):
    m = V.matches(s, d)
    a = E.histogram(m.where("kind <> 'fp'"), "xc", 0, 250, 30, ["kind"]).select(F.concat(F.lit("q_"), "kind").alias("series"), "bin", "n")
    b = E.histogram(m.where("kind = 'fp'"), "score", 0.3, 1.0, 30).select(F.lit("score").alias("series"), "bin", "n")
    c = E.histogram(m.withColumn("dist", F.abs(F.col("xc") - 100)), "dist", 0, 60, 20, clip=True).select(F.lit("dist").alias("series"), "bin", "n")
    return a.unionByName(b).unionByName(c)


def intensity(s, d):
    """Profile rank at each detection's column, found against false."""
    px = V.long_pixels(s, d)
    n = F.count_if(F.col("x") != 0)
    prof = px.groupBy("vec_id", "c").agg((F.sum("x") / F.greatest(n, F.lit(1))).alias("i"))
    ranked = E.intensity_rank(prof, ["vec_id"], "c", "i")
    m = V.matches(s, d).where("kind <> 'fn'").select("kind", (F.col("image_id") % 500).alias("vec_id"), F.greatest(F.lit(0), F.least(F.lit(7), F.floor(F.col("xc") / 32))).cast("int").alias("c"))
    return m.join(ranked, ["vec_id", "c"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), R(F.avg("pct")).alias("mean"), R(F.percentile("pct", 0.5)).alias("median"))


def nearest(s, d):
    m = V.matches(s, d)
    n = E.nearest_truth(m.where("kind <> 'fn'").select("image_id", "det", "xc"), m.where("kind <> 'fp'").select("image_id", "xc"))
    n = stored(n.select("distance"), "nearest")
    half = percentiles(n.where(F.col("distance") < float("inf")), [], "distance", {"median": 0.5}).select(R("median").alias("median"))
    return F.broadcast(half).crossJoin(n.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("distance") == float("inf")).alias("n_without"), R(F.avg((F.col("distance") < 8).cast("double"))).alias("share_8"), R(F.avg((F.col("distance") > 20).cast("double"))).alias("share_over_20")))


def confusion(s, d):
    b = V.boxes(s, d).select("label", (F.col("score") > 0.5).cast("int").alias("guess"))
    return E.confusion(b, "label", "guess")


def overlays(s, d):
    o = E.overlays(V.matches(s, d))
    return o.select("image_id", "kind", F.size("boxes").cast("long").alias("n"), F.array_join(F.transform("boxes", lambda x: x["det"].cast("string")), ",").alias("dets"))


def top_accuracy(s, d):
    scores = F.array(*[((F.col("cents") * (k + 3) * 31) % 97).cast("double") for k in range(5)])
    rows = V.boxes(s, d).select((F.col("qty") % 5).cast("int").alias("target"), scores.alias("scores"))
    return E.top_k_accuracy(rows, [1, 2]).select("k", R("accuracy").alias("accuracy"))


def count_error(s, d):
    return E.count_error(V.boxes(s, d).where("score > 0.5"), V.truths(s, d)).select("n_images", R("error").alias("error"))


def side(s, d):
    return E.side_by_side(V.truths(s, d), V.boxes(s, d)).groupBy("image_id", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_rings"), R(F.max("score")).alias("best"))


def vectors(s, d):
    v = E.vector_statistics(V.long_pixels(s, d), ["vec_id"], "x")
    return v.select("vec_id", *[R(c).alias(c) for c in ("largest", "least", "mean", "variance", "deviation", "entropy")])


def _nms(src: str, out: str, thr: str, keys: str = "image_id, label") -> str:
    on = " AND ".join(f"r.{k.strip()} = n.{k.strip()}" for k in keys.split(","))
    hit = f"""len(list_filter(n.kept, lambda k: (greatest(least(k.x2,r.x2)-greatest(k.x1,r.x1),0)*greatest(least(k.y2,r.y2)-greatest(k.y1,r.y1),0))
      / ((k.x2-k.x1)*(k.y2-k.y1)+(r.x2-r.x1)*(r.y2-r.y1)-greatest(least(k.x2,r.x2)-greatest(k.x1,r.x1),0)*greatest(least(k.y2,r.y2)-greatest(k.y1,r.y1),0)) > {thr})) = 0"""
    box = "{'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}"
    return f"""{out}_r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, det) AS rn FROM {src}),
{out}_n AS (SELECT {keys}, rn, det, true AS ok, [{box}] AS kept FROM {out}_r r WHERE rn = 1
  UNION ALL SELECT {', '.join('r.' + k.strip() for k in keys.split(','))}, r.rn, r.det, {hit}, CASE WHEN {hit} THEN list_append(n.kept, {box}) ELSE n.kept END
  FROM {out}_n n JOIN {out}_r r ON {on} AND r.rn = n.rn + 1),
{out} AS (SELECT r.* EXCLUDE (rn) FROM {out}_r r JOIN {out}_n n ON {on} AND r.rn = n.rn WHERE n.ok)"""


# The best matching of an image, by trying every way to pair its overlapping boxes: most pairs first, then least cost, then most overlap. A pair that may not match
# costs more than all others together, so this is the cheapest assignment of the whole matrix.
_MATCHED = """dt AS (SELECT image_id, det, x1, y1, x2, y2, score FROM o WHERE score > 0.1),
tn AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY gt) AS k, count(*) OVER (PARTITION BY image_id) AS nt FROM truths),
pr AS (SELECT t.image_id, t.k, d.det, abs((t.x1+t.x2-d.x1-d.x2)/2) AS cost, greatest(least(t.x2,d.x2)-greatest(t.x1,d.x1),0)*greatest(least(t.y2,d.y2)-greatest(t.y1,d.y1),0) AS i,
  (t.x2-t.x1)*(t.y2-t.y1)+(d.x2-d.x1)*(d.y2-d.y1) AS a FROM tn t JOIN dt d USING (image_id)),
ed AS (SELECT image_id, k, det, cost, round(i/(a-i) * 1e9::DOUBLE) AS ov FROM pr WHERE i/(a-i) > 0.1 UNION ALL SELECT image_id, k, NULL, 0, 0 FROM tn),
ms AS (SELECT DISTINCT image_id, 0::BIGINT AS k, []::BIGINT[] AS used, 0::BIGINT AS n, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS ov, []::STRUCT(k BIGINT, det BIGINT, cost DOUBLE)[] AS picks FROM tn
  UNION ALL SELECT m.image_id, e.k, CASE WHEN e.det IS NULL THEN m.used ELSE list_append(m.used, e.det) END, m.n + (e.det IS NOT NULL)::BIGINT, m.cost + e.cost, m.ov + e.ov,
    CASE WHEN e.det IS NULL THEN m.picks ELSE list_append(m.picks, {'k': e.k, 'det': e.det, 'cost': e.cost}) END
  FROM ms m JOIN ed e ON e.image_id = m.image_id AND e.k = m.k + 1 WHERE e.det IS NULL OR NOT list_contains(m.used, e.det)),
bm AS (SELECT m.image_id, m.picks FROM ms m JOIN (SELECT DISTINCT image_id, nt FROM tn) t ON t.image_id = m.image_id AND m.k = t.nt QUALIFY row_number() OVER (PARTITION BY m.image_id ORDER BY m.n DESC, m.cost, m.ov DESC, m.picks) = 1),
fd AS (SELECT image_id, p.k AS k, p.det AS det, p.cost AS cost FROM (SELECT image_id, unnest(picks) AS p FROM bm) WHERE p.cost < 10),
mt AS (SELECT t.image_id, CASE WHEN f.det IS NULL THEN 'fn' ELSE 'tp' END AS kind, t.gt, f.det, f.cost, d.score, t.level FROM tn t LEFT JOIN fd f ON f.image_id = t.image_id AND f.k = t.k LEFT JOIN dt d ON d.image_id = t.image_id AND d.det = f.det
  UNION ALL SELECT d.image_id, 'fp', NULL, d.det, NULL, d.score, NULL FROM dt d WHERE d.image_id IN (SELECT image_id FROM tn) AND NOT EXISTS (SELECT 1 FROM fd f WHERE f.image_id = d.image_id AND f.det = d.det))"""
_OVER = "greatest(least(c.f3,r.x2)-greatest(c.f1,r.x1),0)*greatest(least(c.f4,r.y2)-greatest(c.f2,r.y1),0)"
_IOUS = f"list_transform(w.cl, lambda c: CASE WHEN c.lb = r.label THEN {_OVER} / ((c.f3-c.f1)*(c.f4-c.f2)+(r.x2-r.x1)*(r.y2-r.y1)-{_OVER}) ELSE -1.0::DOUBLE END)"
_NEW = "{'f1': r.x1, 'f2': r.y1, 'f3': r.x2, 'f4': r.y2, 's1': r.x1*r.score, 's2': r.y1*r.score, 's3': r.x2*r.score, 's4': r.y2*r.score, 'w': r.score, 'c': 1, 'ms': [r.model], 'lb': r.label}"
_WIDER = "{" + ", ".join(f"'f{k}': (c.s{k}+r.{x}*r.score)/(c.w+r.score)" for k, x in enumerate(B.XYXY, 1)) + ", " + ", ".join(f"'s{k}': c.s{k}+r.{x}*r.score" for k, x in enumerate(B.XYXY, 1)) + ", 'w': c.w+r.score, 'c': c.c+1, 'ms': list_append(c.ms, r.model), 'lb': c.lb}"
# weighted fusion: the detections of an image one after the other, with the list of clusters so far
_FUSED = f"""fr AS (SELECT *, cents % 2 AS model, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, cents % 2, det) AS rn FROM boxes),
fw AS (SELECT image_id, rn, [{_NEW}] AS cl FROM fr r WHERE rn = 1 UNION ALL
  SELECT image_id, rn, CASE WHEN list_max(io) > 0.55 THEN list_transform(cl, lambda c, i: CASE WHEN i = list_position(io, list_max(io)) THEN {_WIDER} ELSE c END) ELSE list_append(cl, {_NEW}) END
  FROM (SELECT r, r.image_id, r.rn, w.cl, {_IOUS} AS io FROM fw w JOIN fr r ON r.image_id = w.image_id AND r.rn = w.rn + 1)),
fl AS (SELECT image_id, unnest(cl) AS c, unnest(range(len(cl))) AS n FROM fw QUALIFY rn = max(rn) OVER (PARTITION BY image_id))"""


_THR = "(CASE WHEN r.label = 1 THEN 0.1::DOUBLE ELSE 0.4::DOUBLE END)"
_D = ", ".join(DET)
_LV = ((1, "low"), (2, "med"), (3, "high"))


def _curve(src: str = "matches", keys: str = "dataset") -> str:
    on = ", ".join(k.strip() for k in keys.split(","))
    w = f"(PARTITION BY {keys} ORDER BY score DESC, image_id, det ROWS UNBOUNDED PRECEDING)"
    lv = ", ".join(f"sum((kind='tp' AND level={k})::INTEGER) OVER {w} AS t_{n}" for k, n in _LV)
    gt = ", ".join(f"count_if(level={k}) AS g_{n}" for k, n in _LV)
    rec = ", ".join(f"t_{n}/nullif(g_{n},0)::DOUBLE AS recall_{n}" for _, n in _LV)
    return f"""tot AS (SELECT {keys}, count(*) AS n_gt, {gt} FROM {src} WHERE kind <> 'fp' GROUP BY ALL),
run AS (SELECT *, sum((kind='tp')::INTEGER) OVER {w} AS tp, sum((kind='fp')::INTEGER) OVER {w} AS fp, {lv} FROM {src} WHERE kind <> 'fn'),
pts AS (SELECT {keys}, (tp+fp)::BIGINT AS rank, image_id, det, score, tp/n_gt::DOUBLE AS recall, tp/(tp+fp)::DOUBLE AS precision, tp/(n_gt+fp)::DOUBLE AS accuracy, fp/n_gt::DOUBLE AS fp_share, {rec} FROM run JOIN tot USING ({on})),
crv AS (SELECT *, max(precision) OVER (PARTITION BY {keys} ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS interpolated FROM pts)"""


def _ap(keys: str = "dataset") -> str:
    names = ["recall", *[f"recall_{n}" for _, n in _LV]]
    lag = f"OVER (PARTITION BY {keys} ORDER BY rank)"
    return (
        f"lagged AS (SELECT *, coalesce(lag(interpolated) {lag}, interpolated) AS pp, " + ", ".join(f"coalesce(lag({n}) {lag}, 0) AS l_{n}" for n in names) + " FROM crv), "
        f"ap AS (SELECT {keys}, " + ", ".join(f"sum(({n}-l_{n})*(interpolated+pp)/2) AS {a}" for n, a in zip(names, ("ap_total", "ap_low", "ap_med", "ap_high"))) + " FROM lagged GROUP BY ALL)"
    )


_OP = "fp_share, recall, recall_low, recall_med, recall_high, score AS min_score"
_OPR = ", ".join(f"round({c}, 6) AS {c}" for c in ("fp_share", "recall", "recall_low", "recall_med", "recall_high", "min_score"))

PLANS = {
    "p1_p2_top_k": (top_k, f"""WITH {V.BOXES}, l AS (SELECT image_id, det AS query, 0 AS label, score*4-2 AS logit, x1,y1,x2,y2 FROM boxes UNION ALL SELECT image_id, det, 1, (cents%101)/25.0::DOUBLE-2, x1,y1,x2,y2 FROM boxes),
      s AS (SELECT *, 1/(1+exp(-logit)) AS score, x1/400 AS cx, y1/400 AS cy, (x2-x1)/400 AS w, (y2-y1)/400 AS h, 400.0::DOUBLE+image_id%3*56 AS height FROM l),
      r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, query, label) AS rank FROM s)
      SELECT image_id, query, label, rank, round(score,6) AS score, round((cx-0.5::DOUBLE*w)*1024,6) AS x1, round((cy-0.5::DOUBLE*h)*height,6) AS y1, round((cx+0.5::DOUBLE*w)*1024,6) AS x2, round((cy+0.5::DOUBLE*h)*height,6) AS y2 FROM r WHERE rank <= 5"""),
    "p3_p5_suppress": (suppressed, f"WITH RECURSIVE {V.BOXES}, {_nms('boxes', 'o', _THR)} SELECT {_D} FROM o WHERE score > 0.1"),
    "p4_suppress_by_shape": (lambda s, d: P.suppress_by_shape(dets(s, d), 200), f"WITH RECURSIVE {V.BOXES}, sh AS (SELECT image_id, det, x1, y1, x2, y2, score, (y2-y1 >= 0.35::DOUBLE*200)::INTEGER AS label FROM boxes), {_nms('sh', 'o', _THR)} SELECT {_D} FROM o"),
    "p3_single_class": (lambda s, d: P.suppress(dets(s, d), P.SINGLE_IOU, by_label=False), f"WITH RECURSIVE {V.BOXES}, {_nms('boxes', 'o', '0.4::DOUBLE', 'image_id')} SELECT {_D} FROM o"),
    "p6_pool": (pooled, f"WITH RECURSIVE {V.BOXES}, {_nms('boxes', 'o', _THR)} SELECT {_D} FROM o WHERE score > 0.3"),
    "p7_fuse": (fused, f"WITH RECURSIVE {V.BOXES}, {_FUSED} SELECT image_id, n, round(c.f1, 6) AS x1, round(c.f2, 6) AS y1, round(c.f3, 6) AS x2, round(c.f4, 6) AS y2, round(c.w / c.c * least(2, len(list_distinct(c.ms))) / 2, 6) AS score, c.lb AS label FROM fl"),
    "p8_sweep": (swept, f"""WITH RECURSIVE {V.BOXES}, m AS (SELECT b.*, t AS segment_iou FROM boxes b, (SELECT unnest([0.4, 0.3, 0.2, 0.15, 0.1])::DOUBLE AS t)),
      {_nms('m', 'o', '(CASE WHEN r.label = 1 THEN 0.1::DOUBLE ELSE r.segment_iou END)', 'image_id, label, segment_iou')} SELECT segment_iou, label, count(*) AS n, round(sum(score), 6) AS score FROM o GROUP BY ALL"""),
    "p8_sweep_metrics": (sweep_metrics, f"""WITH RECURSIVE {V.TRUTHS.replace('truths AS', 'truths0 AS')}, th AS (SELECT i, [0.4, 0.3, 0.2, 0.15, 0.1][i+1]::DOUBLE AS t FROM (SELECT unnest(range(5)) AS i)),
      m AS (SELECT b.* REPLACE (image_id * 5 + i AS image_id), t AS segment_iou FROM boxes b, th), truths AS (SELECT t0.* REPLACE (image_id * 5 + i AS image_id) FROM truths0 t0, th),
      {_nms('m', 'o', '(CASE WHEN r.label = 1 THEN 0.1::DOUBLE ELSE r.segment_iou END)', 'image_id, label')}, {_MATCHED}, mm AS (SELECT (SELECT t FROM th WHERE i = image_id % 5) AS dataset, * FROM mt), {_curve('mm')}, {_ap()},
      bp AS (SELECT DISTINCT ON (dataset) dataset, recall, fp_share FROM crv ORDER BY dataset, accuracy DESC, rank) SELECT dataset AS segment_iou, round(ap_total, 6) AS ap_total, round(recall, 6) AS recall, round(fp_share, 6) AS fp_share FROM ap JOIN bp USING (dataset)"""),
    "e1_costs": (costs, f"""WITH {V.TRUTHS}, p AS (SELECT t.image_id, t.gt, b.det, abs((t.x1+t.x2-b.x1-b.x2)/2) AS c, greatest(least(t.x2,b.x2)-greatest(t.x1,b.x1),0)*greatest(least(t.y2,b.y2)-greatest(t.y1,b.y1),0) AS i,
      (t.x2-t.x1)*(t.y2-t.y1)+(b.x2-b.x1)*(b.y2-b.y1) AS a FROM truths t JOIN boxes b USING (image_id)) SELECT image_id, gt, det, round(CASE WHEN i/(a-i) <= 0.1 THEN 1e7 ELSE c END, 6) AS cost FROM p"""),
    "e2_e3_match": (matched, f"WITH RECURSIVE {V.TRUTHS}, {_nms('boxes', 'o', _THR)}, {_MATCHED} SELECT * FROM mt"),
    "e4_image_counts": (matched_counts, f"WITH RECURSIVE {V.TRUTHS}, {_nms('boxes', 'o', _THR)}, {_MATCHED} SELECT image_id, count_if(kind = 'tp')::BIGINT AS n_tp, count_if(kind = 'fp')::BIGINT AS n_fp, count_if(kind = 'fn')::BIGINT AS n_fn FROM mt GROUP BY 1"),
    "e4_merged": (merged, f"""WITH {V.MATCHES} SELECT count_if(kind = 'tp')::BIGINT AS n_tp, count_if(kind = 'fp')::BIGINT AS n_fp, count_if(kind = 'fn')::BIGINT AS n_fn,
      count(DISTINCT CASE WHEN image_id % 3 > 0 AND image_id % 5 > 0 THEN image_id END) AS n_shared, 0::BIGINT AS n_wrong FROM matches"""),
    "e5_q_error": (q_error, f"WITH {V.TRUTHS} SELECT count(*) AS n, round(avg((b.x1+b.x2-t.x1-t.x2)/2),6) AS q_error FROM truths t JOIN boxes b ON t.image_id = b.image_id AND t.gt = b.det WHERE b.score > 0.3"),
    "e6_e7_curve": (curve, f"WITH {V.MATCHES}, {_curve()} SELECT dataset, rank, image_id, det, {', '.join(f'round({c} + 1e-9::DOUBLE, 6) AS {c}' for c in ('score', 'recall', 'precision', 'interpolated', 'accuracy', 'fp_share', 'recall_low', 'recall_med', 'recall_high'))} FROM crv"),
    "e8_average_precision": (ap, f"WITH {V.MATCHES}, {_curve()}, {_ap()} SELECT dataset, {', '.join(f'round({c}, 6) AS {c}' for c in ('ap_total', 'ap_low', 'ap_med', 'ap_high'))} FROM ap UNION ALL SELECT DISTINCT 'missed', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM matches WHERE kind = 'fn' AND image_id % 7 = 0"),
    "e9_operating_points": (operating, f"""WITH {V.MATCHES}, {_curve()}, o AS (
      (SELECT DISTINCT ON (dataset) dataset, 'accuracy' AS point, {_OP} FROM crv ORDER BY dataset, accuracy DESC, rank) UNION ALL
      (SELECT DISTINCT ON (dataset) dataset, 'fp', {_OP} FROM crv ORDER BY dataset, abs(fp_share-0.1::DOUBLE), rank) UNION ALL
      (SELECT DISTINCT ON (dataset) dataset, 'recall', {_OP} FROM crv ORDER BY dataset, abs(recall_high-0.95::DOUBLE), rank)) SELECT dataset, point, {_OPR} FROM o"""),
    "e10_verdict": (verdict, f"""WITH {V.MATCHES}, mm AS (SELECT *, 'a' AS model FROM matches WHERE image_id%2=0 OR kind='fn' UNION ALL SELECT *, 'b' FROM matches WHERE image_id%3>0 OR kind='fn' UNION ALL SELECT *, 'ensemble' FROM matches),
      {_curve('mm', 'dataset, model')}, {_ap('dataset, model')}, v AS (SELECT dataset, max(CASE WHEN model<>'ensemble' THEN ap_total END) AS best_single, max(CASE WHEN model='ensemble' THEN ap_total END) AS ensemble FROM ap GROUP BY 1)
      SELECT dataset, round(best_single,6) AS best_single, round(ensemble,6) AS ensemble, round(ensemble-best_single,6) AS delta, CASE WHEN ensemble-best_single > 1e-4 THEN 'WIN' WHEN ensemble-best_single >= -1e-4 THEN 'tie' ELSE 'no gain' END AS verdict FROM v"""),
    "e11_strata": (strata, f"""WITH {V.MATCHES}, g AS (SELECT level, label, CASE WHEN xc*4 < 341 THEN 0 WHEN xc*4 < 682 THEN 1 ELSE 2 END AS q, kind='tp' AS hit FROM matches WHERE kind <> 'fp'),
      s AS (SELECT 'level' AS stratum, level::BIGINT AS value, hit FROM g UNION ALL SELECT 'label', label, hit FROM g UNION ALL SELECT 'q_third', q, hit FROM g UNION ALL SELECT 'all', -1, hit FROM g)
      SELECT stratum, value, count(*) AS n, count_if(hit)::BIGINT AS n_found, round(count_if(hit)/count(*)::DOUBLE,6) AS recall FROM s GROUP BY ALL"""),
    "e12_false_positives": (fp_profile, f"""WITH {V.MATCHES}, f AS (SELECT * FROM matches WHERE kind='fp') SELECT (SELECT count(DISTINCT image_id) FROM matches) AS n_images, count(*) AS n_fp, round(avg(score),6) AS mean, round(quantile_cont(score,0.5),6) AS p50,
      round(quantile_cont(score,0.9),6) AS p90, round(avg((score>0.5)::INTEGER),6) AS share_sure, round(avg((label=1)::INTEGER),6) AS share_ring, round(count(*)/(SELECT count(DISTINCT image_id) FROM matches)::DOUBLE,6) AS per_image FROM f"""),
    "e13_histograms": (histograms, f"""WITH {V.MATCHES}, h AS (SELECT 'q_'||kind AS series, least(floor(xc/250*30),29)::BIGINT AS bin FROM matches WHERE kind<>'fp' AND xc BETWEEN 0 AND 250
      UNION ALL SELECT 'score', least(floor((score-0.3::DOUBLE)/(1.0::DOUBLE-0.3::DOUBLE)*30),29)::BIGINT FROM matches WHERE kind='fp' AND score BETWEEN 0.3 AND 1.0
      UNION ALL SELECT 'dist', least(floor(least(abs(xc-100),60)/60*20),19)::BIGINT FROM matches) SELECT series, bin, count(*) AS n FROM h GROUP BY ALL"""),
    "e14_intensity_rank": (intensity, f"""WITH {V.LONG_PIXELS}, {V.MATCHES}, pr AS (SELECT vec_id, c, sum(x)/greatest(count_if(x<>0),1) AS i FROM long_pixels GROUP BY ALL),
      rk AS (SELECT *, (row_number() OVER (PARTITION BY vec_id ORDER BY i, c) - 1)/8.0::DOUBLE AS pct FROM pr),
      m AS (SELECT kind, image_id%500 AS vec_id, greatest(0,least(7,floor(xc/32)))::INTEGER AS c FROM matches WHERE kind<>'fn')
      SELECT kind, count(*) AS n, round(avg(pct),6) AS mean, round(quantile_cont(pct,0.5),6) AS median FROM m JOIN rk USING (vec_id, c) GROUP BY 1"""),
    "e15_nearest_truth": (nearest, f"""WITH {V.MATCHES}, n AS (SELECT d.image_id, d.det, min(abs(d.xc-t.xc)) AS dist FROM (SELECT * FROM matches WHERE kind<>'fn') d LEFT JOIN (SELECT * FROM matches WHERE kind<>'fp') t USING (image_id) GROUP BY ALL)
      SELECT count(*) AS n, count_if(dist IS NULL)::BIGINT AS n_without, round(quantile_cont(dist,0.5),6) AS median, round(avg((coalesce(dist,1e300)<8)::INTEGER),6) AS share_8, round(avg((coalesce(dist,1e300)>20)::INTEGER),6) AS share_over_20 FROM n"""),
    "e16_confusion": (confusion, f"WITH {V.BOXES} SELECT count_if(label=1 AND score>0.5)::BIGINT AS tp, count_if(label=0 AND score>0.5)::BIGINT AS fp, count_if(label=0 AND score<=0.5)::BIGINT AS tn, count_if(label=1 AND score<=0.5)::BIGINT AS fn FROM boxes"),
    "e17_overlays": (overlays, f"WITH {V.MATCHES} SELECT image_id, kind, count(*) AS n, string_agg(det::VARCHAR, ',' ORDER BY det) AS dets FROM matches WHERE image_id IN (SELECT DISTINCT image_id FROM matches ORDER BY 1 LIMIT 4) GROUP BY ALL"),
    "e18_top_k_accuracy": (top_accuracy, f"""WITH {V.BOXES}, l AS (SELECT image_id||'-'||det AS row, qty%5 AS target, k AS class, ((cents*(k+3)*31)%97)::DOUBLE AS score FROM boxes, (SELECT unnest([0,1,2,3,4]) AS k)),
      r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, class) AS rk FROM l), h AS (SELECT row, max((class=target AND rk<=1)::INTEGER) AS h1, max((class=target AND rk<=2)::INTEGER) AS h2 FROM r GROUP BY 1)
      SELECT 1::BIGINT AS k, round(100*avg(h1),6) AS accuracy FROM h UNION ALL SELECT 2, round(100*avg(h2),6) FROM h"""),
    "e19_count_error": (count_error, f"""WITH {V.TRUTHS}, a AS (SELECT image_id, count(*) AS a FROM boxes WHERE score > 0.5 GROUP BY 1), b AS (SELECT image_id, count(*) AS b FROM truths GROUP BY 1)
      SELECT count(*) AS n_images, round(avg(abs(coalesce(a,0)-coalesce(b,0))),6) AS error FROM a FULL JOIN b USING (image_id)"""),
    "e20_side_by_side": (side, f"""WITH {V.TRUTHS}, u AS (SELECT image_id, 'gt' AS side, label, 1.0::DOUBLE AS score FROM truths UNION ALL SELECT image_id, 'pred', label, score FROM boxes)
      SELECT image_id, side, count(*) AS n, sum(label)::BIGINT AS n_rings, round(max(score),6) AS best FROM u GROUP BY ALL"""),
    "e21_vector_statistics": (vectors, f"""WITH {V.LONG_PIXELS}, m AS (SELECT vec_id, max(x) AS t, sum(exp(x)) AS z FROM long_pixels GROUP BY 1)
      SELECT vec_id, round(max(x),6) AS largest, round(min(x),6) AS least, round(avg(x),6) AS mean, round(var_samp(x),6) AS variance, round(stddev_samp(x),6) AS deviation, round(sum(exp(x)/z*ln(exp(x)/z+1e-9)),6) AS entropy FROM long_pixels JOIN m USING (vec_id) GROUP BY 1"""),
}
