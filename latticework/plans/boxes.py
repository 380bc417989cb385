"""Box queries on the boxes view, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes as B
from . import views as V

R = lambda c, n=6: F.round(c, n)
# a little above ties, so that both engines round alike; also makes -0 a 0
UP = lambda c: F.round(c + 1e-9, 6)


def _rounded(cols, names):
    return [R(c).alias(n) for c, n in zip(cols, names)]


def conversions(s, d):
    b = V.boxes(s, d)
    c = b.select("image_id", "det", *_rounded(B.xyxy_to_cxcywh(), ("cx", "cy", "w", "h")), *_rounded(B.xyxy_to_xywh(), ("bx", "by", "bw", "bh")))
    return c.select("*", *_rounded(B.cxcywh_to_xyxy("cx", "cy", "w", "h"), B.XYXY))


def pairs(s, d):
    """All pairs of predictions and truths of an image: IoU, GIoU, DIoU, CIoU."""
    p = B.pairs(V.truths(s, d).drop("label", "level"), V.boxes(s, d).select("image_id", "det", *B.XYXY), ["image_id"])
    q = B.P_XYXY
    measures = {"iou": B.iou(B.XYXY, q, 1e-6), "giou": B.giou(B.XYXY, q, 1e-6), "giou_rows": B.giou(B.XYXY, q), "diou": F.col("diou"), "ciou": F.col("ciou")}
    return B.centred_overlaps(p, B.XYXY, q).select("image_id", "gt", F.col("p_det").alias("det"), *[UP(c).alias(n) for n, c in measures.items()])


def mask_boxes(s, d):
    px = V.long_pixels(s, d).where("x > 0.1")
    return B.masks_to_boxes(px, ["vec_id"])


def annotations(s, d):
    b = V.boxes(s, d)
    a = b.select("image_id", "det", (F.col("label") + 1).alias("category_id"), (F.col("cents") % 7 == 0).cast("int").alias("iscrowd"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), F.lit(180).alias("width"), F.lit(150).alias("height"))
    return B.normalise(a).drop("width", "height")


def categories(s, d):
    b = V.boxes(s, d).withColumn("category", (F.col("cents") % 95).cast("long"))
    return b.groupBy("category").agg(F.count(F.lit(1)).alias("n")).select("category", B.compact_category("category").cast("long").alias("compact"), "n")


def multi_hot(s, d):
    b = V.boxes(s, d).withColumn("label", (F.col("qty") % 8).cast("int"))
    return B.multi_hot(b, 8).select("image_id", F.array_join(F.transform("labels", lambda x: x.cast("string")), "").alias("labels"))


def known(s, d):
    """All four ways to part an image's boxes."""
    return B.sample_known(V.boxes(s, d), (0.2, 0.3, 0.3, 0.2), 3).select("image_id", "det", "mode", "known")


def jittered(s, d):
    """Known boxes moved, unknown ones cut out."""
    b = V.boxes(s, d)
    moved = B.jitter(b.where("cents % 2 = 0"), 0.02, 0.2, 5, size=(300.0, 400.0)).withColumn("kind", F.lit("known"))
    cut = B.cutout(b.where("cents % 2 = 1"), 11).withColumn("kind", F.lit("cutout"))
    return moved.unionByName(cut).select("kind", "image_id", "det", *[UP(F.col(c)).alias(c) for c in ("j1", "j2", "j3", "j4", "confidence")])


def raw_losses(s, d):
    """Distances of raw outputs."""
    b = V.boxes(s, d).withColumns({"p0": F.col("x1") / 100 - 1, "p1": F.col("y1") / 100 - 1, "p2": F.col("score") - 0.5, "p3": F.col("qty") / 50 - 0.5, "q0": F.col("x2") / 100 - 1, "q1": F.col("y2") / 150 - 1, "q2": F.col("score") * 2 - 1, "q3": F.col("cents") % 7 / 7.0})
    dist = B.raw_distances(b, ("p0", "p1", "p2", "p3"), ("q0", "q1", "q2", "q3"))
    return dist.select("image_id", "det", *[UP(F.col(c)).alias(c) for c in ("diou", "ciou")])


def transforms(s, d):
    b = V.boxes(s, d).select("image_id", "det", *B.XYXY)
    out = None
    for name, t in (("crop", B.crop(b, 30, 20, 100, 120)), ("hflip", B.hflip(b, 300)), ("both", B.flip_both(b, 300, 400)), ("resize", B.resize(b, 0.5, 2.0)), ("rotate", B.rotate(b, 30, 300, 400)), ("centred", B.centred_in_crop(b, 30, 20, 100, 120, 0.1))):
        t = t.select(F.lit(name).alias("kind"), "image_id", "det", *[R(F.col(c), 4).alias(c) for c in B.XYXY])
        out = t if out is None else out.unionByName(t)
    return out


def peaks(s, d):
    b = V.boxes(s, d)
    p = b.select("image_id", "det", (F.col("x1") / 100).alias("radius"), ((F.col("x2") - F.col("x1")) / 400).alias("radius_width"), (F.col("y1") / 3).alias("angle"), ((F.col("y2") - F.col("y1")) / 10).alias("angle_width"), (F.col("qty") % 4).cast("int").alias("visibility"), "score", F.lit(2.5).alias("q_max"))
    return B.peaks_to_boxes(p, 0.3).select("image_id", "det", *[R(F.col(c)).alias(c) for c in B.XYXY], "confidence")


def rois(s, d):
    b = V.boxes(s, d)
    r = b.select("image_id", "det", F.col("x1").alias("radius"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y1") / 3).alias("angle"), ((F.col("y2") - F.col("y1")) / 10).alias("angle_std"), F.element_at(F.array(F.lit(0.1), F.lit(0.5), F.lit(1.0)), (F.col("qty") % 3 + 1).cast("int")).alias("confidence_level"), F.lit(300.0).alias("h"), F.lit(400.0).alias("w"))
    out = [B.rois_to_boxes(r, quasi, 0.5).select("image_id", "det", F.lit(quasi).alias("quasi"), *[R(F.col(c)).alias(c) for c in B.XYXY]) for quasi in (False, True)]
    return out[0].unionByName(out[1])


def shapes(s, d):
    return V.boxes(s, d).select("image_id", "det", B.elongated().alias("elongated"), B.looks_like_ring(200).alias("ring"))


def first_result(s, d):
    b = V.boxes(s, d).withColumn("ord", F.col("cents") * 100 + F.col("det"))
    return B.one_per_image(b.select("image_id", "ord", "score", "label"))


_PAIR = "p AS (SELECT t.image_id, t.gt, b.det, t.x1 AS a1, t.y1 AS a2, t.x2 AS a3, t.y2 AS a4, b.x1 AS b1, b.y1 AS b2, b.x2 AS b3, b.y2 AS b4 FROM truths t JOIN boxes b USING (image_id))"
_GEO = _PAIR + """, o AS (SELECT *, greatest(least(a3,b3)-greatest(a1,b1),0.0::DOUBLE)*greatest(least(a4,b4)-greatest(a2,b2),0.0::DOUBLE) AS i, (a3-a1)*(a4-a2) AS sa, (b3-b1)*(b4-b2) AS sb,
  greatest(a3,b3)-least(a1,b1) AS hw, greatest(a4,b4)-least(a2,b2) AS hh FROM p),
u AS (SELECT *, sa+sb-i AS u, hw*hh AS e, pow((a1+a3)/2-(b1+b3)/2,2)+pow((a2+a4)/2-(b2+b4)/2,2) AS near, hw*hw+hh*hh AS far,
  4/(pi()*pi())*pow(atan((b3-b1)/(b4-b2))-atan((a3-a1)/(a4-a2)),2) AS v FROM o)"""
_dice = lambda seed, *keys: f"(('0x'||substr(md5('{seed}|'||{"||'|'||".join(keys)}),1,7))::BIGINT / 268435456.0::DOUBLE)"
_clamp = lambda c, top: f"least(greatest({c}, 0.0::DOUBLE), {top}::DOUBLE)"


def _rotated() -> str:
    from math import cos, radians, sin

    c, s = cos(radians(30)), sin(radians(30))
    w, h = 300 * c + 400 * s, 300 * s + 400 * c
    xs = [f"(({c!r}::DOUBLE*({x}-150)+{s!r}::DOUBLE*({y}-200)+{w / 2!r}::DOUBLE)*{300 / w!r}::DOUBLE)" for x in ("x1", "x2") for y in ("y1", "y2")]
    ys = [f"(({-s!r}::DOUBLE*({x}-150)+{c!r}::DOUBLE*({y}-200)+{h / 2!r}::DOUBLE)*{400 / h!r}::DOUBLE)" for x in ("x1", "x2") for y in ("y1", "y2")]
    return f"{_clamp(f'least({",".join(xs)})', 300)}, {_clamp(f'least({",".join(ys)})', 400)}, {_clamp(f'greatest({",".join(xs)})', 300)}, {_clamp(f'greatest({",".join(ys)})', 400)}"


_IOU_CROP = "greatest(least(x2,130)-greatest(x1,30),0)*greatest(least(y2,140)-greatest(y1,20),0)"
_XY = ", ".join(f"round({c}, 4) AS {c}" for c in B.XYXY)
_XY6 = ", ".join(f"round({c}, 6) AS {c}" for c in B.XYXY)

PLANS = {
    "b1_conversions": (conversions, f"""WITH {V.BOXES} SELECT image_id, det, round((x1+x2)/2,6) AS cx, round((y1+y2)/2,6) AS cy, x2-x1 AS w, y2-y1 AS h,
      x1 AS bx, y1 AS by, x2-x1 AS bw, y2-y1 AS bh, x1, y1, x2, y2 FROM boxes"""),
    "b2_b4_overlaps": (pairs, f"""WITH {V.TRUTHS}, {_GEO} SELECT image_id, gt, det, round(i/(u+1e-6::DOUBLE)+1e-9::DOUBLE,6) AS iou, round(i/(u+1e-6::DOUBLE)-(e-u)/(e+1e-6::DOUBLE)+1e-9::DOUBLE,6) AS giou, round(i/u-(e-u)/e+1e-9::DOUBLE,6) AS giou_rows,
      round(greatest(-1.0::DOUBLE,least(1.0::DOUBLE,i/u-near/far))+1e-9::DOUBLE,6) AS diou,
      round(greatest(-1.0::DOUBLE,least(1.0::DOUBLE,i/u-near/far-CASE WHEN i/u>0.5 AND v>0 THEN v/(1-i/u+v) ELSE 0 END*v))+1e-9::DOUBLE,6) AS ciou FROM u"""),
    "b5_mask_boxes": (mask_boxes, f"WITH {V.LONG_PIXELS} SELECT vec_id, min(c)::DOUBLE AS x1, min(r)::DOUBLE AS y1, max(c)::DOUBLE AS x2, max(r)::DOUBLE AS y2 FROM long_pixels WHERE x > 0.1 GROUP BY 1"),
    "b6_annotations": (annotations, f"""WITH {V.BOXES}, a AS (SELECT image_id, det, label + 1 AS category_id, (cents % 7 = 0)::INTEGER AS iscrowd, {_clamp('x1', 180)} AS x1, {_clamp('y1', 150)} AS y1, {_clamp('x1+(x2-x1)', 180)} AS x2, {_clamp('y1+(y2-y1)', 150)} AS y2 FROM boxes)
      SELECT * FROM a WHERE iscrowd = 0 AND x2 > x1 AND y2 > y1"""),
    "b7_categories": (categories, f"""WITH {V.BOXES}, m AS (SELECT unnest([{', '.join(map(str, B.MISSING_CATEGORIES))}]) AS m), c AS (SELECT cents % 95 AS category, count(*) AS n FROM boxes GROUP BY 1)
      SELECT category, CASE WHEN category BETWEEN 1 AND 90 AND category NOT IN (SELECT m FROM m) THEN category - 1 - (SELECT count(*) FROM m WHERE m < category) END AS compact, n FROM c"""),
    "b8_multi_hot": (multi_hot, f"""WITH {V.BOXES}, g AS (SELECT image_id, list(DISTINCT qty % 8) AS s FROM boxes GROUP BY 1)
      SELECT image_id, array_to_string(list_transform(range(8), lambda k: CASE WHEN list_contains(s, k) THEN '1' ELSE '0' END), '') AS labels FROM g"""),
    "b4_raw_distances": (raw_losses, f"""WITH {V.BOXES}, s AS (SELECT image_id, det, [x1/100-1, y1/100-1, score-0.5::DOUBLE, qty/50-0.5::DOUBLE, x2/100-1, y2/150-1, score*2-1, (cents % 7)/7.0::DOUBLE] AS r FROM boxes),
      g AS (SELECT image_id, det, list_transform(r, lambda x: 1/(1+exp(-x))) AS r FROM s), e AS (SELECT image_id, det, r[1] AS cx, r[2] AS cy, exp(r[3]) AS w, exp(r[4]) AS h, r[5] AS dx, r[6] AS dy, exp(r[7]) AS v, exp(r[8]) AS k FROM g),
      o AS (SELECT *, greatest(least(cx+w/2,dx+v/2)-greatest(cx-w/2,dx-v/2),0)*greatest(least(cy+h/2,dy+k/2)-greatest(cy-h/2,dy-k/2),0) AS i, pow(greatest(cx+w/2,dx+v/2)-least(cx-w/2,dx-v/2),2)+pow(greatest(cy+h/2,dy+k/2)-least(cy-h/2,dy-k/2),2) AS far,
        pow(cx-dx,2)+pow(cy-dy,2) AS near, 4/(pi()*pi())*pow(atan(v/k)-atan(w/h),2) AS a FROM e), u AS (SELECT *, i/(w*h+v*k-i) AS iou FROM o)
      SELECT image_id, det, round(1-greatest(-1.0::DOUBLE,least(1.0::DOUBLE,iou-near/far))+1e-9::DOUBLE,6) AS diou, round(1-greatest(-1.0::DOUBLE,least(1.0::DOUBLE,iou-near/far-CASE WHEN iou>0.5 AND a>0 THEN a*a/(1-iou+a) ELSE 0 END))+1e-9::DOUBLE,6) AS ciou FROM u"""),
    "b9_known_boxes": (known, f"""WITH {V.BOXES}, k AS (SELECT image_id, det, label, {_dice(3, 'image_id')} AS d, {_dice(4, 'image_id', 'det')} AS o, {_dice(5, 'image_id')} AS p FROM boxes),
      r AS (SELECT *, CASE WHEN d < 0.2 THEN 0 WHEN d < 0.2::DOUBLE + 0.3::DOUBLE THEN 1 WHEN d < 0.2::DOUBLE + 0.3::DOUBLE + 0.3::DOUBLE THEN 2 ELSE 3 END AS mode, row_number() OVER (PARTITION BY image_id ORDER BY o, det) AS rk, count(*) OVER (PARTITION BY image_id) AS n, row_number() OVER (PARTITION BY image_id, label ORDER BY o, det) AS il FROM k)
      SELECT image_id, det, mode, CASE mode WHEN 0 THEN false WHEN 1 THEN rk <= floor(p * n) WHEN 2 THEN il > 1 ELSE true END AS known FROM r"""),
    "b10_jitter": (jittered, f"""WITH {V.BOXES}, k AS (SELECT *, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, x2-x1 AS w, y2-y1 AS h FROM boxes),
      m AS (SELECT *, cx + ({_dice(6, 'image_id', 'det')}-0.5::DOUBLE)*2*0.02::DOUBLE*300 AS mx, cy + ({_dice(7, 'image_id', 'det')}-0.5::DOUBLE)*2*0.02::DOUBLE*400 AS my, w + ({_dice(8, 'image_id', 'det')}-0.5::DOUBLE)*2*0.02::DOUBLE*300 AS mw, h + ({_dice(9, 'image_id', 'det')}-0.5::DOUBLE)*2*0.02::DOUBLE*400 AS mh,
        1 + ({_dice(10, 'image_id', 'det')}-0.5::DOUBLE)*2*0.02::DOUBLE AS f FROM k WHERE cents % 2 = 0 AND {_dice(5, 'image_id', 'det')} > 0.2::DOUBLE),
      o AS (SELECT *, greatest(least(x2,mx+mw/2)-greatest(x1,mx-mw/2),0)*greatest(least(y2,my+mh/2)-greatest(y1,my-mh/2),0) AS i FROM m),
      c AS (SELECT *, cx + w*({_dice(12, 'image_id', 'det')}-0.5::DOUBLE)/2 AS mx, cy + h*({_dice(13, 'image_id', 'det')}-0.5::DOUBLE)/2 AS my, 0.5::DOUBLE + {_dice(11, 'image_id', 'det')}/2 AS cf FROM k WHERE cents % 2 = 1),
      a AS (SELECT 'known' AS kind, image_id, det, mx-mw/2 AS j1, my-mh/2 AS j2, mx+mw/2 AS j3, my+mh/2 AS j4, i/(w*h+mw*mh-i+1e-6::DOUBLE)*f AS confidence FROM o UNION ALL SELECT 'cutout', image_id, det, mx-w/4, my-h/4, mx+w/4, my+h/4, cf FROM c)
      SELECT kind, image_id, det, {', '.join(f'round({x}+1e-9::DOUBLE,6) AS {x}' for x in ('j1', 'j2', 'j3', 'j4', 'confidence'))} FROM a"""),
    "b11_transforms": (transforms, f"""WITH {V.BOXES}, b AS (SELECT *, max({_IOU_CROP} / ((x2-x1)*(y2-y1)+12000-{_IOU_CROP})) OVER (PARTITION BY image_id) AS best FROM boxes),
      t AS (SELECT 'crop' AS kind, image_id, det, {_clamp('x1-30', 100)} AS x1, {_clamp('y1-20', 120)} AS y1, {_clamp('x2-30', 100)} AS x2, {_clamp('y2-20', 120)} AS y2 FROM b
      UNION ALL SELECT 'hflip', image_id, det, 300-x2, y1, 300-x1, y2 FROM b UNION ALL SELECT 'both', image_id, det, 300-x2, 400-y2, 300-x1, 400-y1 FROM b
      UNION ALL SELECT 'resize', image_id, det, x1*0.5::DOUBLE, y1*2.0::DOUBLE, x2*0.5::DOUBLE, y2*2.0::DOUBLE FROM b UNION ALL SELECT 'rotate', image_id, det, {_rotated()} FROM b
      UNION ALL SELECT 'centred', image_id, det, x1, y1, x2, y2 FROM b WHERE best >= 0.1 AND (x1+x2)/2 > 30 AND (x1+x2)/2 < 130 AND (y1+y2)/2 > 20 AND (y1+y2)/2 < 140)
      SELECT kind, image_id, det, {_XY} FROM t WHERE kind <> 'crop' OR (x2 > x1 AND y2 > y1)"""),
    "b12_peaks": (peaks, f"""WITH {V.BOXES}, p AS (SELECT image_id, det, x1/100/2.5::DOUBLE*1024 AS x, (x2-x1)/400/2.5::DOUBLE*1024 AS w, y1/3*(512::DOUBLE/90) AS y, (y2-y1)/10*(512::DOUBLE/90) AS h, qty % 4 AS v, score FROM boxes),
      q AS (SELECT image_id, det, x-w/2 AS x1, y-h/2 AS y1, x+w/2 AS x2, y+h/2 AS y2, CASE v WHEN 3 THEN 1.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE WHEN 1 THEN 0.1::DOUBLE ELSE score END AS confidence FROM p WHERE v <> 0)
      SELECT image_id, det, {_XY6}, confidence FROM q WHERE confidence >= 0.3"""),
    "b13_rois": (rois, f"""WITH {V.BOXES}, p AS (SELECT image_id, det, x1*(1024/500.0::DOUBLE) AS x, (x2-x1)*(1024/500.0::DOUBLE)/2 AS w, y1/3*(512::DOUBLE/90) AS y, (y2-y1)/10*(512::DOUBLE/90)/2 AS h FROM boxes WHERE qty % 3 > 0),
      q AS (SELECT *, false AS quasi, 1.0::DOUBLE AS k FROM p UNION ALL SELECT *, true, 0.6::DOUBLE/(1e-4::DOUBLE + x/1024) FROM p), z AS (SELECT image_id, det, quasi, x-w AS x1, y/k-h/k AS y1, x+w AS x2, y/k+h/k AS y2 FROM q)
      SELECT image_id, det, quasi, {_XY6} FROM z"""),
    "b14_shapes": (shapes, f"WITH {V.BOXES} SELECT image_id, det, 1.15::DOUBLE*(x2-x1) < y2-y1 AS elongated, y2-y1 >= 0.35::DOUBLE*200 AS ring FROM boxes"),
    "b15_level_counts": (lambda s, d: B.level_counts(V.truths(s, d)), f"WITH {V.TRUTHS} SELECT image_id, count_if(level=1)::BIGINT AS n_low, count_if(level=2)::BIGINT AS n_medium, count_if(level=3)::BIGINT AS n_high FROM truths GROUP BY 1"),
    "b16_one_per_image": (first_result, f"WITH {V.BOXES} SELECT image_id, min(cents*100+det) AS ord, min_by(score, cents*100+det) AS score, min_by(label, cents*100+det) AS label FROM boxes GROUP BY 1"),
}
