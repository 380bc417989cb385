"""Detections: raw outputs to boxes, suppression, fusion, ensembles.

Detections have image_id, det, x1..y2, score, label (0 segment, 1 ring). Order is total: score falling, then det.
"""

from __future__ import annotations

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.kernels import fuse, nms_groups
from ..functions.walk import begins, groups
from .boxes import XYXY, cxcywh_to_xyxy, looks_like_ring

SEGMENT_IOU, RING_IOU, SINGLE_IOU = 0.4, 0.1, 0.4
TOP_K = 225


def _array(g: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([g[c] for c in XYXY], 1)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def top_k(raw: DataFrame, k: int = TOP_K, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Logits per query to the k best (query, class) pairs of each image; a query may come once per class."""
    long = raw.select(*keys, "query", "cx", "cy", "w", "h", F.posexplode("logits").alias("label", "logit")).withColumn("score", sigmoid(F.col("logit")))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "query", "label")
    best = long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    box = dict(zip(XYXY, cxcywh_to_xyxy("cx", "cy", "w", "h")))
    return best.withColumns(box).select(*keys, "query", "label", "rank", "score", *XYXY)


def scale(dets: DataFrame, sizes: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Boxes in [0, 1] to the pixels of each image (image_id, width, height)."""
    j = dets.join(sizes, list(keys))
    return j.withColumns({c: F.col(c) * F.col("width" if c[0] == "x" else "height") for c in XYXY}).drop("width", "height")


def suppress(dets: DataFrame, thresholds: dict[int, float] | float = None, keys: tuple[str, ...] = ("image_id",), by_label: bool = True) -> DataFrame:
    """Greedy suppression per image, and per label unless by_label is off; an overlap above the threshold goes.

    Images are bounded (top-k), so whole images are walked in order inside a partition, many per Python call.
    """
    thresholds = {0: SEGMENT_IOU, 1: RING_IOU} if thresholds is None else thresholds
    group = [*keys, "label"] if by_label else list(keys)

    def run(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        first = begins(*[g[c] for c in group])
        limits = np.full(len(first), thresholds) if isinstance(thresholds, float) else np.array([thresholds[x] for x in g["label"][first].tolist()], float)
        keep = nms_groups(_array(g), first, limits[:, None])[:, 0]
        return {c: v[keep] for c, v in g.items()}

    return groups(dets, group, [F.desc("score"), F.asc("det")], run, dets.schema, many=True, by=list(keys))


def suppress_by_shape(dets: DataFrame, height: float = 512.0, ring_iou: float = RING_IOU, segment_iou: float = SEGMENT_IOU) -> DataFrame:
    """The class follows from the height, then suppression per class."""
    return suppress(dets.withColumn("label", looks_like_ring(height).cast("int")), {0: segment_iou, 1: ring_iou})


def above(dets: DataFrame, score: float) -> DataFrame:
    """P5: strictly above the score."""
    return dets.where(F.col("score") > score)


def pool(models: list[DataFrame], score: float = 0.1) -> DataFrame:
    """Ensemble by pooling: all models' detections, one suppression, one threshold. det numbers must not clash."""
    union = models[0]
    for m in models[1:]:
        union = union.unionByName(m)
    return above(suppress(union), score)


def fuse_boxes(dets: DataFrame, models: int, threshold: float = 0.55, model: str = "model") -> DataFrame:
    """Weighted box fusion per image of the detections of several models: image_id, n, x1..y2, score, label."""

    def run(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        boxes, scores, labels = fuse(_array(g), g["score"], g["label"], g[model], models, threshold)
        return {"image_id": np.repeat(g["image_id"][:1], len(boxes)), "n": np.arange(len(boxes)), **{c: boxes[:, k] for k, c in enumerate(XYXY)}, "score": scores, "label": labels}

    schema = "image_id long, n long, x1 double, y1 double, x2 double, y2 double, score double, label int"
    return groups(dets.select("image_id", model, "det", *XYXY, "score", "label"), ["image_id"], [F.desc("score"), F.asc(model), F.asc("det")], run, schema)


def marked(dets: DataFrame, ious: list[float], ring_iou: float = RING_IOU) -> DataFrame:
    """The detections with `marks`, the thresholds (bit k: the k-th) at which they stay; those that never do are left out."""

    def run(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        first = begins(g["image_id"], g["label"])
        limits = np.where((g["label"][first] == 1)[:, None], ring_iou, np.array(ious, float)[None])
        marks = nms_groups(_array(g), first, limits) @ (1 << np.arange(len(ious), dtype=np.int64))
        return {c: v[marks > 0] for c, v in g.items()} | {"marks": marks[marks > 0]}

    schema = dets.withColumn("marks", F.lit(0).cast("long")).schema
    return groups(dets, ["image_id", "label"], [F.desc("score"), F.asc("det")], run, schema, many=True, by=["image_id"])


def sweep(dets: DataFrame, ious: list[float], ring_iou: float = RING_IOU) -> DataFrame:
    """Suppression at several segment thresholds in one pass over the images: the detections with segment_iou."""
    at = [F.when(F.col("marks").bitwiseAND(F.lit(1 << k)) != 0, F.lit(float(t))) for k, t in enumerate(ious)]
    return marked(dets, ious, ring_iou).withColumn("segment_iou", F.explode(F.array_compact(F.array(*at)))).drop("marks")
