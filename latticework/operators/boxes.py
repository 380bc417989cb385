"""Box geometry and annotation tables: projections and filters on boxes keyed by image.

Boxes are x1, y1, x2, y2 in pixels unless a name says otherwise. Functions on columns take the names of four columns.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import dice
from ..functions.store import stored

XYXY = ("x1", "y1", "x2", "y2")
EPS = 1e-6


def _cols(names) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in names]


# ---- B1: conversions ------------------------------------------------------------------------------------------------


def cxcywh_to_xyxy(cx, cy, w, h) -> list[Column]:
    cx, cy, w, h = _cols((cx, cy, w, h))
    return [cx - 0.5 * w, cy - 0.5 * h, cx + 0.5 * w, cy + 0.5 * h]


def xyxy_to_cxcywh(names=XYXY) -> list[Column]:
    a, b, c, d = _cols(names)
    return [(a + c) / 2, (b + d) / 2, c - a, d - b]


def xyxy_to_xywh(names=XYXY) -> list[Column]:
    a, b, c, d = _cols(names)
    return [a, b, c - a, d - b]


def xywh_to_xyxy(x, y, w, h) -> list[Column]:
    x, y, w, h = _cols((x, y, w, h))
    return [x, y, x + w, y + h]


def area(names=XYXY) -> Column:
    a, b, c, d = _cols(names)
    return (c - a) * (d - b)


# ---- B2-B4: overlap ---------------------------------------------------------------------------------------------------


def overlap(p, q) -> tuple[Column, Column]:
    """Intersection and union."""
    a, b = _cols(p), _cols(q)
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return w * h, area(p) + area(q) - w * h


def iou(p, q, eps: float = 0.0) -> Column:
    """B2: row-wise without, all pairs of two images with a small addend; boxes without area give 0."""
    both, union = overlap(p, q)
    return F.when(union + eps > 0, both / F.nullif(union + eps, F.lit(0.0))).otherwise(0.0)


def hull(p, q) -> list[Column]:
    a, b = _cols(p), _cols(q)
    return [F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])]


def giou(p, q, eps: float = 0.0) -> Column:
    """Generalised IoU."""
    both, union = overlap(p, q)
    outer = area(hull(p, q))
    return both / F.nullif(union + eps, F.lit(0.0)) - (outer - union) / F.nullif(outer + eps, F.lit(0.0))


def _terms(p, q) -> dict[str, Column]:
    """IoU, squared centre distance, squared diagonal of the hull, and the aspect term."""
    a, b = xyxy_to_cxcywh(p), xyxy_to_cxcywh(q)
    h = hull(p, q)
    near = F.pow(a[0] - b[0], 2) + F.pow(a[1] - b[1], 2)
    far = F.pow(h[2] - h[0], 2) + F.pow(h[3] - h[1], 2)
    aspect = F.lit(4 / pi**2) * F.pow(F.atan(b[2] / F.nullif(b[3], F.lit(0.0))) - F.atan(a[2] / F.nullif(a[3], F.lit(0.0))), 2)
    return {"_iou": iou(p, q), "_near": near, "_far": far, "_aspect": aspect}


def _diou(t: dict[str, Column]) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), t["_iou"] - t["_near"] / F.nullif(t["_far"], F.lit(0.0))))


def _ciou(t: dict[str, Column]) -> Column:
    i, v = t["_iou"], t["_aspect"]
    alpha = F.when(i > 0.5, v / (1 - i + v)).otherwise(0.0)
    alpha = F.when(v > 0, alpha).otherwise(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), i - t["_near"] / F.nullif(t["_far"], F.lit(0.0)) - alpha * v))


def diou(p, q) -> Column:
    """IoU less the squared centre distance over the squared diagonal of the hull, in [-1, 1]."""
    return _diou(_terms(p, q))


def ciou(p, q) -> Column:
    """DIoU less the aspect term, which counts only where IoU is above one half."""
    return _ciou(_terms(p, q))


def centred_overlaps(rows: DataFrame, p, q) -> DataFrame:
    """The rows with `diou` and `ciou`. What both use are columns of their own, so a row computes each of them once."""
    terms = _terms(p, q)
    t = {n: F.col(n) for n in terms}
    return rows.withColumns(terms).withColumns({"diou": _diou(t), "ciou": _ciou(t)}).drop(*terms)


def decode_boxes(rows: DataFrame, boxes: dict[str, tuple]) -> DataFrame:
    """Raw outputs to boxes: sigmoid of all four, then the exponential of the sizes; the corners of box n are columns n_x1 .. n_y2."""
    sigmoid = lambda c: 1 / (1 + F.exp(-c))
    at = lambda n, k: f"_{n}_{k}"
    raw = {at(n, k): sigmoid(c) if k < 2 else F.exp(sigmoid(c)) for n, names in boxes.items() for k, c in enumerate(_cols(names))}
    corners = {f"{n}_{x}": c for n in boxes for x, c in zip(XYXY, cxcywh_to_xyxy(*[at(n, k) for k in range(4)]))}
    return rows.withColumns(raw).withColumns(corners).drop(*raw)


def raw_distances(rows: DataFrame, p, q) -> DataFrame:
    """The rows with the DIoU and CIoU distances (1 - x) of two raw outputs, as `diou` and `ciou`."""
    corners = [[f"{n}_{x}" for x in XYXY] for n in ("_p", "_q")]
    d = centred_overlaps(decode_boxes(rows, {"_p": p, "_q": q}), *corners)
    return d.withColumns({c: 1 - F.col(c) for c in ("diou", "ciou")}).drop(*corners[0], *corners[1])


def pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of boxes of an image: left columns as they are, right ones with the prefix p_."""
    renamed = right.select(*keys, *[F.col(c).alias(f"p_{c}") for c in right.columns if c not in keys])
    return left.join(renamed, keys)


P_XYXY = tuple(f"p_{c}" for c in XYXY)
#: Side of a grid cell in pixels, about that of a large box.
CELL = 64.0
#: Left boxes of an image up to which all of its pairs are made.
FEW = 64


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], cell: float = CELL) -> DataFrame:
    """Pairs as in `pairs`, but only those of boxes that overlap.

    An image of at most `FEW` left boxes is joined as it is. In others both sides are dealt to the grid cells that their boxes touch and meet
    there by an equi-join, each pair in the cell of its common part's first corner only. So an image of many boxes is spread over its
    cells, and its boxes meet their neighbours, not all others.
    """
    crowded = stored(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW).select(*keys, F.lit(True).alias("_many")), "crowded")

    def at(x) -> Column:
        return F.floor((F.col(x) if isinstance(x, str) else x) / cell)

    def dealt(df: DataFrame, p: str) -> DataFrame:
        across, down = F.sequence(at(f"{p}x1"), F.greatest(at(f"{p}x1"), at(f"{p}x2"))), F.sequence(at(f"{p}y1"), F.greatest(at(f"{p}y1"), at(f"{p}y2")))
        few = F.array(F.lit(0).cast("long"))
        df = df.join(crowded, keys, "left").withColumn("_many", F.col("_many").isNotNull())
        return df.withColumn("_cx", F.explode(F.when(F.col("_many"), across).otherwise(few))).withColumn("_cy", F.explode(F.when(F.col("_many"), down).otherwise(few)))

    renamed = right.select(*keys, *[F.col(c).alias(f"p_{c}") for c in right.columns if c not in keys])
    x, y = F.greatest("x1", "p_x1"), F.greatest("y1", "p_y1")
    overlaps = (x < F.least("x2", "p_x2")) & (y < F.least("y2", "p_y2"))
    if crowded.isEmpty():
        return left.join(renamed, keys).where(overlaps)
    met = dealt(left, "").join(dealt(renamed, "p_").drop("_many"), [*keys, "_cx", "_cy"])
    return met.where(overlaps & (~F.col("_many") | ((F.col("_cx") == at(x)) & (F.col("_cy") == at(y))))).drop("_cx", "_cy", "_many")


# ---- B5-B8: annotations -------------------------------------------------------------------------------------------------


def masks_to_boxes(pixels: DataFrame, keys: list[str], row: str = "r", col: str = "c") -> DataFrame:
    """Bounding box of the pixels of each segment."""
    return pixels.groupBy(*keys).agg(F.min(col).cast("double").alias("x1"), F.min(row).cast("double").alias("y1"), F.max(col).cast("double").alias("x2"), F.max(row).cast("double").alias("y2"))


def normalise(annotations: DataFrame) -> DataFrame:
    """image_id, category_id, iscrowd, area, x, y, w, h, width, height: no crowds, xyxy clamped to the image, empty boxes dropped."""
    box = xywh_to_xyxy("x", "y", "w", "h")
    clamp = lambda c, top: F.least(F.greatest(c, F.lit(0.0)), F.col(top).cast("double"))
    out = annotations.where(F.coalesce(F.col("iscrowd"), F.lit(0)) == 0).withColumns(
        {"x1": clamp(box[0], "width"), "y1": clamp(box[1], "height"), "x2": clamp(box[2], "width"), "y2": clamp(box[3], "height")}
    )
    return out.where("x2 > x1 AND y2 > y1").drop("x", "y", "w", "h")


#: The ids that the 91-id category list of the public 80-class detection set leaves out (fixed values).
MISSING_CATEGORIES = (12, 26, 29, 30, 45, 66, 68, 69, 71, 83)


def compact_category(category: Column | str) -> Column:
    """Category id (1-90) to a compact id (0-79); ids outside the list give null."""
    c = F.col(category) if isinstance(category, str) else category
    below = sum((F.when(c > m, 1).otherwise(0) for m in MISSING_CATEGORIES), F.lit(0))
    return F.when((c >= 1) & (c <= 90) & ~c.isin(*MISSING_CATEGORIES), c - 1 - below)


def multi_hot(boxes: DataFrame, classes: int, image: str = "image_id", label: str = "label") -> DataFrame:
    """Per image a 0/1 vector of the labels that occur."""
    seen = boxes.groupBy(image).agg(F.collect_set(label).alias("_s"))
    return seen.select(image, F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.array_contains("_s", k).cast("int")).alias("labels"))


def box_label_vector(names=XYXY, label: str = "label") -> Column:
    """Box and label as one vector."""
    return F.array(*_cols(names), F.col(label).cast("double"))


# ---- B9-B11: sampling and augmentation ------------------------------------------------------------------------------------


def sample_known(boxes: DataFrame, probabilities: tuple[float, float, float, float] = (0.0, 0.0, 0.8, 0.2), seed: int = 0, image: str = "image_id", det: str = "det", label: str = "label") -> DataFrame:
    """Marks boxes as known, by one dice per image: with the four probabilities none, a random part (never all), all but one per
    label, or all."""
    d, mode = dice(seed, image), F.lit(3)
    for k in (2, 1, 0):
        mode = F.when(d < sum(probabilities[: k + 1]), k).otherwise(mode)
    order = dice(seed + 1, image, det)
    in_image = Window.partitionBy(image)
    rank = F.row_number().over(in_image.orderBy(order, det))
    count = F.count(F.lit(1)).over(in_image)
    in_label = F.row_number().over(Window.partitionBy(image, label).orderBy(order, det))
    part = F.floor(dice(seed + 2, image) * count)
    marked = boxes.withColumn("mode", mode)
    mode = F.col("mode")
    return marked.withColumn("known", F.when(mode == 0, False).when(mode == 1, rank <= part).when(mode == 2, in_label > 1).otherwise(True))


def split_classes(boxes: DataFrame, share: float, seed: int = 0, label: str = "label") -> DataFrame:
    """Whole classes are known or unknown."""
    return boxes.withColumn("known", dice(seed, label) < share)


def jitter(boxes: DataFrame, ratio: float = 0.02, drop: float = 0.2, seed: int = 0, keys=("image_id", "det"), size: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Drop boxes at random, then move centre and size by up to ratio of the frame's size (width, height) each: j1..j4 as corners.
    Confidence is the IoU with the original, itself up to ratio more or less."""
    shift = lambda k: (dice(seed + k, *keys) - 0.5) * 2 * ratio
    moved = [c + shift(k + 1) * size[k % 2] for k, c in enumerate(xyxy_to_cxcywh())]
    kept = boxes.where(dice(seed, *keys) > drop).withColumns(dict(zip(("_cx", "_cy", "_w", "_h"), moved)))
    kept = kept.withColumns(dict(zip(("j1", "j2", "j3", "j4"), cxcywh_to_xyxy("_cx", "_cy", "_w", "_h")))).drop("_cx", "_cy", "_w", "_h")
    return kept.withColumn("confidence", iou(XYXY, ("j1", "j2", "j3", "j4"), 1e-6) * (1 + shift(5)))


def cutout(boxes: DataFrame, seed: int = 0, keys=("image_id", "det")) -> DataFrame:
    """For each unknown box one of half its size near its centre (j1..j4), with a random confidence of one half or more."""
    cx, cy, w, h = xyxy_to_cxcywh()
    moved = [cx + w * (dice(seed + 1, *keys) - 0.5) / 2, cy + h * (dice(seed + 2, *keys) - 0.5) / 2, w / 2, h / 2]
    out = boxes.withColumns(dict(zip(("_cx", "_cy", "_w", "_h"), moved)))
    out = out.withColumns(dict(zip(("j1", "j2", "j3", "j4"), cxcywh_to_xyxy("_cx", "_cy", "_w", "_h")))).drop("_cx", "_cy", "_w", "_h")
    return out.withColumn("confidence", 0.5 + dice(seed, *keys) / 2)


def crop(boxes: DataFrame, left: float, top: float, width: float, height: float) -> DataFrame:
    """Boxes in the crop's coordinates, clamped, with new areas; boxes without area go."""
    fit = lambda c, off, size: F.least(F.greatest(F.col(c) - off, F.lit(0.0)), F.lit(float(size)))
    out = boxes.withColumns({"x1": fit("x1", left, width), "y1": fit("y1", top, height), "x2": fit("x2", left, width), "y2": fit("y2", top, height)})
    return out.where("x2 > x1 AND y2 > y1").withColumn("area", area())


def hflip(boxes: DataFrame, width: float) -> DataFrame:
    return boxes.withColumns({"x1": width - F.col("x2"), "x2": width - F.col("x1")})


def flip_both(boxes: DataFrame, width: float, height: float) -> DataFrame:
    return boxes.withColumns({"x1": width - F.col("x2"), "x2": width - F.col("x1"), "y1": height - F.col("y2"), "y2": height - F.col("y1")})


def resize(boxes: DataFrame, rx: float, ry: float) -> DataFrame:
    return boxes.withColumns({"x1": F.col("x1") * rx, "x2": F.col("x2") * rx, "y1": F.col("y1") * ry, "y2": F.col("y2") * ry}).withColumn("area", area())


def rotate(boxes: DataFrame, degrees: float, width: float, height: float) -> DataFrame:
    """Rotate about the image centre; the bounding box of the corners, scaled back to the image's size and clamped."""
    from math import cos, radians, sin

    c, s = abs(cos(radians(degrees))), abs(sin(radians(degrees)))
    cos_, sin_ = cos(radians(degrees)), sin(radians(degrees))
    new_w, new_h = width * c + height * s, width * s + height * c
    xs, ys = [], []
    for x in ("x1", "x2"):
        for y in ("y1", "y2"):
            dx, dy = F.col(x) - width / 2, F.col(y) - height / 2
            xs.append((cos_ * dx + sin_ * dy + new_w / 2) * (width / new_w))
            ys.append((-sin_ * dx + cos_ * dy + new_h / 2) * (height / new_h))
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(top)))
    return boxes.withColumns({"x1": clamp(F.least(*xs), width), "y1": clamp(F.least(*ys), height), "x2": clamp(F.greatest(*xs), width), "y2": clamp(F.greatest(*ys), height)})


def centred_in_crop(boxes: DataFrame, left: float, top: float, width: float, height: float, least_iou: float = 0.0, image: str = "image_id") -> DataFrame:
    """Boxes whose centre is inside the crop, of images with a box that overlaps it enough."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    frame = [F.lit(float(v)) for v in (left, top, left + width, top + height)]
    best = F.max(iou(XYXY, frame)).over(Window.partitionBy(image))
    marked = boxes.withColumn("_best", best).where(F.col("_best") >= least_iou).drop("_best")
    return marked.where((cx > left) & (cx < left + width) & (cy > top) & (cy < top + height))


# ---- B12-B16: peaks and images -----------------------------------------------------------------------------------------


def peaks_to_boxes(peaks: DataFrame, min_confidence: float | None = None) -> DataFrame:
    """Radius, radius_width, angle, angle_width, visibility, score, q_max to polar pixels; visibility 0 is dropped."""
    x, w = F.col("radius") / F.col("q_max") * 1024, F.col("radius_width") / F.col("q_max") * 1024
    y, h = F.col("angle") * (512 / 90), F.col("angle_width") * (512 / 90)
    confidence = F.when(F.col("visibility") == 3, 1.0).when(F.col("visibility") == 2, 0.5).when(F.col("visibility") == 1, 0.1).otherwise(F.col("score"))
    out = peaks.where("visibility IS NULL OR visibility <> 0").withColumns({"x1": x - w / 2, "y1": y - h / 2, "x2": x + w / 2, "y2": y + h / 2, "confidence": confidence})
    return out if min_confidence is None else out.where(F.col("confidence") >= min_confidence)


def rois_to_boxes(rois: DataFrame, quasi: bool = False, min_confidence: float | None = None) -> DataFrame:
    """Radius, width, angle, angle_std, confidence_level, h, w of the image to polar or quasi-polar pixels."""
    scale = 1024 / F.sqrt(F.pow("h", 2.0) + F.pow("w", 2.0))
    x, dx = F.col("radius") * scale, F.col("width") * scale / 2
    y, dy = F.col("angle") * (512 / 90), F.col("angle_std") * (512 / 90) / 2
    if quasi:
        ratio = 0.6 / (1e-4 + x / 1024)
        y, dy = y / ratio, dy / ratio
    out = rois.withColumns({"x1": x - dx, "y1": y - dy, "x2": x + dx, "y2": y + dy})
    return out if min_confidence is None else out.where(F.col("confidence_level") >= min_confidence)


def elongated() -> Column:
    """Height above 1.15 times the width."""
    return (F.col("x2") - F.col("x1")) * 1.15 < F.col("y2") - F.col("y1")


def looks_like_ring(height: float = 512.0) -> Column:
    """At least 0.35 of the image's height."""
    return F.col("y2") - F.col("y1") >= 0.35 * height


def level_counts(boxes: DataFrame, image: str = "image_id", level: str = "level") -> DataFrame:
    """Low, medium and high labels per image."""
    return boxes.groupBy(image).agg(*[F.count_if(F.col(level) == k).alias(n) for k, n in ((1, "n_low"), (2, "n_medium"), (3, "n_high"))])


def one_per_image(results: DataFrame, image: str = "image_id", order: str = "ord") -> DataFrame:
    """Of the results that several workers have for an image, the first; pre-aggregated."""
    rest = [c for c in results.columns if c not in (image,)]
    return results.groupBy(image).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(image, "_r.*")
