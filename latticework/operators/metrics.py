"""Matching of detections and ground truth, curves, operating points, diagnostics."""

from __future__ import annotations

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.kernels import MATCH_LIMIT, NO_MATCH, assign, best_matching, components, nms_groups, overlapping, running
from ..functions.ordered import before, parts_for, percentiles, sliced
from ..functions.store import stored
from ..functions.walk import begins, groups
from .boxes import CELL, FEW, P_XYXY, XYXY, iou, near_pairs, pairs
from .detections import RING_IOU, above

LEVELS = ((1, "low"), (2, "med"), (3, "high"))


# ---- E1-E5: matching -----------------------------------------------------------------------------------------------------


def q_costs(truths: DataFrame, dets: DataFrame, min_iou: float = 0.1, relative: bool = False) -> DataFrame:
    """Per pair of an image the distance of box centres along q, and their overlap (IoU); pairs at min_iou or below cost 1e7."""
    j = pairs(truths, dets, ["image_id"])
    cost = F.abs((F.col("x1") + F.col("x2") - F.col("p_x1") - F.col("p_x2")) / 2)
    cost = cost / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0)) if relative else cost
    j = j.withColumn("overlap", iou(XYXY, P_XYXY))
    return j.withColumn("cost", F.when(F.col("overlap") <= min_iou, F.lit(NO_MATCH)).otherwise(cost))


def gated(truths: DataFrame, dets: DataFrame, min_iou: float = 0.1, relative: bool = False) -> DataFrame:
    """The pairs of `q_costs` that may match, met on a grid: an image's boxes meet their neighbours only."""
    j = near_pairs(truths, dets, ["image_id"])
    cost = F.abs((F.col("x1") + F.col("x2") - F.col("p_x1") - F.col("p_x2")) / 2)
    cost = cost / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0)) if relative else cost
    return j.withColumns({"overlap": iou(XYXY, P_XYXY), "cost": cost}).where(F.col("overlap") > min_iou)


def assign_pairs(costs: DataFrame, limit: float = MATCH_LIMIT, carry: tuple[str, ...] = (), tie: str | None = None) -> DataFrame:
    """The cheapest one-to-one assignment of each image, from the pairs that may match; then pairs at the limit or above go.

    A pair that may not match costs more than all others together, so the cheapest assignment of the whole matrix has as many of the given pairs as
    possible; of such assignments the one of least total cost counts, then the one of most overlap (`tie`), then the lowest detections
    of the lowest truths. The components of an image are solved one by one: no matrix of a whole image is made. carry: double columns to keep.
    """
    used = list(dict.fromkeys([*carry, *([tie] if tie else [])]))

    def run(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        image = pd.factorize(g["image_id"])[0].astype(np.int64)
        a, b = (_numbers(image, g[c]) for c in ("gt", "det"))
        e = best_matching(a, b, g["cost"].astype(np.float64), g[tie] if tie else None)
        e = e[g["cost"][e] < limit]
        return {c: g[c][e] for c in ("image_id", "gt", "det", "cost", *carry)}

    narrow = costs.where(F.col("cost") < NO_MATCH).select("image_id", "gt", F.col("p_det").alias("det"), "cost", *used)
    return groups(narrow, ["image_id"], [F.asc("gt"), F.asc("det")], run, "image_id long, gt long, det long, cost double" + "".join(f", {c} double" for c in carry), many=True)


def assign_by_overlap(pairs_: DataFrame, limit: float = 0.0) -> DataFrame:
    """The one-to-one assignment of each image of most total IoU; pairs above the limit stay. pairs_: image_id, gt, p_det, overlap."""

    def run(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        gt, r = np.unique(g["gt"], return_inverse=True)
        det, c = np.unique(g["det"], return_inverse=True)
        kept = []
        for k in np.unique(group := components(r, c)):
            e = np.flatnonzero(group == k)
            rows, i = np.unique(r[e], return_inverse=True)
            cols, j = np.unique(c[e], return_inverse=True)
            m, at = np.zeros((len(rows), len(cols))), np.full((len(rows), len(cols)), -1)
            m[i, j], at[i, j] = -g["overlap"][e], e
            kept.append(at[assign(m)])
        e = np.concatenate(kept)
        e = e[e >= 0]
        e = e[g["overlap"][e] > limit]
        return {c: g[c][e] for c in ("image_id", "gt", "det", "overlap")}

    narrow = pairs_.where("overlap > 0").select("image_id", "gt", F.col("p_det").alias("det"), "overlap")
    return groups(narrow, ["image_id"], [F.asc("gt"), F.asc("det")], run, "image_id long, gt long, det long, overlap double")


def _numbers(image: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A number per (image, id), in order of both."""
    order = np.lexsort((ids, image))
    new = np.append(True, (np.diff(image[order]) != 0) | (np.diff(ids[order]) != 0))
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def match(truths: DataFrame, dets: DataFrame, min_iou: float = 0.1, limit: float = MATCH_LIMIT) -> DataFrame:
    """image_id, kind (tp, fp, fn), gt, det, cost, score, level. Images without ground truth give no false positives."""
    return _matches(truths, dets, assign_pairs(gated(truths, dets, min_iou), limit, carry=("p_score",), tie="overlap"))


def _matches(truths: DataFrame, dets: DataFrame, found: DataFrame) -> DataFrame:
    """The match rows of the assignment `found`."""
    # each found pair meets its truth and its detection in one join, so the assignment is planned once
    truth_side = F.struct(F.lit(True).alias("is_gt"), F.col("gt").alias("id"), F.col("det").alias("other"), "cost", "p_score")
    det_side = F.struct(F.lit(False).alias("is_gt"), F.col("det").alias("id"), F.col("gt").alias("other"), "cost", "p_score")
    links = found.select("image_id", F.inline(F.array(truth_side, det_side)))
    with_truth = dets.join(truths.select("image_id").distinct(), "image_id", "left_semi")
    sides = truths.select("image_id", F.lit(True).alias("is_gt"), F.col("gt").alias("id"), F.lit(None).cast("double").alias("own_score"), "level").unionByName(
        with_truth.select("image_id", F.lit(False).alias("is_gt"), F.col("det").alias("id"), F.col("score").alias("own_score"), F.lit(None).cast("int").alias("level"))
    )
    rows = sides.join(links, ["image_id", "is_gt", "id"], "left").where("is_gt OR other IS NULL")
    kind = F.when(~F.col("is_gt"), "fp").when(F.col("other").isNull(), "fn").otherwise("tp")
    return rows.select(
        "image_id", kind.alias("kind"), F.when(F.col("is_gt"), F.col("id")).alias("gt"), F.when(F.col("is_gt"), F.col("other")).otherwise(F.col("id")).alias("det"), "cost",
        F.coalesce("p_score", "own_score").alias("score"), "level",
    )


def image_counts(matches: DataFrame) -> DataFrame:
    """Tp, fp, fn per image; metric sets of images are unions and filters of match rows."""
    return matches.groupBy("image_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("tp", "fp", "fn")])


def merge(sets: list[DataFrame]) -> DataFrame:
    """Match rows of several sets; an image in two sets is an error of the caller and shows in `image_overlap`."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out


def image_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("image_id").distinct().intersect(b.select("image_id").distinct())


def mean_q_error(matched: DataFrame, score: float) -> DataFrame:
    """E5: mean signed q error of matched pairs above the score; needs x1, x2, p_x1, p_x2."""
    err = (F.col("p_x1") + F.col("p_x2") - F.col("x1") - F.col("x2")) / 2
    return matched.where(F.col("score") > score).agg(F.count(F.lit(1)).alias("n"), F.avg(err).alias("q_error"))


# ---- E6-E10: curves --------------------------------------------------------------------------------------------------------

def curve(matches: DataFrame, keys: list[str]) -> DataFrame:
    """A row per detection by falling score: recall, precision, accuracy, fp share, recall per level, interpolated precision; and
    what recall and interpolated precision were one detection earlier (`..._before`).

    One global order per key would put a whole data set into one task. Detections are dealt to ranges of (score, image, det)
    instead (`ordered.sliced`), whatever their ties: counts per slice are summed up over the few slices, a window runs inside each slice only.
    More detections make more slices, and more partitions for them, not larger ones.
    """
    narrow = stored(matches.select(*keys, "image_id", "det", "kind", "score", "level"), "matches")
    totals = narrow.where("kind <> 'fp'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gt"), *[F.count_if(F.col("level") == k).alias(f"gt_{n}") for k, n in LEVELS])
    order = [F.desc("score"), F.asc("image_id"), F.asc("det")]
    n_parts = parts_for(narrow.where("kind <> 'fn'"))
    spread = lambda df: df.repartition(n_parts, *keys, "_slice") if n_parts else df
    dets = sliced(narrow.where("kind <> 'fn'"), keys, order, "curve", n_parts)
    flags = {"tp": F.col("kind") == "tp", "fp": F.col("kind") == "fp"} | {f"tp_{n}": (F.col("kind") == "tp") & (F.col("level") == k) for k, n in LEVELS}
    offsets = before(dets, keys, {f"_{n}": F.count_if(c) for n, c in flags.items()})
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = spread(dets).join(offsets, [*keys, "_slice"]).withColumns({n: F.sum(c.cast("long")).over(inside) + F.col(f"_{n}") for n, c in flags.items()})
    r = run.join(F.broadcast(totals), keys)  # a row per key: detections are not gathered by data set
    share = lambda a, b: a / F.nullif(F.col(b), F.lit(0))
    col = F.col
    ratios = {"recall": ("tp", "n_gt")} | {f"recall_{n}": (f"tp_{n}", f"gt_{n}") for _, n in LEVELS}
    r = r.withColumns(
        {"rank": col("tp") + col("fp"), "precision": col("tp") / (col("tp") + col("fp")), "accuracy": col("tp") / (col("n_gt") + col("fp")), "fp_share": share(col("fp"), "n_gt")}
        | {n: share(col(a), b) for n, (a, b) in ratios.items()}
        | {f"{n}_before": share(col(a) - flags[a].cast("long"), b) for n, (a, b) in ratios.items()}
    )
    points = ["rank", "image_id", "det", "score", "recall", "precision", "accuracy", "fp_share", *[f"recall_{n}" for _, n in LEVELS], *[f"{n}_before" for n in ratios]]
    earlier = F.when(col("rank") > 1, (col("tp") - flags["tp"].cast("long")) / (col("rank") - 1))
    r = stored(r.select(*keys, "_slice", *points, earlier.alias("_earlier")), "curve-points")
    # Highest precision from here on, first over later slices, then inside the slice
    after = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    best = r.groupBy(*keys, "_slice").agg(F.max("precision").alias("_m")).select(*keys, "_slice", F.max("_m").over(after).alias("_later"))
    tail = Window.partitionBy(*keys, "_slice").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    r = spread(r).join(best, [*keys, "_slice"]).withColumn("interpolated", F.greatest(F.max("precision").over(tail), F.coalesce("_later", F.lit(0.0))))
    # the value one detection earlier is the greater of its precision and of what follows
    return r.withColumn("interpolated_before", F.greatest("_earlier", "interpolated")).select(*keys, *points, "interpolated", "interpolated_before")


def average_precision(points: DataFrame, keys: list[str], matches: DataFrame | None = None) -> DataFrame:
    """Trapezoids of interpolated precision over recall, from recall 0 at the first precision; levels share the precisions.

    Each point of the curve holds what it needs of the point before, so this is one aggregation. matches: what the curve was made of;
    keys that it has truths of and no detection get 0.
    """
    names = ["recall", *[f"recall_{n}" for _, n in LEVELS]]
    area = lambda n: F.sum((F.col(n) - F.col(f"{n}_before")) * (F.col("interpolated") + F.col("interpolated_before")) / 2)
    labels = ["ap_total", *[f"ap_{n}" for _, n in LEVELS]]
    found = points.groupBy(*keys).agg(*[area(n).alias(a) for n, a in zip(names, labels)])
    if matches is None:
        return found
    per = matches.groupBy(*keys).agg(F.count_if(F.col("kind") != "fn").alias("_n"))
    all_ = per.join(found, keys, "left") if keys else per.crossJoin(found)  # without keys a row each
    return all_.select(*keys, *[F.when(F.col("_n") == 0, 0.0).otherwise(F.col(a)).alias(a) for a in labels])


def operating_points(points: DataFrame, keys: list[str], fp_share: float = 0.1, recall_high: float = 0.95) -> DataFrame:
    """The first point of best accuracy, the point nearest to the fp share, the point nearest to the recall of sure labels."""
    row = F.struct("fp_share", "recall", *[f"recall_{n}" for _, n in LEVELS], F.col("score").alias("min_score"))
    first = lambda v: F.struct(v.alias("v"), F.col("rank"))
    agg = points.groupBy(*keys).agg(
        F.max_by(row, F.struct(F.col("accuracy"), (-F.col("rank")).alias("rank"))).alias("accuracy"),
        F.min_by(row, first(F.abs(F.col("fp_share") - fp_share))).alias("fp"),
        F.min_by(row, first(F.abs(F.col("recall_high") - recall_high))).alias("recall"),
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("point"), F.col(k).alias("r")) for k in ("accuracy", "fp", "recall")])
    return agg.select(*keys, F.inline(kinds)).select(*keys, "point", "r.*")


def sweep_sides(truths: DataFrame, dets: DataFrame) -> DataFrame:
    """The rows of `sweep_flags`: truths (image_id, gt, x1..y2) and detections in one table."""
    a = truths.select("image_id", F.lit(True).alias("is_gt"), F.col("gt").alias("id"), *XYXY, F.lit(0.0).alias("score"), F.lit(-1).alias("label"))
    return a.unionByName(dets.select("image_id", F.lit(False).alias("is_gt"), F.col("det").alias("id"), *XYXY, "score", F.col("label").cast("int").alias("label")))


def sweep_flags(sides: DataFrame, ious: list[float], score: float = 0.1, min_iou: float = 0.1, limit: float = MATCH_LIMIT, ring_iou: float = RING_IOU) -> DataFrame:
    """A row per detection that stays at some threshold, in images with truths: image_id, det, score, flags; rows without flags count truths (n_gt).

    Bit k of flags: it stays at the k-th threshold, bit len(ious) + k: it is matched there. An image is suppressed, paired and matched in one visit; only
    where a threshold keeps other pairs than the one before is an image matched again.
    """
    n = len(ious)

    def run(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        image = np.zeros(len(g["image_id"]), np.int64)
        image[begins(g["image_id"])[1:]] = 1
        image = np.cumsum(image)
        box = np.stack([g[c] for c in XYXY], 1)
        t, d = np.flatnonzero(g["is_gt"]), np.flatnonzero(~g["is_gt"])
        first = begins(image[d], g["label"][d]) if len(d) else d
        limits = np.where((g["label"][d[first]] == 1)[:, None], ring_iou, np.array(ious, float)[None])
        stay = nms_groups(box[d], first, limits)
        good = stay.any(1) & (g["score"][d] > score) & np.isin(image[d], image[t])
        d, stay = d[good], stay[good]
        i, j = overlapping(box[t], box[d], image[t], image[d], CELL, FEW)
        p, q = box[t[i]].T, box[d[j]].T
        both = np.maximum(np.minimum(p[2], q[2]) - np.maximum(p[0], q[0]), 0) * np.maximum(np.minimum(p[3], q[3]) - np.maximum(p[1], q[1]), 0)
        union = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - both
        shared = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
        cost = np.abs((p[0] + p[2] - q[0] - q[2]) / 2)
        e = np.flatnonzero((shared > min_iou) & (cost < NO_MATCH))
        i, j, shared, cost = i[e], j[e], shared[e], cost[e]
        a, b = _numbers(image[t], g["id"][t])[i], _numbers(image[d], g["id"][d])[j]
        hits = np.zeros(stay.shape, bool)
        for k in range(n):
            anew = np.ones(len(box), bool)  # by number of the image
            if k:
                anew[:] = False
                anew[image[d[j]][stay[j, k] != stay[j, k - 1]]] = True
                same = ~anew[image[d]]
                hits[same, k] = hits[same, k - 1]
            e = np.flatnonzero(stay[j, k] & anew[image[d[j]]])
            e = e[best_matching(a[e], b[e], cost[e], shared[e])]
            hits[j[e[cost[e] < limit]], k] = True
        bits = 1 << np.arange(n, dtype=np.int64)
        out = {"image_id": g["image_id"][d], "det": g["id"][d], "score": g["score"][d], "flags": stay @ bits + (hits @ bits << n), "n_gt": np.zeros(len(d), np.int64)}
        return {c: np.append(v, np.array([len(t) if c == "n_gt" else 0], v.dtype)) for c, v in out.items()}

    order = [F.asc("is_gt"), F.asc("label"), F.desc("score"), F.asc("id")]
    return groups(sides.where("image_id IS NOT NULL"), ["image_id"], order, run, "image_id long, det long, score double, flags long, n_gt long", many=True, together=True)


#: Detections of a row of `in_order`.
CHUNK = 8_192


def in_order(rows: DataFrame, n: int) -> DataFrame:
    """The flags of detections (image_id, det, score, flags of n thresholds) by falling score, in stored chunks: _slice (rising along the order), flags (packed
    whole numbers), and tp and fp, counts per threshold. What a curve needs of a detection is two bits per threshold, so it is sorted once and not carried on."""
    kind = np.min_scalar_type((1 << 2 * n) - 1).str

    def run(batches):
        held, at, base = [], 0, None

        def row(flags: np.ndarray) -> tuple:
            stay, hit = ((flags[:, None] >> np.arange(x, x + n) & 1).astype(bool) for x in (0, n))
            return (base << 32) + at, flags.astype(kind).tobytes(), hit.sum(0).tolist(), (stay & ~hit).sum(0).tolist()

        for pdf in batches:
            if not len(pdf):
                continue
            base = int(pdf["_slice"].iat[0])
            held.append(pdf["flags"].to_numpy())
            if sum(map(len, held)) >= CHUNK:
                flags, out = np.concatenate(held), []
                for x in range(0, len(flags) - CHUNK + 1, CHUNK):
                    out.append(row(flags[x : x + CHUNK]))
                    at += 1
                held = [flags[len(flags) // CHUNK * CHUNK :]]
                yield pd.DataFrame(out, columns=["_slice", "flags", "tp", "fp"])
        if sum(map(len, held)):
            yield pd.DataFrame([row(np.concatenate(held))], columns=["_slice", "flags", "tp", "fp"])

    order = [F.desc("score"), F.asc("image_id"), F.asc("det")]
    parts = parts_for(rows)
    dealt = rows.repartitionByRange(*([parts] if parts else []), *order).withColumn("_slice", F.spark_partition_id()).sortWithinPartitions(*order)
    return stored(dealt.select("_slice", "flags").mapInPandas(run, "_slice long, flags binary, tp array<long>, fp array<long>"), "sweep-order")


def suppression_sweep(truths: DataFrame, dets: DataFrame, ious: list[float], score: float = 0.1) -> DataFrame:
    """Per segment threshold the average precision, and recall and false-positive share at the best accuracy."""
    return sweep_curves(sweep_flags(sweep_sides(truths, dets), ious, score), ious)


def sweep_curves(flags: DataFrame, ious: list[float]) -> DataFrame:
    """`suppression_sweep` of `sweep_flags`. All thresholds share the order of the detections, so no row is made per threshold. Chunks are put after each other
    by their counts, a row of them per CHUNK detections."""
    n = len(ious)
    kind = np.min_scalar_type((1 << 2 * n) - 1).str
    flags = stored(flags, "sweep-flags")
    n_gt = flags.agg(F.sum("n_gt").alias("n_gt"))
    chunks = in_order(flags.where("flags <> 0").drop("n_gt"), n)
    each = lambda c: {f"{c}{k}": F.sum(F.get(c, F.lit(k))) for k in range(n)}
    gather = lambda c: F.array(*[f"{c}{k}" for k in range(n)]).alias(f"{c}_before")
    placed = chunks.join(F.broadcast(before(chunks, [], each("tp") | each("fp")).select("_slice", gather("tp"), gather("fp"))), "_slice")

    def of(r, k: int) -> np.ndarray:
        """Whether the detections of a chunk that stay at threshold k are matched."""
        own = np.frombuffer(r.flags, kind).astype(np.int64)
        return (own[own >> k & 1 == 1] >> n + k & 1).astype(np.int64)

    def highest(batches):
        for pdf in batches:
            rows = [(r._0, [max(running(of(r, k), r.tp_before[k], r.fp_before[k])[2], default=0.0) for k in range(n)]) for r in pdf.rename(columns={"_slice": "_0"}).itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["_slice", "best"])

    def areas(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                for k in range(n):
                    hit = of(r, k)
                    if not len(hit):
                        continue
                    tp, fp = int(r.tp_before[k]), int(r.fp_before[k])
                    found, rank, top = running(hit, tp, fp)
                    top = np.maximum(top, r.later[k])
                    earlier = max(tp / (tp + fp), top[0]) if tp + fp else top[0]
                    accuracy = found / (r.n_gt + rank - found)
                    x = int(accuracy.argmax())
                    rows.append((k, float((hit * (top + np.append(earlier, top[:-1]))).sum() / 2 / r.n_gt), accuracy[x], int(rank[x]), found[x] / r.n_gt, (rank[x] - found[x]) / r.n_gt))
            yield pd.DataFrame(rows, columns=["k", "area", "accuracy", "rank", "recall", "fp_share"])

    after = Window.orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    peaks = placed.select("_slice", "flags", "tp_before", "fp_before").mapInPandas(highest, "_slice long, best array<double>")
    later = peaks.select("_slice", F.array(*[F.coalesce(F.max(F.get("best", F.lit(k))).over(after), F.lit(0.0)) for k in range(n)]).alias("later"))
    ready = placed.select("_slice", "flags", "tp_before", "fp_before").join(F.broadcast(later), "_slice").crossJoin(F.broadcast(n_gt))  # one row
    found = ready.mapInPandas(areas, "k int, area double, accuracy double, rank long, recall double, fp_share double").groupBy("k")
    found = found.agg(F.sum("area").alias("ap_total"), F.max_by(F.struct("recall", "fp_share"), F.struct("accuracy", -F.col("rank"))).alias("best"))
    every = n_gt.where("n_gt > 0").select(F.posexplode(F.array(*[F.lit(float(t)) for t in ious])).alias("k", "segment_iou"))
    return every.join(found, "k", "left").select("segment_iou", F.coalesce("ap_total", F.lit(0.0)).alias("ap_total"), "best.recall", "best.fp_share")


def verdict(aps: DataFrame, ensemble: str, margin: float = 1e-4, model: str = "model", ap: str = "ap_total", keys=("dataset",)) -> DataFrame:
    """Best single model, the ensemble's lead, WIN, tie or no gain."""
    a = aps.groupBy(*keys).agg(F.max(F.when(F.col(model) != ensemble, F.col(ap))).alias("best_single"), F.max(F.when(F.col(model) == ensemble, F.col(ap))).alias("ensemble"))
    delta = F.col("ensemble") - F.col("best_single")
    return a.withColumns({"delta": delta, "verdict": F.when(delta > margin, "WIN").when(delta >= -margin, "tie").otherwise("no gain")})


# ---- E11-E21: diagnostics ----------------------------------------------------------------------------------------------------


def recall_strata(matches: DataFrame) -> DataFrame:
    """Recall by level, by label, by third of q and in all: one pass with grouping sets."""
    third = F.when(F.col("xc") < 341, 0).when(F.col("xc") < 682, 1).otherwise(2)
    gt = matches.where("kind <> 'fp'").select("level", "label", third.alias("q_third"), (F.col("kind") == "tp").alias("hit"))
    g = gt.groupingSets([[F.col("level")], [F.col("label")], [F.col("q_third")], []], "level", "label", "q_third")
    out = g.agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_found"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "level").when(F.col("g") == 5, "label").when(F.col("g") == 6, "q_third").otherwise("all")
    return out.select(name.alias("stratum"), F.coalesce("level", "label", "q_third", F.lit(-1)).cast("long").alias("value"), "n", "n_found", (F.col("n_found") / F.col("n")).alias("recall"))


def false_positive_profile(matches: DataFrame) -> DataFrame:
    """E12."""
    n = matches.select("image_id").distinct().agg(F.count(F.lit(1)).alias("n_images"))
    false = stored(matches.where("kind = 'fp'").select("score", "label"), "false-positives")
    fp = false.agg(F.count(F.lit(1)).alias("n_fp"), F.avg("score").alias("mean"), F.avg((F.col("score") > 0.5).cast("double")).alias("share_sure"), F.avg((F.col("label") == 1).cast("double")).alias("share_ring"))
    parts = percentiles(false, [], "score", {"p50": 0.5, "p90": 0.9})
    return fp.crossJoin(F.broadcast(parts)).crossJoin(F.broadcast(n)).withColumn("per_image", F.col("n_fp") / F.col("n_images"))  # one row each


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, keys: list[str] | None = None, clip: bool = False) -> DataFrame:
    """Counts per bin; the last bin holds its right edge, values outside are left out or, if clip, counted at the rim."""
    v = F.greatest(F.lit(low), F.least(F.lit(high), F.col(value))) if clip else F.col(value)
    b = F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1))
    return rows.where(F.col(value).isNotNull() & (v >= low) & (v <= high)).groupBy(*(keys or []), b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def intensity_rank(profile: DataFrame, keys: list[str], column: str, value: str) -> DataFrame:
    """Rank of each column's mean intensity among the columns of its image, from 0, over the number of columns."""
    by = Window.partitionBy(*keys)
    return profile.withColumn("pct", (F.row_number().over(by.orderBy(value, column)) - 1) / F.count(F.lit(1)).over(by))


def nearest_truth(dets: DataFrame, truths: DataFrame, keys: list[str] = ["image_id"]) -> DataFrame:  # noqa: B006
    """Distance along q to the nearest ground truth of the image, infinite without one.

    Both sides are merged in q order; the last truth before and the first after each detection are running values, so an
    image with many boxes makes no pairs.
    """
    a = dets.select(*keys, "det", F.col("xc"), F.lit(None).cast("double").alias("_q"))
    b = truths.select(*keys, F.lit(None).cast("long").alias("det"), F.col("xc"), F.col("xc").alias("_q"))
    w = Window.partitionBy(*keys).orderBy("xc")
    u = a.unionByName(b).withColumns({"_lo": F.last("_q", True).over(w.rangeBetween(Window.unboundedPreceding, 0)), "_hi": F.first("_q", True).over(w.rangeBetween(0, Window.unboundedFollowing))})
    gap = F.least(F.col("xc") - F.col("_lo"), F.col("_hi") - F.col("xc"))
    return u.where("det IS NOT NULL").select(*keys, "det", F.coalesce(gap, F.lit(float("inf"))).alias("distance"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of 0/1 vectors."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    return rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))


def overlays(matches: DataFrame, images: int = 4) -> DataFrame:
    """The boxes of each kind for the first images; only those images' rows are collected per image."""
    first = matches.select("image_id").distinct().orderBy("image_id").limit(images)
    chosen = matches.join(F.broadcast(first), "image_id")
    return chosen.groupBy("image_id", "kind").agg(F.array_sort(F.collect_list(F.struct("det", "score"))).alias("boxes"))


def top_k_accuracy(scored: DataFrame, ks: list[int], scores: str = "scores", target: str = "target") -> DataFrame:
    """K and the percentage of rows whose target is among the k best classes; equal scores go to the lower class, no rows give 0.

    A row has the scores of all its classes, so its target's place is counted inside the row: nothing is sorted or shuffled.
    """
    s, t = F.col(scores), F.col(target)
    own = F.get(s, t)
    better = F.filter(s, lambda x, i: (x > own) | (x.isNotNull() & own.isNull()) | (x.eqNullSafe(own) & (i < t)))  # null is the least score
    place = scored.where(F.size(s) > 0).select(F.when((t >= 0) & (t < F.size(s)), F.size(better)).alias("_place"))
    hit = lambda k: F.coalesce(F.col("_place") < k, F.lit(False)).cast("double")
    a = place.agg(*[F.coalesce(100 * F.avg(hit(k)), F.lit(0.0)).alias(f"_{k}") for k in ks])
    return a.select(F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"_{k}").alias("accuracy")) for k in ks])))


def count_error(dets: DataFrame, truths: DataFrame, keys: list[str] = ["image_id"]) -> DataFrame:  # noqa: B006
    """Mean absolute difference of counts per image."""
    a, b = dets.groupBy(*keys).agg(F.count(F.lit(1)).alias("a")), truths.groupBy(*keys).agg(F.count(F.lit(1)).alias("b"))
    j = a.join(b, keys, "full")
    return j.agg(F.count(F.lit(1)).alias("n_images"), F.avg(F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)))).alias("error"))


def side_by_side(truths: DataFrame, dets: DataFrame) -> DataFrame:
    """Truth and prediction rows of an image in one table."""
    cols = ["image_id", *XYXY, "label"]
    return truths.select(F.lit("gt").alias("side"), *cols, F.lit(1.0).alias("score")).unionByName(dets.select(F.lit("pred").alias("side"), *cols, "score"))


def vector_statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Extremes, mean, sample variance and deviation, and the sum of p ln(p + 1e-9) over the softmax of each vector."""
    stats = rows.groupBy(*keys).agg(F.max(value).alias("largest"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("deviation"))
    e = rows.join(stats.select(*keys, F.col("largest").alias("_top")), keys).withColumn("_e", F.exp(F.col(value) - F.col("_top")))
    z = e.groupBy(*keys).agg(F.sum("_e").alias("_z"))
    p = F.col("_e") / F.col("_z")
    entropy = e.join(z, keys).groupBy(*keys).agg(F.sum(p * F.log(p + 1e-9)).alias("entropy"))
    return stats.join(entropy, keys)


