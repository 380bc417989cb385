"""Curation of frames: duplicates, decimation, caps, manifests and their reports.

Frames have key, scan, frame_idx, ord (first occurrence order), phash, md5, blank.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import dice
from ..functions.kernels import decimate
from ..functions.linked import cut, walk_runs
from ..functions.ordered import before, sliced
from ..functions.store import stored


def last_per_key(parts: DataFrame, key: str, columns: list[str], order: str = "ord") -> DataFrame:
    """One row per key, the last part wins (partial aggregation, no window)."""
    return parts.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(key, "_r.*")


def with_fingerprints(profiles: DataFrame, parts: DataFrame) -> DataFrame:
    """Profiles with md5, blank and phash; missing md5 is never a duplicate, missing blank is false, missing phash is 0."""
    right = last_per_key(parts, "key", ["md5", "blank", "phash"])
    return profiles.join(right, "key", "left").withColumns({"blank": F.coalesce("blank", F.lit(False)), "phash": F.coalesce("phash", F.lit(0))})


def flag_exact_duplicates(frames: DataFrame) -> DataFrame:
    """exact_dup is true for all but the first frame of a digest; a hot digest is pre-aggregated, null digests are not joined."""
    first = frames.where("md5 IS NOT NULL").groupBy("md5").agg(F.min("ord").alias("_first"))
    return frames.join(first, "md5", "left").withColumn("exact_dup", F.coalesce(F.col("ord") > F.col("_first"), F.lit(False))).drop("_first")


def is_calibrant(*columns: str) -> Column:
    """the calibrant's name occurs in one of the columns."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains("lab6"), F.lit(False))
    return out


def hamming(a: Column | str, b: Column | str) -> Column:
    """distance of 64-bit hashes kept as BIGINT."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


ORDER = ["frame_idx", "ord"]


#: Columns that are walked along with a frame; frames with others meet what was found by a join.
NARROW = ["key", "scan", "frame_idx", "ord", "phash"]
CARRIED = {*NARROW, "blank", "exact_dup", "excluded"}


def _runs(frames: DataFrame) -> tuple[DataFrame, bool]:
    """Narrow rows of the scans, cut into runs, and whether each scan is one run."""
    return cut(frames.select(NARROW), "scan", ORDER)


def _met(frames: DataFrame, found: Callable[[DataFrame], DataFrame], added: list[str]) -> DataFrame:
    """found(frames) with all columns of the frames: narrow frames go through it as they are, others meet its rows by key and ord."""
    if set(frames.columns) <= CARRIED:
        return found(frames).select(*frames.columns, *added)
    rows = found(frames.select(NARROW)).select("key", "ord", *added)
    return frames.join(rows, ["key", "ord"]).select(*frames.columns, *added)


def _walked(rows: DataFrame, whole: bool, threshold: int, name: str) -> DataFrame:
    """Rows of runs with the mark of D2; rows that `taken`, if there, leaves out are not marked and change nothing."""
    chosen = "taken" in rows.columns

    def kept(states, pdf):
        hashes = pdf["phash"].to_numpy()
        if not chosen:
            return decimate(hashes, threshold, states[0])
        at = np.flatnonzero(pdf["taken"].to_numpy(bool))
        keep = np.zeros(len(pdf), bool)
        keep[at], last = decimate(hashes[at], threshold, states[0])
        return keep, last

    columns = [c for c in rows.columns if c not in ("_slice", "_i", "_n", "taken")]

    def step(states, pdf):
        keep, last = kept(states, pdf)
        return [last], pdf[columns].assign(**{name: keep})

    schema = rows.select(*columns).withColumn(name, F.lit(True)).schema
    return walk_runs(rows, "scan", ORDER, lambda states, pdf: [kept(states, pdf)[1]], 1, step, schema, whole)


def flag_decimated(frames: DataFrame, threshold: int, name: str = "kept") -> DataFrame:
    """Greedy last-kept decimation of each scan by frame_idx; only narrow rows are moved, the state is one hash, and a scan of
    any size is walked by many tasks (linked.py)."""
    return _met(frames, lambda f: _walked(*cut(f, "scan", ORDER), threshold, name), [name])


def decimation_sweep(frames: DataFrame, thresholds: list[int]) -> DataFrame:
    """D3: per threshold the frames kept and dropped, and the Hamming distances of neighbours among the kept; one pass over the scans."""

    def advance(states, pdf):
        hashes = pdf["phash"].to_numpy()
        return [decimate(hashes, t, last)[1] for t, last in zip(thresholds, states)]

    def step(states, pdf):
        hashes, scan, cols, ends = pdf["phash"].to_numpy(), pdf["scan"].iat[0], [], []
        for t, before in zip(thresholds, states):
            keep, end = decimate(hashes, t, before)
            ends.append(end)
            kept = hashes[keep].tolist()
            dist = [float("nan")] if before is None else [((kept[0] ^ before) & 0xFFFFFFFFFFFFFFFF).bit_count()] if kept else []
            dist += [((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() for x, y in zip(kept, kept[1:])]
            dist = dist or [float("nan")]
            cols += [(t, scan, len(pdf) if k == 0 else 0, x, len(kept) if k == 0 else 0) for k, x in enumerate(dist)]
        return ends, pd.DataFrame(cols, columns=["threshold", "scan", "n", "dist", "n_kept"])

    rows, whole = _runs(frames)
    rows = walk_runs(rows, "scan", ORDER, advance, len(thresholds), step, "threshold int, scan string, n long, dist double, n_kept long", whole)
    d = F.when(~F.isnan("dist"), F.col("dist"))
    return rows.groupBy("threshold").agg(
        F.sum("n_kept").alias("n_kept"), (F.sum("n") - F.sum("n_kept")).alias("n_dropped"), F.count_distinct("scan").alias("n_scans"),
        F.percentile(d, 0.5).alias("median_dist"), F.avg((d <= 2).cast("double")).alias("share_2"), F.avg((d <= 4).cast("double")).alias("share_4"), F.percentile(d, 0.1).alias("p10_dist"),
    )


def _taken(cap: int) -> Column:
    """Whether D4 takes the frame at place _i of the _n of its scan."""
    cap = F.lit(cap)
    step = (F.col("_n") - 1).cast("double") / (cap - 1)
    near = F.floor(F.col("_i") / step)  # the position is one of floor(j * step): try the j around i / step
    taken = F.lit(False)
    for j in (near - 1, near, near + 1, near + 2):
        at = F.when(j == cap - 1, F.col("_n") - 1).otherwise(F.floor(j * step))
        taken = taken | ((j >= 0) & (j < cap) & (at == F.col("_i")))
    return F.when(F.col("_n") <= cap, True).when(cap == 1, F.col("_i") == 0).otherwise(taken)


def even_positions(frames: DataFrame, cap: int) -> DataFrame:
    """Frames of each scan at the positions floor(j * (n - 1) / (cap - 1)), the last one always; all if the scan has at most cap.
    Places are found on narrow rows, run by run."""
    return _met(frames, lambda f: cut(f, "scan", ORDER)[0].where(_taken(cap)), [])


def capped(frames: DataFrame, cap: int, static: int = 1) -> DataFrame:
    """Even spacing up to the cap, then static frames (distance to the last kept at most `static`) go."""
    return flag_capped(frames, cap, static).where("kept").drop("kept")


def flag_capped(frames: DataFrame, cap: int, static: int = 1) -> DataFrame:
    """The frames with `kept`, whether `capped` keeps them: one walk finds both the places and the static frames."""

    def found(f: DataFrame) -> DataFrame:
        rows, whole = cut(f, "scan", ORDER)
        return _walked(rows.withColumn("taken", F.coalesce(_taken(cap), F.lit(False))), whole, static, "kept")

    return _met(frames, found, ["kept"])


def scan_cap_counts(frames: DataFrame, caps: list[int], static: int = 1) -> DataFrame:
    """Frames kept per cap, for several caps in one pass over the scans (cap, n_kept)."""
    return _cap_counts(*_runs(frames), caps, static)


def _cap_counts(ranked: DataFrame, whole: bool, caps: list[int], static: int = 1) -> DataFrame:
    def each(states, pdf):
        n, hashes, at = int(pdf["_n"].iat[0]), pdf["phash"].to_numpy(), pdf["_i"].to_numpy()
        for cap, last in zip(caps, states):
            picks = np.linspace(0, n - 1, cap).astype(int) if cap > 1 else np.array([0])
            yield decimate(hashes if n <= cap else hashes[np.isin(at, picks)], static, last)

    def step(states, pdf):
        done = list(each(states, pdf))
        return [last for _, last in done], pd.DataFrame({"cap": caps, "n_kept": [int(keep.sum()) for keep, _ in done]})

    found = walk_runs(ranked, "scan", ORDER, lambda states, pdf: [last for _, last in each(states, pdf)], len(caps), step, "cap int, n_kept long", whole)
    return found.groupBy("cap").agg(F.sum("n_kept").alias("n_kept"))


def find_cap(frames: DataFrame, target: int, low: int = 1, high: int = 2000, steps: int = 18) -> tuple[int, int]:
    """The cap whose kept count is nearest to the target, by bisection; each round tries the caps of three rounds at once."""
    ranked, whole = _runs(frames)
    ranked = stored(ranked, "cap-frames")  # read in each round
    best, done, known = (None, None), 0, {}
    while done < steps and low <= high:
        tree, level = [], [(low, high)]
        for _ in range(3):
            nxt = []
            for a, b in level:
                if a <= b:
                    m = (a + b) // 2
                    tree.append(m)
                    nxt += [(a, m - 1), (m + 1, b)]
            level = nxt
        fresh = [c for c in dict.fromkeys(tree) if c not in known]
        known |= {r["cap"]: r["n_kept"] for r in _cap_counts(ranked, whole, fresh).collect()}
        for _ in range(3):
            if done >= steps or low > high:
                break
            cap = (low + high) // 2
            n = known.get(cap, 0)
            if best[0] is None or abs(n - target) < abs(best[1] - target):
                best = (cap, n)
            if n < target:
                low = cap + 1
            else:
                high = cap - 1
            done += 1
    return best


def manifest_a(frames: DataFrame, threshold: int = 4) -> DataFrame:
    """Decimate all frames first; within_scan_dup > exact_dup > blank > calibrant_lab6 > keep."""
    f = flag_decimated(flag_exact_duplicates(frames).select(*NARROW, "blank", "exact_dup"), threshold)
    reason = F.when(~F.col("kept"), "within_scan_dup").when(F.col("exact_dup"), "exact_dup").when(F.col("blank"), "blank").when(is_calibrant("scan", "key"), "calibrant_lab6").otherwise("keep")
    return f.select("key", "scan", "frame_idx", (reason == "keep").alias("keep"), reason.alias("reason"))


def excluded(frames: DataFrame) -> DataFrame:
    """Reason why a frame never enters the pool, or null: exact_dup > blank > calibrant_lab6."""
    f = flag_exact_duplicates(frames)
    return f.withColumn("excluded", F.when(F.col("exact_dup"), "exact_dup").when(F.col("blank"), "blank").when(is_calibrant("scan"), "calibrant_lab6"))


def pool(frames: DataFrame) -> DataFrame:
    """The frames that are not excluded, as a table of narrow rows."""
    return stored(excluded(frames).where("excluded IS NULL").select(NARROW), "pool")


def _manifest(frames: DataFrame, flagged: Callable[[DataFrame], DataFrame], other: str) -> DataFrame:
    """The reasons of all frames: duplicates are sought once, and what `flagged` says of the pool is put beside the rest, not joined to it."""
    f = stored(excluded(frames).select(*NARROW, "excluded"), "excluded")
    left = flagged(f.where("excluded IS NULL").select(NARROW)).select("key", "scan", "frame_idx", F.when(F.col("kept"), "keep").otherwise(other).alias("reason"))
    rows = left.unionByName(f.where("excluded IS NOT NULL").select("key", "scan", "frame_idx", F.col("excluded").alias("reason")))
    return rows.select("key", "scan", "frame_idx", (F.col("reason") == "keep").alias("keep"), "reason")


def manifest_b(frames: DataFrame, cap: int) -> DataFrame:
    """Exclude first, then even spacing up to the cap and the static trim."""
    return _manifest(frames, lambda f: flag_capped(f, cap), "within_scan_subsampled")


def manifest_c(frames: DataFrame, threshold: int) -> DataFrame:
    """Exclude first, then decimate what is left."""
    return _manifest(frames, lambda f: flag_decimated(f, threshold), f"redundant_within_T{threshold}")


def manifest_counts(frames: DataFrame, threshold: int = 4) -> DataFrame:
    """Frames left after each step of manifest A, in one aggregation."""
    f = flag_decimated(flag_exact_duplicates(frames).select(*NARROW, "blank", "exact_dup"), threshold)
    ok = F.col("kept")
    no_dup = ok & ~F.col("exact_dup")
    no_blank = no_dup & ~F.col("blank")
    final = no_blank & ~is_calibrant("scan", "key")
    return f.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(ok).alias("n_kept"), F.count_if(no_dup).alias("n_minus_dup"),
        F.count_if(no_blank).alias("n_minus_blank"), F.count_if(final).alias("n_final"), F.round(100.0 * F.count_if(final) / F.count(F.lit(1)), 6).alias("pct"),
    )


def scan_sizes(frames: DataFrame) -> DataFrame:
    """Scans and frames per size bucket, with the largest and the median size of all scans."""
    n = frames.groupBy("scan").agg(F.count(F.lit(1)).alias("n"))
    bucket = F.when(F.col("n") < 2, "1").when(F.col("n") < 10, "2-9").when(F.col("n") < 50, "10-49").when(F.col("n") < 200, "50-199").when(F.col("n") < 1000, "200-999").otherwise("1000+")
    return n.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_scans"), F.sum("n").alias("n_frames"), F.max("n").alias("largest"), F.percentile("n", 0.5).alias("median"))


def largest_scans(frames: DataFrame, top: int = 10) -> DataFrame:
    """The scans of most frames; of equal ones those that come first by name."""
    return frames.groupBy("scan").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "scan").limit(top)


def reductions(manifest: DataFrame, top: int = 12) -> DataFrame:
    """The largest scans with their frames and kept frames."""
    n = manifest.groupBy("scan").agg(F.count(F.lit(1)).alias("n_raw"), F.count_if("keep").alias("n_kept"))
    return n.orderBy(F.desc("n_raw"), "scan").limit(top)


def kept_per_scan(manifest: DataFrame) -> DataFrame:
    """Scans represented, and least, median and most kept frames of a scan."""
    n = manifest.where("keep").groupBy("scan").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("n_scans"), F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("most"))


def _gaps(kept: DataFrame) -> DataFrame:
    w = Window.partitionBy("scan").orderBy("frame_idx", "ord")
    return kept.withColumn("dist", hamming("phash", F.lag("phash").over(w)))


def redundancy(kept: DataFrame) -> DataFrame:
    """Hamming distance of each kept frame to the one before it in its scan: median, shares up to 1, 2, 4, 8, tenth percentile; 99 if there is none."""
    d = _gaps(kept).where("dist IS NOT NULL")
    share = lambda t: F.coalesce(F.round(F.avg((F.col("dist") <= t).cast("double")), 6), F.lit(0.0)).alias(f"share_{t}")
    return d.agg(F.coalesce(F.percentile("dist", 0.5), F.lit(99.0)).alias("median"), *[share(t) for t in (1, 2, 4, 8)], F.coalesce(F.percentile("dist", 0.1), F.lit(99.0)).alias("p10"))


def saturated_scans(pool: DataFrame, kept: DataFrame) -> DataFrame:
    """Scans of which every available frame is kept."""
    a = pool.groupBy("scan").agg(F.count(F.lit(1)).alias("available"))
    b = kept.groupBy("scan").agg(F.count(F.lit(1)).alias("n_kept"))
    return a.join(b, "scan").where("n_kept = available")


def marginal_frames(small: DataFrame, large: DataFrame) -> DataFrame:
    """Frames kept at the larger target only, with the distance to the nearest kept neighbour on either side."""
    w = Window.partitionBy("scan").orderBy("frame_idx", "ord")
    near = large.withColumn("nearest", F.least(hamming("phash", F.lag("phash").over(w)), hamming("phash", F.lead("phash").over(w))))
    return near.join(small.select("key", "ord"), ["key", "ord"], "left_anti").select("key", "scan", "frame_idx", "nearest")


def growth_per_scan(small: DataFrame, large: DataFrame, top: int = 12) -> DataFrame:
    """The scans that gain most frames from the smaller to the larger target."""
    return marginal_frames(small, large).groupBy("scan").agg(F.count(F.lit(1)).alias("gained")).orderBy(F.desc("gained"), "scan").limit(top)


def split_bucket(key: Column, modulus: int = 1000) -> Column:
    """md5 of the key as a number modulo `modulus`, folded over its four 8-digit parts."""
    digest, v, carry = F.md5(key), F.lit(0).cast("long"), (1 << 32) % modulus
    for i in (1, 9, 17, 25):
        v = (v * carry + F.conv(F.substring(digest, i, 8), 16, 10).cast("long")) % modulus
    return v


def split(frames: DataFrame, seed: int = 0, val_frac: float = 0.12) -> DataFrame:
    """Whole scans go to validation or training by a hash of seed and scan."""
    bucket = split_bucket(F.concat(F.lit(f"{seed}:"), F.col("scan")))
    return frames.withColumn("is_val", bucket < int(val_frac * 1000))


def split_report(parts: DataFrame) -> DataFrame:
    """D17."""
    return parts.agg(F.count_if(~F.col("is_val")).alias("n_train"), F.count_if("is_val").alias("n_val"), F.count_distinct(F.when(F.col("is_val"), F.col("scan"))).alias("n_val_scans"))


def balanced_sample(frames: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """N draws with replacement, each a uniform scan and then a uniform frame of it; draws are hashes of (seed, draw), so retries agree.

    Scans are numbered by a window over the distinct scans only; frames by ranges of their scan, so that a very long scan is not one task.
    """
    spark = frames.sparkSession
    rows = sliced(frames.select("key", "scan", "frame_idx", "ord"), ["scan"], [F.col("frame_idx"), F.col("ord")], "balanced")
    sizes = rows.groupBy("scan").agg(F.count(F.lit(1)).alias("n"))
    numbered = sizes.withColumn("scan_no", F.row_number().over(Window.orderBy("scan")) - 1)
    offsets = before(rows, ["scan"], {"_o": F.count(F.lit(1))})
    inside = F.row_number().over(Window.partitionBy("scan", "_slice").orderBy("frame_idx", "ord"))
    frame_no = rows.join(offsets, ["scan", "_slice"]).withColumn("frame_no", (inside + F.col("_o") - 1).cast("int")).drop("_slice", "_o")
    scans = sizes.count()
    draws = spark.range(n).select(F.col("id").alias("draw"), F.floor(dice(seed, "id") * max(scans, 1)).cast("int").alias("scan_no"))
    picked = draws.join(numbered, "scan_no").withColumn("frame_no", F.floor(dice(seed + 1, "draw") * F.col("n")).cast("int"))
    return picked.join(frame_no, ["scan", "frame_no"]).select("draw", "key", "scan", "frame_idx", (1.0 / F.col("n")).alias("weight"))
