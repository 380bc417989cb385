"""Similarity search between evaluation frames and a corpus, and its calibration.

Both sides are dealt out: corpus rows to blocks, evaluation frames to groups, and a task compares a block with a group in bounded
memory (`in_cells`). Exact searches meet every block; the index (inverted.py) meets the rows of the probed cells only. Nothing is
collected, neither side is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import matrix
from ..functions.ordered import percentiles
from ..functions.pixels import shared_correlation
from ..functions.store import stored

#: Corpus rows of a block and evaluation frames of a group, about.
BLOCK, GROUP = 8192, 2048


def _units(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm < 1e-6, 1.0, norm)


def _masked_units(v: np.ndarray, least: int = 8) -> np.ndarray:
    """Rows z-scored over their values other than 0, of unit length; rows without spread are 0."""
    ok = v != 0
    n = np.maximum(ok.sum(1), 1)
    mean = v.sum(1) / n
    sd = np.sqrt((np.where(ok, v - mean[:, None], 0) ** 2).sum(1) / n)
    good = (ok.sum(1) >= least) & (sd >= 1e-9)
    return _units(np.where(ok & good[:, None], (v - mean[:, None]) / np.where(sd > 0, sd, 1)[:, None], 0))


def views_of(v: np.ndarray, grid: tuple[int, int] | None, masked: bool) -> list[np.ndarray]:
    """Unit vectors of the evaluation side: one, or the four flips of a grid."""
    v = _masked_units(v) if masked else _units(v)
    if not grid:
        return [v]
    g = v.reshape(-1, *grid)
    return [x.reshape(v.shape) for x in (g, g[:, ::-1], g[:, :, ::-1], g[:, ::-1, ::-1])]


def best_of(own_ids: np.ndarray, own: list[np.ndarray], names: np.ndarray, m: np.ndarray, k: int, floor: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each evaluation frame: its place, the row's place, the score. Ties by name, so results do not depend on blocks."""
    score = np.maximum.reduce([x @ m.T for x in own])
    score = np.maximum(score, 0) if floor else score
    score = np.where(own_ids[:, None] == names[None, :], -np.inf, score)
    near = score
    if score.shape[1] > 4 * k:  # what k others surpass clearly is out before the sort
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        near = np.where(score >= least[:, None] - 1e-8, score, -np.inf)
    i, j = np.nonzero(near > -np.inf)
    order = np.lexsort((names[j], -np.round(score[i, j], 9), i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k], score[i, j][rank < k]


def in_cells(evals: DataFrame, corpus: DataFrame, cells: list[str], k: int, key: str, vector: str, grid: tuple[int, int] | None, masked: bool) -> DataFrame:
    """eval_id, key, score: the k best rows of each evaluation frame in every cell that both sides have."""

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"eval_id": pa.array([], pa.int64()), key: pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, names = left[key].to_numpy(), right[key].to_numpy()
        m = matrix(right[vector], len(names))
        m = _masked_units(m) if masked else _units(m)
        out = []
        views = views_of(matrix(left[vector], len(ids)), grid, masked)
        for a in range(0, len(ids), 256):
            i, j, score = best_of(ids[a : a + 256], [x[a : a + 256] for x in views], names, m, k, bool(grid))
            out.append((ids[a + i], names[j], score))
        return pa.table({n: np.concatenate(x) for n, x in zip(("eval_id", key, "score"), zip(*out))})

    return evals.groupBy(*cells).cogroup(corpus.groupBy(*cells)).applyInArrow(cell, f"eval_id long, {key} long, score double")


def ranked(found: DataFrame, k: int, key: str) -> DataFrame:
    w = Window.partitionBy("eval_id").orderBy(F.desc(F.round("score", 9)), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_matches(evals: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vector: str = "v", grid: tuple[int, int] | None = None, masked: bool = False) -> DataFrame:
    """The k best corpus rows, other than itself, of each evaluation row by cosine: eval_id, key, score, rank. Exact.

    grid: the best of the four flips of the evaluation grid counts, and a score is 0 at least. masked: vectors are z-scored over
    their support first.
    """
    blocks, groups = (max(1, -(-df.count() // n)) for df, n in ((corpus, BLOCK), (evals, GROUP)))
    number = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = corpus.select(F.col(key), F.col(vector), number(blocks).alias("block"), every(groups).alias("group"))
    asked = evals.select(F.col(key).alias(key), F.col(vector).alias(vector), number(groups).alias("group"), every(blocks).alias("block"))
    return ranked(in_cells(stored(asked, "asked"), rows, ["block", "group"], k, key, vector, grid, masked), k, key)


def rerank(matches: DataFrame, evals: DataFrame, corpus: DataFrame, key: str = "vec_id", vector: str = "v") -> DataFrame:
    """The candidates with their correlation over the shared support."""
    j = matches.join(evals.select(F.col(key).alias("eval_id"), F.col(vector).alias("_e")), "eval_id").join(corpus.select(key, F.col(vector).alias("_c")), key)
    return j.withColumn("corr", shared_correlation(F.col("_e"), F.col("_c"))).drop("_e", "_c")


def _no_data(v: Column) -> Column:
    return ~F.exists(v, lambda x: x != 0)


def profile_leaks(evals: DataFrame, corpus: DataFrame, k: int = 10, keep: int = 3, key: str = "vec_id", vector: str = "v", matches: DataFrame | None = None) -> DataFrame:
    """Best and `keep` best correlations per evaluation frame; a frame without data gives 0, no match and -1. matches: those of an index."""
    matches = top_matches(evals, corpus, k, key, vector, masked=True) if matches is None else matches
    found = rerank(matches, evals, corpus, key, vector)
    best = found.groupBy("eval_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("corr", (-F.col(key)).alias("_k"))), False), 1, keep).alias("top"))
    all_ = evals.select(F.col(key).alias("eval_id"), _no_data(F.col(vector)).alias("_none"))
    first = F.get("top", F.lit(0))
    return all_.join(best, "eval_id", "left").select(
        "eval_id",
        F.when(F.col("_none"), 0.0).otherwise(first["corr"]).alias("corr"),
        F.when(F.col("_none"), -1).otherwise(-first["_k"]).cast("long").alias(key),
        F.when(F.col("_none"), F.array().cast("array<long>")).otherwise(F.transform("top", lambda x: -x["_k"])).alias("best"),
    )


def combined_score(corr_q: Column, corr_chi: Column, corr_chi_reversed: Column) -> Column:
    """Both profiles must agree; the angle may run either way."""
    return F.least(corr_q, F.greatest(corr_chi, corr_chi_reversed))


def combined_leaks(evals: DataFrame, corpus: DataFrame, k: int = 12, flag: float = 0.95, key: str = "vec_id", q: str = "v", chi: str = "chi", matches: DataFrame | None = None) -> DataFrame:
    """eval_id, best match, score, leak flag. matches: those of an index."""
    m = top_matches(evals, corpus, k, key, q, masked=True) if matches is None else matches
    j = m.join(evals.select(F.col(key).alias("eval_id"), F.col(q).alias("_eq"), F.col(chi).alias("_ec")), "eval_id").join(corpus.select(key, F.col(q).alias("_cq"), F.col(chi).alias("_cc")), key)
    score = combined_score(shared_correlation(F.col("_eq"), F.col("_cq")), shared_correlation(F.col("_ec"), F.col("_cc"), 4), shared_correlation(F.reverse("_ec"), F.col("_cc"), 4))
    best = j.withColumn("score", score).groupBy("eval_id").agg(F.max_by(F.struct(F.col(key), F.col("score")), F.struct(F.round("score", 9), -F.col(key))).alias("_r"))
    return best.select("eval_id", F.col(f"_r.{key}").alias(key), F.col("_r.score").alias("score"), (F.col("_r.score") >= flag).alias("leak"))


def confirmation_list(evals: DataFrame, corpus: DataFrame, k: int = 12, top: int = 4, limit: int = 22, same: float = 0.985, key: str = "vec_id", vector: str = "v", matches: DataFrame | None = None) -> DataFrame:
    """For the evaluation frames with the best correlations, their `top` candidates and whether each is the same frame. matches: those of an index."""
    matches = top_matches(evals, corpus, k, key, vector, masked=True) if matches is None else matches
    r = rerank(matches, evals, corpus, key, vector).withColumn("corr", F.round("corr", 9))
    w = Window.partitionBy("eval_id").orderBy(F.desc("corr"), key)
    r = r.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    chosen = r.groupBy("eval_id").agg(F.max("corr").alias("best")).orderBy(F.desc("best"), "eval_id").limit(limit)
    return r.join(chosen, "eval_id").select("eval_id", key, "place", "corr", (F.col("corr") >= same).alias("same_frame_level"))


def material_baseline(frames: DataFrame, materials: list[str], scans: int = 10, vector: str = "v", scan: str = "scan") -> DataFrame:
    """Correlations between the first frames of up to `scans` scans of a material (a part of the scan's name)."""
    name = F.lower(F.col(scan).cast("string"))
    of = F.filter(F.array(*[F.lit(m) for m in materials]), lambda m: name.contains(F.lower(m)))  # one pass, a row per material of a scan
    first = frames.withColumn("material", F.explode(of)).groupBy("material", scan).agg(F.min("frame_idx").alias("frame_idx"), F.min_by(vector, "frame_idx").alias("_v"))
    place = F.row_number().over(Window.partitionBy("material").orderBy("frame_idx", scan))
    out = stored(first.withColumn("_p", place).where(F.col("_p") <= scans).drop("_p"), "material-frames")
    a = out.select("material", F.col("frame_idx").alias("_a"), F.col("_v").alias("_va"))
    b = out.select("material", F.col("frame_idx").alias("_b"), F.col("_v").alias("_vb"))
    p = a.join(b, "material").where("_a < _b").withColumn("corr", shared_correlation(F.col("_va"), F.col("_vb")))
    sizes = out.groupBy("material").agg(F.count(F.lit(1)).alias("n_scans"))
    stats = p.groupBy("material").agg(F.percentile("corr", 0.5).alias("median"), F.percentile("corr", 0.9).alias("p90"), F.max("corr").alias("most"))
    return sizes.join(stats, "material").where("n_scans >= 3")


def neighbours(frames: DataFrame, lag: int = 1, scan: str = "scan", vector: str = "v") -> DataFrame:
    """Correlation of each frame with the one `lag` places later in its scan."""
    w = Window.partitionBy(scan).orderBy("frame_idx")
    j = frames.select(scan, "frame_idx", vector, F.lead(vector, lag).over(w).alias("_n")).where("_n IS NOT NULL")
    return j.select(scan, "frame_idx", shared_correlation(F.col(vector), F.col("_n")).alias("corr"))


def contiguous_scans(frames: DataFrame, least: int, scan: str = "scan") -> DataFrame:
    """Scans without gaps and with enough frames."""
    g = frames.groupBy(scan).agg(F.count(F.lit(1)).alias("n"), (F.max("frame_idx") - F.min("frame_idx") + 1).alias("_span"))
    return g.where((F.col("n") >= least) & (F.col("n") == F.col("_span"))).select(scan, "n")


def adjacent_calibration(frames: DataFrame, least: int = 30, pairs: int = 30, controls: int = 30, seed: int = 0, scan: str = "scan", vector: str = "v") -> DataFrame:
    """Per contiguous scan the median and least correlation of its first `pairs` neighbours, and the median correlation of its first
    frame with `controls` frames drawn from all (those of the lowest digests of seed and frame)."""
    whole = frames.join(contiguous_scans(frames, least, scan).select(scan), scan, "left_semi")
    place = F.row_number().over(Window.partitionBy(scan).orderBy("frame_idx"))
    first = whole.withColumn("_i", place).where(F.col("_i") <= pairs + 1)
    near = neighbours(first, 1, scan, vector).groupBy(scan).agg(F.count(F.lit(1)).alias("n_pairs"), F.percentile("corr", 0.5).alias("median"), F.min("corr").alias("least"))
    digest = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col(scan).cast("string"), F.col("frame_idx").cast("string")))
    drawn = frames.orderBy(digest, scan, "frame_idx").limit(controls).select(F.col(vector).alias("_d"))  # a fixed number of rows
    other = first.where("_i = 1").join(F.broadcast(drawn)).select(scan, shared_correlation(F.col(vector), F.col("_d")).alias("corr"))
    return near.join(other.groupBy(scan).agg(F.percentile("corr", 0.5).alias("random_median")), scan)


def representations(a: DataFrame, b: DataFrame, key: str = "vec_id", vector: str = "v", robust: float = 0.7) -> DataFrame:
    """The same frames through two pipelines: least, median and largest correlation, and whether they agree."""
    j = a.select(key, F.col(vector).alias("_a")).join(b.select(key, F.col(vector).alias("_b")), key)
    c = j.select(shared_correlation(F.col("_a"), F.col("_b")).alias("c"))
    c = stored(c, "representations")
    s = c.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.max("c").alias("most"))
    return s.crossJoin(F.broadcast(percentiles(c, [], "c", {"median": 0.5}))).withColumn("robust", F.col("median") > robust)  # one row each


def raw_pairs(frames: DataFrame, limit: int = 20) -> DataFrame:
    """Raw and processed frames of a scan with one frame number (the first of each), needs key and is_raw."""
    first = frames.groupBy("scan", "frame_idx", "is_raw").agg(F.min_by("key", "ord").alias("key"), F.min("ord").alias("ord"))
    a, b = first.where("is_raw"), first.where("NOT is_raw")
    j = a.select("scan", "frame_idx", F.col("key").alias("raw_key"), F.col("ord").alias("_o")).join(b.select("scan", "frame_idx", "key"), ["scan", "frame_idx"])
    return j.orderBy("_o").limit(limit).select("scan", "frame_idx", "raw_key", "key")


# Fixed value: the two forms of a sample's name in the metadata.
TOKENS = (r"[a-z0-9][a-z0-9_]+?_\d{3,6}", r"([a-z0-9_]+?_\d{4,6})-\d+")


def provenance_tokens(metadata: DataFrame, text: str, least: int = 6) -> DataFrame:
    """Distinct lower-case tokens of the metadata that name a sample."""
    low = F.lower(text)
    found = F.concat(F.regexp_extract_all(low, F.lit(TOKENS[0]), F.lit(0)), F.regexp_extract_all(low, F.lit(TOKENS[1]), F.lit(1)))
    return metadata.select(F.explode(found).alias("token")).where(F.length("token") >= least).distinct()


def token_hits(tokens: DataFrame, scans: DataFrame, name: str = "name", least: int = 6) -> DataFrame:
    """Tokens that are part of a scan's name. A name that holds a token holds its last `least` characters, so names meet tokens by
    an equi-join on their parts of that length; then the whole token is looked for."""
    names = scans.select(F.lower(name).alias("name")).distinct()
    places = F.sequence(F.lit(1), F.length("name") - (least - 1))
    part_of_name = F.when(F.length("name") >= least, F.array_distinct(F.transform(places, lambda i: F.substring(F.col("name"), i, F.lit(least)))))
    parts = names.select("name", F.explode(part_of_name).alias("part"))
    ends = tokens.where(F.length("token") >= least).select("token", F.substring("token", -least, least).alias("part"))
    return parts.join(ends, "part").where(F.col("name").contains(F.col("token"))).select("token", "name")
