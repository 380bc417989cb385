"""Curation queries on the frames view, each with its SQL."""

from __future__ import annotations

from ..operators import curation as C
from . import views as V
from pyspark.sql import functions as F
from pyspark.sql.window import Window

THRESHOLD, CAP, SMALL_CAP = 2, 40, 20

# decimation of a relation `src` (scan, frame_idx, ord, key, phash): one recursion step per frame of a scan
DECIMATE = """{out}_r AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY frame_idx, ord) AS rn FROM {src}),
{out}_w AS (SELECT scan, rn, key, ord, phash AS last, true AS kept FROM {out}_r WHERE rn = 1
  UNION ALL SELECT r.scan, r.rn, r.key, r.ord, CASE WHEN bit_count(xor(r.phash, w.last)) > {t} THEN r.phash ELSE w.last END,
    bit_count(xor(r.phash, w.last)) > {t} FROM {out}_w w JOIN {out}_r r ON r.scan = w.scan AND r.rn = w.rn + 1),
{out} AS (SELECT s.*, w.kept FROM {src} s JOIN {out}_w w ON s.key = w.key AND s.ord = w.ord)"""

DUPS = "dups AS (SELECT f.*, coalesce(ord > min(ord) OVER (PARTITION BY md5), false) AND md5 IS NOT NULL AS exact_dup FROM frames f)"
EXCLUDED = DUPS + """, excl AS (SELECT *, CASE WHEN exact_dup THEN 'exact_dup' WHEN blank THEN 'blank' WHEN contains(lower(scan), 'lab6') THEN 'calibrant_lab6' END AS excluded FROM dups),
pool AS (SELECT * FROM excl WHERE excluded IS NULL)"""


def _even(out: str, cap: int) -> str:
    """Even spacing and static trim of the pool."""
    return f"""{out}_n AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY frame_idx, ord) - 1 AS i, count(*) OVER (PARTITION BY scan) AS n FROM pool),
{out}_e AS (SELECT scan, frame_idx, ord, key, phash FROM {out}_n WHERE n <= {cap} OR list_contains(list_transform(range({cap}),
   lambda j: CASE WHEN j = {cap} - 1 THEN n - 1 ELSE floor(j * ((n - 1)::DOUBLE / {cap - 1}))::BIGINT END), i)),
{DECIMATE.format(out=out + "_d", src=out + "_e", t=1)},
{out} AS (SELECT * FROM {out}_d WHERE kept)"""


def _pool(spark, d):
    return C.pool(V.frames(spark, d))


def even(spark, d, cap):
    return C.capped(_pool(spark, d), cap)


def sweep(spark, d):
    s = C.decimation_sweep(V.frames(spark, d), [0, 1, 2, 4])
    return s.select(F.col("threshold").cast("long").alias("threshold"), "n_kept", "n_dropped", "n_scans", *[F.round(c, 6).alias(c) for c in ("median_dist", "share_2", "share_4", "p10_dist")])


def _sweep_sql() -> str:
    parts, rows = [], []
    for t in (0, 1, 2, 4):
        parts.append(DECIMATE.format(out=f"d{t}", src="frames", t=t))
        parts.append(f"g{t} AS (SELECT scan, bit_count(xor(phash, lag(phash) OVER (PARTITION BY scan ORDER BY frame_idx, ord)))::BIGINT AS x FROM d{t} WHERE kept)")
        rows.append(
            f"SELECT {t}::BIGINT AS threshold, (SELECT count(*) FROM g{t}) AS n_kept, (SELECT count(*) FROM frames) - (SELECT count(*) FROM g{t}) AS n_dropped, count(DISTINCT scan) AS n_scans, "
            f"round(quantile_cont(x, 0.5), 6) AS median_dist, round(avg((x <= 2)::INTEGER), 6) AS share_2, round(avg((x <= 4)::INTEGER), 6) AS share_4, round(quantile_cont(x, 0.1), 6) AS p10_dist FROM g{t}"
        )
    return f"WITH RECURSIVE {V.FRAMES}, " + ", ".join(parts) + " " + " UNION ALL ".join(rows)


def caps(spark, d):
    return C.scan_cap_counts(_pool(spark, d), [1, 2, 5, SMALL_CAP, CAP]).select(F.col("cap").cast("long").alias("cap"), "n_kept")


def _caps_sql() -> str:
    return f"WITH RECURSIVE {V.FRAMES}, {EXCLUDED}, " + ", ".join(_even(f"c{c}", c) for c in (2, 5, SMALL_CAP, CAP)) + (
        " SELECT 1::BIGINT AS cap, count(DISTINCT scan) AS n_kept FROM pool" + "".join(f" UNION ALL SELECT {c}, count(*) FROM c{c}" for c in (2, 5, SMALL_CAP, CAP))
    )


def bisection(spark, d):
    target = 2000
    pool = _pool(spark, d)
    cap, n = C.find_cap(pool, target)
    return C.capped(pool, cap).agg(F.lit(target).cast("long").alias("target"), F.lit(cap).cast("long").alias("cap"), F.count(F.lit(1)).alias("n_kept"))


def saturated(spark, d):
    pool = _pool(spark, d)
    return C.saturated_scans(pool, C.capped(pool, 2 * CAP))


def _both(spark, d):
    """What the smaller and the larger cap keep of one pool."""
    pool = _pool(spark, d)
    return C.capped(pool, SMALL_CAP), C.capped(pool, CAP)


def redundancy(spark, d):
    return C.redundancy(even(spark, d, CAP))


def sample(spark, d):
    return C.balanced_sample(V.frames(spark, d), 5000).withColumn("weight", F.round("weight", 6))


def last_wins(spark, d):
    f = V.frames(spark, d)
    parts = f.withColumn("key", F.concat(F.lit("k"), F.floor(F.col("ord") / 3)))
    profiles = f.select(F.concat(F.lit("k"), "ord").alias("key"))
    return C.with_fingerprints(profiles, parts).select("key", "md5", "blank", "phash")


def lookup(spark, d):
    """Key to shard, then shards with their frames."""
    f = V.frames(spark, d).withColumn("tar", F.concat(F.lit("shard"), F.col("ord") % 27))
    keep = C.manifest_c(V.frames(spark, d), THRESHOLD).where("keep").select("key")
    return keep.join(C.last_per_key(f, "key", ["tar", "scan"]), "key").groupBy("tar").agg(F.count(F.lit(1)).alias("n_frames"), F.count_distinct("scan").alias("n_scans"))


def train_only(spark, d):
    """Frames in and not in the keep list, by scan."""
    f = V.frames(spark, d)
    keep = C.manifest_c(f, THRESHOLD).where("keep").select("key")
    inside, outside = f.join(keep, "key", "left_semi"), f.join(keep, "key", "left_anti")
    return inside.select("scan", F.lit(True).alias("kept")).unionByName(outside.select("scan", F.lit(False).alias("kept"))).groupBy("scan", "kept").agg(F.count(F.lit(1)).alias("n"))


def corpus_order(spark, d):
    """Kept frames in the order of the corpus file, with their beamtime and place."""
    kept = C.manifest_b(V.frames(spark, d), CAP).where("keep")
    w = Window.partitionBy("scan").orderBy("frame_idx", "key")
    return kept.select("key", "scan", "frame_idx", F.split("scan", "/")[0].alias("beamtime"), F.row_number().over(w).cast("long").alias("place"))


_A = f"WITH RECURSIVE {V.FRAMES}, {DUPS}, {DECIMATE.format(out='dec', src='dups', t=4)}"
_REASON_A = "CASE WHEN NOT kept THEN 'within_scan_dup' WHEN exact_dup THEN 'exact_dup' WHEN blank THEN 'blank' WHEN contains(lower(scan), 'lab6') OR contains(lower(key), 'lab6') THEN 'calibrant_lab6' ELSE 'keep' END"
_B = f"WITH RECURSIVE {V.FRAMES}, {EXCLUDED}, {_even('even', CAP)}"
_B_SEL = "SELECT e.key, e.scan, e.frame_idx, coalesce(e.excluded, CASE WHEN k.key IS NOT NULL THEN 'keep' ELSE 'within_scan_subsampled' END) AS reason FROM excl e LEFT JOIN even k ON e.key = k.key AND e.ord = k.ord"
_C = f"WITH RECURSIVE {V.FRAMES}, {EXCLUDED}, {DECIMATE.format(out='dec', src='pool', t=THRESHOLD)}"
_C_SEL = f"SELECT e.key, e.scan, e.frame_idx, coalesce(e.excluded, CASE WHEN d.kept THEN 'keep' ELSE 'redundant_within_T{THRESHOLD}' END) AS reason FROM excl e LEFT JOIN dec d ON e.key = d.key AND e.ord = d.ord"
_BOTH = f"WITH RECURSIVE {V.FRAMES}, {EXCLUDED}, {_even('small', SMALL_CAP)}, {_even('large', CAP)}"

PLANS = {
    "j1_last_part_wins": (last_wins, f"""WITH {V.FRAMES}, p AS (SELECT 'k'||(ord // 3) AS key, max_by(md5, ord) AS md5, max_by(blank, ord) AS blank, max_by(phash, ord) AS phash FROM frames GROUP BY 1)
SELECT key, md5, coalesce(blank, false) AS blank, coalesce(phash, 0) AS phash FROM (SELECT 'k'||ord AS key FROM frames) LEFT JOIN p USING (key)"""),
    "j2_shard_lookup": (lookup, f"{_C}, m AS ({_C_SEL}) SELECT 'shard'||(f.ord % 27) AS tar, count(*) AS n_frames, count(DISTINCT f.scan) AS n_scans FROM m JOIN frames f USING (key) WHERE reason = 'keep' GROUP BY 1"),
    "j15_train_only": (train_only, f"{_C}, m AS ({_C_SEL}) SELECT scan, reason = 'keep' AS kept, count(*) AS n FROM m GROUP BY ALL"),
    "d1_exact_duplicates": (lambda s, d: C.flag_exact_duplicates(V.frames(s, d)).select("key", "md5", "exact_dup"), f"WITH {V.FRAMES}, {DUPS} SELECT key, md5, exact_dup FROM dups"),
    "d2_last_kept": (lambda s, d: C.flag_decimated(V.frames(s, d), 4).select("key", "scan", "kept"), f"WITH RECURSIVE {V.FRAMES}, {DECIMATE.format(out='dec', src='frames', t=4)} SELECT key, scan, kept FROM dec"),
    "d3_threshold_sweep": (sweep, _sweep_sql()),
    "d4_even_spacing": (lambda s, d: even(s, d, CAP).select("key", "scan", "frame_idx"), f"{_B} SELECT key, scan, frame_idx FROM even"),
    "d4_cap_counts": (caps, _caps_sql()),
    "d5_cap_bisection": (bisection, None),
    "d6_manifest_a": (lambda s, d: C.manifest_a(V.frames(s, d)), f"{_A}, m AS (SELECT key, scan, frame_idx, {_REASON_A} AS reason FROM dec) SELECT key, scan, frame_idx, reason = 'keep' AS keep, reason FROM m"),
    "d7_manifest_b": (lambda s, d: C.manifest_b(V.frames(s, d), CAP), f"{_B}, m AS ({_B_SEL}) SELECT key, scan, frame_idx, reason = 'keep' AS keep, reason FROM m"),
    "d8_manifest_c": (lambda s, d: C.manifest_c(V.frames(s, d), THRESHOLD), f"{_C}, m AS ({_C_SEL}) SELECT key, scan, frame_idx, reason = 'keep' AS keep, reason FROM m"),
    "d9_manifest_counts": (lambda s, d: C.manifest_counts(V.frames(s, d)), f"""{_A}, m AS (SELECT kept AS a, kept AND NOT exact_dup AS b, kept AND NOT exact_dup AND NOT blank AS c, {_REASON_A} = 'keep' AS e FROM dec)
SELECT count(*) AS n_total, count_if(a)::BIGINT AS n_kept, count_if(b)::BIGINT AS n_minus_dup, count_if(c)::BIGINT AS n_minus_blank, count_if(e)::BIGINT AS n_final, round(100.0::DOUBLE * count_if(e) / count(*), 6) AS pct FROM m"""),
    "d10_largest_scans": (lambda s, d: C.largest_scans(V.frames(s, d)), f"WITH {V.FRAMES} SELECT scan, count(*) AS n FROM frames GROUP BY 1 ORDER BY n DESC, scan LIMIT 10"),
    "d10_scan_sizes": (lambda s, d: C.scan_sizes(V.frames(s, d)), f"""WITH {V.FRAMES}, n AS (SELECT scan, count(*) AS n FROM frames GROUP BY 1)
SELECT CASE WHEN n < 2 THEN '1' WHEN n < 10 THEN '2-9' WHEN n < 50 THEN '10-49' WHEN n < 200 THEN '50-199' WHEN n < 1000 THEN '200-999' ELSE '1000+' END AS bucket,
count(*) AS n_scans, sum(n)::BIGINT AS n_frames, max(n) AS largest, quantile_cont(n, 0.5) AS median FROM n GROUP BY 1"""),
    "d11_big_scans": (lambda s, d: C.reductions(C.manifest_c(V.frames(s, d), THRESHOLD)), f"{_C}, m AS ({_C_SEL}) SELECT scan, count(*) AS n_raw, count_if(reason = 'keep')::BIGINT AS n_kept FROM m GROUP BY 1 ORDER BY n_raw DESC, scan LIMIT 12"),
    "d11_kept_per_scan": (lambda s, d: C.kept_per_scan(C.manifest_c(V.frames(s, d), THRESHOLD)), f"{_C}, m AS ({_C_SEL}), n AS (SELECT scan, count(*) AS n FROM m WHERE reason = 'keep' GROUP BY 1) SELECT count(*) AS n_scans, min(n) AS least, quantile_cont(n, 0.5) AS median, max(n) AS most FROM n"),
    "d12_redundancy": (redundancy, f"""{_B}, g AS (SELECT bit_count(xor(phash, lag(phash) OVER (PARTITION BY scan ORDER BY frame_idx, ord)))::BIGINT AS x FROM even)
SELECT coalesce(quantile_cont(x, 0.5), 99.0::DOUBLE) AS median, {', '.join(f'coalesce(round(avg((x <= {t})::INTEGER), 6), 0.0::DOUBLE) AS share_{t}' for t in (1, 2, 4, 8))}, coalesce(quantile_cont(x, 0.1), 99.0::DOUBLE) AS p10 FROM g WHERE x IS NOT NULL"""),
    "d13_saturated": (saturated, f"WITH RECURSIVE {V.FRAMES}, {EXCLUDED}, {_even('even', 2 * CAP)} SELECT * FROM (SELECT scan, count(*) AS available FROM pool GROUP BY 1) JOIN (SELECT scan, count(*) AS n_kept FROM even GROUP BY 1) USING (scan) WHERE n_kept = available"),
    "d14_marginal_frames": (lambda s, d: C.marginal_frames(*_both(s, d)), f"""{_BOTH}, n AS (SELECT key, scan, frame_idx, ord, least(bit_count(xor(phash, lag(phash) OVER w))::BIGINT, bit_count(xor(phash, lead(phash) OVER w))::BIGINT) AS nearest FROM large WINDOW w AS (PARTITION BY scan ORDER BY frame_idx, ord))
SELECT key, scan, frame_idx, nearest FROM n WHERE (key, ord) NOT IN (SELECT key, ord FROM small)"""),
    "d14_growth": (lambda s, d: C.growth_per_scan(*_both(s, d)), f"{_BOTH} SELECT scan, count(*) AS gained FROM large WHERE (key, ord) NOT IN (SELECT key, ord FROM small) GROUP BY 1 ORDER BY gained DESC, scan LIMIT 12"),
    "d15_split": (lambda s, d: C.split(V.frames(s, d)).groupBy("scan", "is_val").agg(F.count(F.lit(1)).alias("n")), None),
    "d16_balanced_sample": (sample, f"""WITH {V.FRAMES}, sz AS (SELECT scan, count(*) AS n, row_number() OVER (ORDER BY scan) - 1 AS no FROM frames GROUP BY 1), fr AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY frame_idx, ord) - 1 AS fno FROM frames),
dr AS (SELECT i AS draw, floor(('0x'||substr(md5('0|'||i),1,7))::BIGINT / 268435456.0::DOUBLE * (SELECT count(*) FROM sz))::BIGINT AS no, ('0x'||substr(md5('1|'||i),1,7))::BIGINT / 268435456.0::DOUBLE AS p FROM range(5000) t(i))
SELECT draw, key, scan, frame_idx, round(1.0::DOUBLE / n, 6) AS weight FROM dr JOIN sz USING (no) JOIN fr USING (scan) WHERE fno = floor(p * n)::BIGINT"""),
    "d17_split_report": (lambda s, d: C.split_report(C.split(V.frames(s, d))), None),
    "s9_corpus_order": (corpus_order, f"{_B}, m AS ({_B_SEL}) SELECT key, scan, frame_idx, split_part(scan, '/', 1) AS beamtime, row_number() OVER (PARTITION BY scan ORDER BY frame_idx, key) AS place FROM m WHERE reason = 'keep'"),
}

_FOLD = "h AS (SELECT *, md5('0:'||scan) AS h FROM frames), v AS (SELECT *, " + "(((({0}) * 296 + {1}) % 1000 * 296 + {2}) % 1000 * 296 + {3}) % 1000".format(*[f"('0x'||substr(h,{i},8))::BIGINT" + (" % 1000" if i == 1 else "") for i in (1, 9, 17, 25)]) + " < 120 AS is_val FROM h)"
PLANS["d15_split"] = (PLANS["d15_split"][0], f"WITH {V.FRAMES}, {_FOLD} SELECT scan, is_val, count(*) AS n FROM v GROUP BY ALL")
PLANS["d17_split_report"] = (PLANS["d17_split_report"][0], f"WITH {V.FRAMES}, {_FOLD} SELECT count_if(NOT is_val)::BIGINT AS n_train, count_if(is_val)::BIGINT AS n_val, count(DISTINCT CASE WHEN is_val THEN scan END) AS n_val_scans FROM v")
