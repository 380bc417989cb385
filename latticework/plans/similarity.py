"""Similarity and frame-array queries on the descriptors view, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixels as X
from ..operators import hashes as H
from ..operators import inverted as I
from ..operators import similarity as S
from . import views as V

R = lambda c: F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
UP = lambda c: F.round(c + 1e-9, 6)


def _split(s, d):
    v = V.descriptors(s, d)
    v = v.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < 0.02, 0.0).otherwise(x)))
    return v.where("is_eval"), v, v


def flip_search(s, d):
    e, c, _ = _split(s, d)
    return S.top_matches(e, c, 6, grid=(8, 8)).select("eval_id", "vec_id", UP(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


def _by_index(s, d, k, grid, masked):
    """The matches that the inverted file finds, with the exact ones."""
    e, c, _ = _split(s, d)
    index = I.build(c, masked=masked)
    found = I.top_matches(e, index, k, I.probes_needed(e, c, index, k, grid), grid)
    return e, c, found


def inverted_search(s, d):
    """J3 by the inverted file."""
    _, _, found = _by_index(s, d, 6, (8, 8), False)
    return found.select("eval_id", "vec_id", UP(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


def inverted_recall(s, d):
    """Matches of the exact searches, and whether the inverted file finds nine in ten of them."""
    out = None
    for name, k, grid, masked in (("flips", 6, (8, 8), False), ("profiles", 10, None, True)):
        e, c, found = _by_index(s, d, k, grid, masked)
        r = I.recall(found, S.top_matches(e, c, k, grid=grid, masked=masked)).select(F.lit(name).alias("search"), "n_true", (F.col("recall") >= 0.9).alias("enough"))
        out = r if out is None else out.unionByName(r)
    return out


def inverted_leaks(s, d):
    """J7 on the matches of the inverted file."""
    e, c, found = _by_index(s, d, 12, None, True)
    return S.combined_leaks(_chi(e), _chi(c), matches=found).select("eval_id", "vec_id", UP(F.col("score")).alias("score"), "leak")


def nearest_hash(s, d):
    e, c, _ = _split(s, d)
    return H.nearest(e, c)


def within(s, d):
    e, c, _ = _split(s, d)
    return H.within(e, c, 21)


def leaks(s, d):
    e, c, _ = _split(s, d)
    return S.profile_leaks(e, c).select("eval_id", UP(F.col("corr")).alias("corr"), "vec_id", F.array_join(F.transform("best", lambda x: x.cast("string")), ",").alias("best"))


def _chi(v):
    return v.withColumn("chi", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.aggregate(F.slice(F.col("v"), r * 8 + 1, 8), F.lit(0.0), lambda t, x: t + x)))


def combined(s, d):
    e, c, _ = _split(s, d)
    return S.combined_leaks(_chi(e), _chi(c)).select("eval_id", "vec_id", UP(F.col("score")).alias("score"), "leak")


def confirmation(s, d):
    e, c, _ = _split(s, d)
    return S.confirmation_list(e, c).select("eval_id", "vec_id", F.col("place").cast("long").alias("place"), UP(F.col("corr")).alias("corr"), "same_frame_level")


def candidates(s, d):
    """Matches of the evaluation frames whose best score is high enough, with their shard."""
    e, c, _ = _split(s, d)
    m = S.top_matches(e, c, 6, grid=(8, 8))
    good = m.where("rank = 1 AND score >= 0.35").select("eval_id")
    return m.join(good, "eval_id", "left_semi").groupBy((F.col("vec_id") % 27).alias("tar")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("eval_id").alias("n_evals"))


def baseline(s, d):
    _, _, v = _split(s, d)
    v = v.withColumns({"material": (F.col("vec_id") % 3), "scan": F.concat(F.lit("mat"), F.col("vec_id") % 3, F.lit("_s"), F.col("vec_id") % 30)})
    b = S.material_baseline(v, ["mat0", "mat1", "mat2"])
    return b.select("material", "n_scans", *[UP(F.col(c)).alias(c) for c in ("median", "p90", "most")])


def adjacent(s, d):
    _, _, v = _split(s, d)
    out = None
    for lag in (1, 30):
        n = S.neighbours(v, lag).select(F.lit(lag).cast("long").alias("lag"), "scan", "frame_idx", UP(F.col("corr")).alias("corr"))
        out = n if out is None else out.unionByName(n)
    return out


def contiguous(s, d):
    v = V.descriptors(s, d).withColumns({"scan": F.floor(F.col("vec_id") / 60), "frame_idx": F.col("vec_id") + F.floor(F.col("vec_id") / 97)})  # a gap after every 97 frames
    return S.contiguous_scans(v, 50)


def calibration(s, d):
    _, _, v = _split(s, d)
    v = v.withColumns({"scan": F.floor(F.col("vec_id") / 60), "frame_idx": F.col("vec_id") + F.floor(F.col("vec_id") / 97)})
    return S.adjacent_calibration(v).select("scan", "n_pairs", *[UP(F.col(c)).alias(c) for c in ("median", "least", "random_median")])


def representations(s, d):
    _, _, v = _split(s, d)
    half = v.withColumn("v", F.transform("v", lambda x, i: F.when(i % 9 == 0, 0.0).otherwise(x)))
    return S.representations(v, half).select("n", *[UP(F.col(c)).alias(c) for c in ("least", "median", "most")], "robust")


def raw_pairs(s, d):
    f = V.frames(s, d).withColumns({"frame_idx": F.floor(F.col("frame_idx") / 300), "is_raw": F.col("ord") % 3 == 0})
    return S.raw_pairs(f)


def provenance(s, d):
    docs = V.table(s, d, "documents").select(F.concat(F.lit("Run "), F.coalesce("source", F.lit("none")), F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("-12 x")).alias("meta"))
    pages = V.table(s, d, "pages").select(F.concat(F.lit("scan/Src"), F.col("page_id") % 20, F.lit("_"), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit("/a")).alias("name"))
    tokens = S.provenance_tokens(docs, "meta")
    hits = S.token_hits(tokens, pages)
    return tokens.join(hits.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def pixel_stats(s, d):
    """F2 on long pixels."""
    px = V.long_pixels(s, d)
    some = F.col("x") != 0
    n = F.count_if(some)
    dyn = F.max(F.when(some, F.col("x"))) - F.min(F.when(some, F.col("x")))
    a = px.groupBy("vec_id").agg((n / F.count(F.lit(1))).alias("frac_valid"), (F.count_if(F.col("x") >= 0.2) / F.greatest(n, F.lit(1))).alias("saturation"), F.avg(F.when(some, F.col("x"))).alias("mean"), dyn.alias("dyn"))
    return a.select("vec_id", R("frac_valid").alias("frac_valid"), R("saturation").alias("saturation"), UP(F.col("mean")).alias("mean"), R("dyn").alias("dyn"), ((F.col("frac_valid") < 0.02) | (F.col("dyn") < 0.4)).alias("blank"))


def rescaled(s, d):
    """F10 on long pixels: min-max, mean and deviation over the values other than 0."""
    px = V.long_pixels(s, d)
    v = F.when(F.col("x") != 0, F.col("x"))
    a = px.groupBy("vec_id").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("m"), F.stddev_pop(v).alias("sd"))
    j = px.join(a, "vec_id")
    zero = F.col("x") == 0
    return j.select("vec_id", "r", "c", F.when(zero, 0.0).otherwise(UP((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")))).alias("minmax"), F.when(zero, 0.0).otherwise(UP((F.col("x") - F.col("m") + F.col("sd") / 2) / F.col("sd"))).alias("meanstd"), F.when(zero, 0.0).otherwise(UP((F.col("x") - F.col("m")) / F.col("sd"))).alias("z"))


def profiles(s, d):
    """F14 on long pixels: mean log intensity per column and row."""
    px = V.long_pixels(s, d).withColumn("x", F.greatest(F.col("x"), F.lit(0.0)) * 100)
    mean = F.coalesce(F.sum(F.log1p("x")) / F.nullif(F.count_if(F.col("x") != 0), F.lit(0)), F.lit(0.0))
    a = px.groupBy("vec_id", F.col("c").alias("pos")).agg(mean.alias("v")).select("vec_id", F.lit("col").alias("kind"), "pos", UP(F.col("v")).alias("v"))
    b = px.groupBy("vec_id", F.col("r").alias("pos")).agg(mean.alias("v")).select("vec_id", F.lit("row").alias("kind"), "pos", UP(F.col("v")).alias("v"))
    return a.unionByName(b)


def radial(s, d):
    """F16, F17 on long pixels: means by |q| and by angle; values beyond the top land in the last bin."""
    px = V.long_pixels(s, d).where("x <> 0").withColumns({"qx": F.col("c") * 0.55 + 0.1, "qz": (7 - F.col("r")) * 0.9 + 0.05})
    v = F.log1p(F.greatest(F.col("x"), F.lit(0.0)))
    q = F.least(F.floor(F.sqrt(F.col("qx") * F.col("qx") + F.col("qz") * F.col("qz")) / 6 * 30), F.lit(29))
    chi = F.least(F.floor(F.degrees(F.atan2(F.abs("qz"), F.abs("qx") + 1e-9)) / 90 * 16), F.lit(15))
    a = px.groupBy("vec_id", q.cast("long").alias("bin")).agg(F.avg(v).alias("v")).select("vec_id", F.lit("q").alias("kind"), "bin", UP(F.col("v")).alias("v"))
    b = px.groupBy("vec_id", chi.cast("long").alias("bin")).agg(F.avg(v).alias("v")).select("vec_id", F.lit("chi").alias("kind"), "bin", UP(F.col("v")).alias("v"))
    return a.unionByName(b)


def arrays(s, d):
    """masked z-scores, unit vectors, flips and reach of each descriptor."""
    _, _, v = _split(s, d)
    z, u = X.masked_z(F.col("v")), X.unit(F.col("v"))
    _, mask = X.model_input(F.col("v"))
    flip = X.flips(F.col("v"), 8, 8)
    return v.select("vec_id", UP(F.get(z, F.lit(5))).alias("z5"), UP(F.aggregate(z, F.lit(0.0), lambda t, x: t + x * x)).alias("zz"), UP(F.get(u, F.lit(9))).alias("u9"), F.aggregate(mask, F.lit(0), lambda t, x: t + x).cast("long").alias("n_valid"), *[UP(F.get(f, F.lit(3))).alias(f"flip{k}") for k, f in enumerate(flip)], UP(X.q_reach(F.slice("v", 1, 8), F.slice("v", 9, 8))).alias("reach"))


def masks(s, d):
    m = X.mask_cells(V.frames(s, d), 64, 0.6, 1)
    return m.select("key", F.array_join(F.transform("masked", lambda c: c.cast("string")), ",").alias("masked"))


#: Paths of frames by kind, {u} the user's and {i} the event's number: source, member name.
PATHS = (
    ("beamtimes/bt1/raw/s{u}/x/pe/foo-{i}.tif", "m.png"),
    ("beamtimes/bt2/Converted/lab6_{u}/pe/sub/deep/foo-{i}.raw.tif", "m.png"),
    ("TENSOR/bt3/a/s{u}/frame_f{i}.pt", "m.png"),
    ("tensor/bt4/s{u}/frame_{i}.png", "m.png"),
    ("", "tensor/bt5/s{u}/x_f{i}.tif"),
    ("", "d/p__q{u}__name{i}.png"),
    ("elsewhere/{i}.dat", "d/p__q{u}__name{i}a.raw.png"),
    ("elsewhere/{i}.dat", "plain.png"),
    ("", "d/two__parts{i}.png"),
    ("beamtimes/bt1/other/s{u}/pe/foo-{i}.tif", "x/a__b.rawc__d__e{i}_.png"),
)


def paths(s, d):
    """scan and frame number from paths of several forms, and which scans are of a calibrant."""
    e = V.table(s, d, "events")
    filled = lambda x: F.replace(F.replace(F.lit(x), F.lit("{u}"), F.col("user_id").cast("string")), F.lit("{i}"), F.col("event_id").cast("string"))
    source, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (a, b) in enumerate(PATHS):
        here = F.col("event_id") % len(PATHS) == k
        source, key = F.when(here, filled(a)).otherwise(source), F.when(here, filled(b)).otherwise(key)
    scan, frame = X.parse_scan()
    rows = e.select("event_id", source.alias("source"), key.alias("key"))
    return rows.select("event_id", scan.alias("scan"), frame.alias("frame_idx"), F.lower(scan).contains("lab6").alias("calibrant"))


def axes(s, d):
    """Axis ranges given as text, and the first, second and last point of the axis."""
    b = V.boxes(s, d)
    text = F.when(F.col("det") == 1, F.concat(F.lit("(0, "), F.col("x2").cast("string"), F.lit(", -1.5, "), F.col("y2").cast("string"), F.lit(")"))).when(F.col("det") == 2, "(0.0, 0, 0, 0)").otherwise("none 1 2")
    p = X.parse_axis(text)
    a = X.axis_or_default(F.col("p"), 5)
    return b.select("image_id", "det", p.alias("p")).select("image_id", "det", F.get("p", F.lit(1)).alias("second"), F.get("p", F.lit(3)).alias("fourth"), UP(F.get(a, F.lit(1))).alias("point1"), UP(F.get(a, F.lit(4))).alias("point4"))


_SPLIT = V.DESCRIPTORS + """, vm AS (SELECT vec_id, scan, frame_idx, is_eval, phash, list_transform(v, lambda x: CASE WHEN abs(x) < 0.02 THEN 0.0::DOUBLE ELSE x END) AS v FROM descriptors)"""
_Z0 = """, z1{t} AS (SELECT *, list_filter({v}, lambda x: x <> 0) AS sm FROM {src}), z2{t} AS (SELECT *, len(sm) AS zn, list_sum(sm) / len(sm) AS zm FROM z1{t}),
z3{t} AS (SELECT *, sqrt(list_sum(list_transform(sm, lambda x: (x-zm)*(x-zm))) / zn) AS zs FROM z2{t}),
{out} AS (SELECT * EXCLUDE (sm, zn, zm, zs), CASE WHEN zn >= {least} AND zs >= 1e-9 THEN list_transform({v}, lambda x: CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE (x-zm)/zs END) END AS {z} FROM z3{t})"""


def _z(src, out, v="v", z="z", least=8, t=""):
    return _Z0.format(src=src, out=out, v=v, z=z, least=least, t=t)


def _corr(a, b, n=64, least=8):
    both = f"list_filter(range(1, {n + 1}), lambda i: {a}[i] <> 0 AND {b}[i] <> 0)"
    s = lambda x, y: f"list_sum(list_transform({both}, lambda i: {x}[i]*{y}[i]))"
    return f"coalesce(CASE WHEN len({both}) >= {least} THEN {s(a, b)} / nullif(sqrt({s(a, a)} * {s(b, b)}), 0) END, 0.0::DOUBLE)"


_COS = "list_dot_product(e.{0}, c.{0}) / (sqrt(list_dot_product(e.{0}, e.{0})) * sqrt(list_dot_product(c.{0}, c.{0})))"
_FLIP = {"a": "v[i]", "b": "v[(7 - (i-1)//8)*8 + (i-1)%8 + 1]", "c": "v[((i-1)//8)*8 + 7 - (i-1)%8 + 1]", "f": "v[65-i]"}
_FLIPS = ", fl AS (SELECT *, " + ", ".join(f"list_transform(range(1, 65), lambda i: {x}) AS v{k}" for k, x in _FLIP.items()) + " FROM vm)"
_TOPF = f"""WITH {_SPLIT}{_FLIPS}, sc AS (SELECT e.vec_id AS eval_id, c.vec_id, greatest(0, {', '.join(f'list_dot_product(e.v{k}, c.v)' for k in _FLIP)}) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
  FROM fl e, vm c WHERE e.is_eval AND c.vec_id <> e.vec_id), tf AS (SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM sc QUALIFY rank <= 6)"""
_COARSE = f"""WITH {_SPLIT}{_z('vm', 'zz')}, co AS (SELECT e.vec_id AS eval_id, c.vec_id, e.z AS ez, c.z AS cz, e.v AS ev, c.v AS cv, {_COS.format('z')} AS s FROM zz e, zz c WHERE e.is_eval AND c.vec_id <> e.vec_id),
ck AS (SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY round(s, 9) DESC, vec_id) AS rk FROM co)"""
_Q = "round({} + 1e-9::DOUBLE, 6)"

PLANS = {
    "j3_flip_search": (flip_search, f"{_TOPF} SELECT eval_id, vec_id, {_Q.format('score')} AS score, rank FROM tf"),
    "j3_inverted_search": (inverted_search, None),
    "j3_inverted_recall": (inverted_recall, f"{_TOPF}, {_COARSE.removeprefix('WITH ').removeprefix(_SPLIT).removeprefix(', ')} SELECT 'flips' AS search, count(*) AS n_true, true AS enough FROM tf UNION ALL SELECT 'profiles', count(*), true FROM ck WHERE rk <= 10"),
    "j7_inverted_leaks": (inverted_leaks, None),
    "j4_nearest_hash": (nearest_hash, f"WITH {V.DESCRIPTORS}, j AS (SELECT e.vec_id AS eval_id, c.vec_id, bit_count(xor(e.phash, c.phash))::BIGINT AS distance FROM descriptors e, descriptors c WHERE e.is_eval AND c.vec_id <> e.vec_id) SELECT DISTINCT ON (eval_id) eval_id, vec_id, distance FROM j ORDER BY eval_id, distance, vec_id"),
    "j4_within_hamming": (within, f"WITH {V.DESCRIPTORS} SELECT e.vec_id AS a, c.vec_id AS b, bit_count(xor(e.phash, c.phash))::BIGINT AS distance FROM descriptors e, descriptors c WHERE e.is_eval AND c.vec_id <> e.vec_id AND bit_count(xor(e.phash, c.phash)) <= 21"),
    "j5_j6_profile_leaks": (leaks, f"{_COARSE}, rr AS (SELECT eval_id, vec_id, {_corr('ez', 'cz')} AS corr FROM ck WHERE rk <= 10) SELECT eval_id, {_Q.format('max(corr)')} AS corr, max_by(vec_id, corr) AS vec_id, array_to_string(list_slice(list(vec_id ORDER BY corr DESC, vec_id), 1, 3), ',') AS best FROM rr GROUP BY 1"),
    "j7_combined_leaks": (combined, f"""WITH {_SPLIT}, vc AS (SELECT *, list_transform(range(0, 8), lambda r: list_sum(v[r*8+1 : r*8+8])) AS chi FROM vm), vr AS (SELECT *, list_reverse(chi) AS rev FROM vc){_z('vr', 'za')}{_z('za', 'zb', 'chi', 'zc', 4, 'b')}{_z('zb', 'zd', 'rev', 'zr', 4, 'd')},
      co AS (SELECT e.vec_id AS eval_id, c.vec_id, e.z AS ez, c.z AS cz, e.zc AS ec, e.zr AS er, c.zc AS cc, {_COS.format('z')} AS s FROM zd e, zd c WHERE e.is_eval AND c.vec_id <> e.vec_id),
      ck AS (SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY round(s, 9) DESC, vec_id) AS rk FROM co),
      sc AS (SELECT eval_id, vec_id, least({_corr('ez', 'cz')}, greatest({_corr('ec', 'cc', 8, 4)}, {_corr('er', 'cc', 8, 4)})) AS score FROM ck WHERE rk <= 12)
      SELECT DISTINCT ON (eval_id) eval_id, vec_id, {_Q.format('score')} AS score, score >= 0.95 AS leak FROM sc ORDER BY eval_id, round(score, 9) DESC, vec_id"""),
    "j8_confirmation": (confirmation, f"""{_COARSE}, rr AS (SELECT eval_id, vec_id, round({_corr('ez', 'cz')}, 9) AS corr FROM ck WHERE rk <= 12), pl AS (SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY corr DESC, vec_id) AS place FROM rr QUALIFY place <= 4),
      ch AS (SELECT eval_id, max(corr) AS best FROM pl GROUP BY 1 ORDER BY best DESC, eval_id LIMIT 22) SELECT eval_id, vec_id, place, {_Q.format('corr')} AS corr, corr >= 0.985 AS same_frame_level FROM pl JOIN ch USING (eval_id)"""),
    "j9_candidates": (candidates, f"{_TOPF} SELECT vec_id % 27 AS tar, count(*) AS n, count(DISTINCT eval_id) AS n_evals FROM tf WHERE eval_id IN (SELECT eval_id FROM tf WHERE rank = 1 AND score >= 0.35) GROUP BY 1"),
    "j10_material_baseline": (baseline, f"""WITH {_SPLIT}{_z('vm', 'zz')}, f AS (SELECT vec_id % 3 AS m, vec_id % 30 AS sc, min(vec_id) AS id FROM zz GROUP BY ALL), g AS (SELECT f.*, z, row_number() OVER (PARTITION BY m ORDER BY id) AS rn FROM f JOIN zz ON id = vec_id QUALIFY rn <= 10),
      p AS (SELECT a.m, {_corr('a.z', 'b.z')} AS c FROM g a JOIN g b ON a.m = b.m AND a.id < b.id) SELECT 'mat'||m AS material, (SELECT count(*) FROM g WHERE g.m = p.m) AS n_scans, {_Q.format('quantile_cont(c, 0.5)')} AS median, {_Q.format('quantile_cont(c, 0.9)')} AS p90, {_Q.format('max(c)')} AS most FROM p GROUP BY m"""),
    "j11_j13_neighbours": (adjacent, f"""WITH {_SPLIT}{_z('vm', 'zz')}, l AS (SELECT 1::BIGINT AS lag, scan, frame_idx, z, lead(z, 1) OVER w AS n, lead(frame_idx, 1) OVER w AS f FROM zz WINDOW w AS (PARTITION BY scan ORDER BY frame_idx) UNION ALL
      SELECT 30, scan, frame_idx, z, lead(z, 30) OVER w, lead(frame_idx, 30) OVER w FROM zz WINDOW w AS (PARTITION BY scan ORDER BY frame_idx)) SELECT lag, scan, frame_idx, {_Q.format(_corr('z', 'n'))} AS corr FROM l WHERE f IS NOT NULL"""),
    "j11_contiguous": (contiguous, f"WITH {V.DESCRIPTORS} SELECT vec_id // 60 AS scan, count(*) AS n FROM descriptors GROUP BY 1 HAVING count(*) >= 50 AND max(vec_id + vec_id // 97) - min(vec_id + vec_id // 97) + 1 = count(*)"),
    "j11_calibration": (calibration, f"""WITH {_SPLIT}, g AS (SELECT vec_id // 60 AS scan, vec_id + vec_id // 97 AS frame_idx, v FROM vm){_z('g', 'gz')}, c AS (SELECT scan FROM gz GROUP BY 1 HAVING count(*) >= 30 AND max(frame_idx) - min(frame_idx) + 1 = count(*)),
      f AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY frame_idx) AS i, lead(z) OVER (PARTITION BY scan ORDER BY frame_idx) AS n FROM gz WHERE scan IN (SELECT scan FROM c)), p AS (SELECT scan, {_corr('z', 'n')} AS corr FROM f WHERE i <= 30 AND n IS NOT NULL),
      d AS (SELECT z AS dz FROM gz ORDER BY md5('0|'||scan||'|'||frame_idx), scan, frame_idx LIMIT 30), o AS (SELECT scan, {_corr('z', 'dz')} AS corr FROM f, d WHERE i = 1)
      SELECT scan, count(*) AS n_pairs, {_Q.format('quantile_cont(corr, 0.5)')} AS median, {_Q.format('min(corr)')} AS least, (SELECT {_Q.format('quantile_cont(o.corr, 0.5)')} FROM o WHERE o.scan = p.scan) AS random_median FROM p GROUP BY scan"""),
    "j12_representations": (representations, f"""WITH {_SPLIT}, h AS (SELECT vec_id, v, list_transform(range(1, 65), lambda i: CASE WHEN (i-1) % 9 = 0 THEN 0.0::DOUBLE ELSE v[i] END) AS w FROM vm){_z('h', 'ha')}{_z('ha', 'hb', 'w', 'zw', 8, 'b')},
      c AS (SELECT {_corr('z', 'zw')} AS c FROM hb) SELECT count(*) AS n, {_Q.format('min(c)')} AS least, {_Q.format('quantile_cont(c, 0.5)')} AS median, {_Q.format('max(c)')} AS most, quantile_cont(c, 0.5) > 0.7 AS robust FROM c"""),
    "j13_raw_pairs": (raw_pairs, f"""WITH {V.FRAMES}, g AS (SELECT scan, frame_idx // 300 AS frame_idx, ord % 3 = 0 AS is_raw, min_by(key, ord) AS key, min(ord) AS o FROM frames GROUP BY ALL)
      SELECT a.scan, a.frame_idx, a.key AS raw_key, b.key FROM g a JOIN g b ON a.scan = b.scan AND a.frame_idx = b.frame_idx AND a.is_raw AND NOT b.is_raw ORDER BY a.o LIMIT 20"""),
    "j14_provenance": (provenance, r"""WITH m AS (SELECT DISTINCT lower(coalesce(source, 'none'))||'_'||lpad(doc_id::VARCHAR, 6, '0') AS token FROM documents), t AS (SELECT token FROM m WHERE length(token) >= 6),
      n AS (SELECT DISTINCT 'scan/src'||(page_id % 20)||'_'||lpad(page_id::VARCHAR, 6, '0')||'/a' AS name FROM pages) SELECT token, count(name) AS n FROM t LEFT JOIN n ON contains(name, token) GROUP BY 1"""),
    "f2_pixel_stats": (pixel_stats, f"""WITH {V.LONG_PIXELS}, a AS (SELECT vec_id, count_if(x<>0)/count(*)::DOUBLE AS fv, count_if(x>=0.2)/greatest(count_if(x<>0),1)::DOUBLE AS st, avg(CASE WHEN x<>0 THEN x END) AS mean, max(CASE WHEN x<>0 THEN x END)-min(CASE WHEN x<>0 THEN x END) AS dyn FROM long_pixels GROUP BY 1)
      SELECT vec_id, round(fv,6) AS frac_valid, round(st,6) AS saturation, {_Q.format('mean')} AS mean, round(dyn,6) AS dyn, fv < 0.02 OR dyn < 0.4 AS blank FROM a"""),
    "f10_rescaled": (rescaled, f"""WITH {V.LONG_PIXELS}, a AS (SELECT vec_id, min(x) AS lo, max(x) AS hi, avg(x) AS m, stddev_pop(x) AS sd FROM long_pixels WHERE x<>0 GROUP BY 1)
      SELECT vec_id, r, c, CASE WHEN x=0 THEN 0 ELSE {_Q.format('(x-lo)/(hi-lo)')} END AS minmax, CASE WHEN x=0 THEN 0 ELSE {_Q.format('(x-m+sd/2)/sd')} END AS meanstd, CASE WHEN x=0 THEN 0 ELSE {_Q.format('(x-m)/sd')} END AS z FROM long_pixels JOIN a USING (vec_id)"""),
    "f14_profiles": (profiles, f"""WITH {V.LONG_PIXELS}, p AS (SELECT vec_id, r, c, greatest(x,0)*100 AS x FROM long_pixels), u AS (SELECT vec_id, 'col' AS kind, c AS pos, x FROM p UNION ALL SELECT vec_id, 'row', r, x FROM p)
      SELECT vec_id, kind, pos, {_Q.format("coalesce(sum(ln(1+x))/nullif(count_if(x<>0),0),0.0::DOUBLE)")} AS v FROM u GROUP BY ALL"""),
    "f16_f17_radial": (radial, f"""WITH {V.LONG_PIXELS}, p AS (SELECT vec_id, c*0.55::DOUBLE+0.1::DOUBLE AS qx, (7-r)*0.9::DOUBLE+0.05::DOUBLE AS qz, ln(1+greatest(x,0)) AS v FROM long_pixels WHERE x<>0),
      u AS (SELECT vec_id, 'q' AS kind, least(floor(sqrt(qx*qx+qz*qz)/6*30),29)::BIGINT AS bin, v FROM p UNION ALL SELECT vec_id, 'chi', least(floor(degrees(atan2(abs(qz),abs(qx)+1e-9::DOUBLE))/90*16),15)::BIGINT, v FROM p) SELECT vec_id, kind, bin, {_Q.format('avg(v)')} AS v FROM u GROUP BY ALL"""),
    "f19_f20_arrays": (arrays, f"""WITH {_SPLIT}{_z('vm', 'zz')}{_FLIPS.replace('FROM vm', 'FROM zz')} SELECT vec_id, {_Q.format('z[6]')} AS z5, {_Q.format('list_dot_product(z, z)')} AS zz, {_Q.format('v[10]/sqrt(list_dot_product(v,v))')} AS u9, len(list_filter(v, lambda x: x<>0)) AS n_valid,
      {', '.join(f'{_Q.format(f"v{k}[4]")} AS flip{i}' for i, k in enumerate(_FLIP))}, {_Q.format('sqrt(v[8]*v[8]+v[16]*v[16])')} AS reach FROM fl"""),
    "f13_mask_cells": (masks, f"""WITH {V.FRAMES}, r AS (SELECT key, c, row_number() OVER (PARTITION BY key ORDER BY md5('1|'||key||'|'||c)) AS rn FROM frames, (SELECT unnest(range(64)) AS c))
      SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS masked FROM r WHERE rn <= 38 GROUP BY 1"""),
    "f1_paths": (paths, """SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'bt1/s'||user_id||'/x' WHEN 1 THEN 'bt2/lab6_'||user_id WHEN 2 THEN 'bt3/a/s'||user_id WHEN 3 THEN 'bt4/s'||user_id WHEN 4 THEN 'bt5/s'||user_id
      WHEN 5 THEN 'p/q'||user_id WHEN 6 THEN 'p/q'||user_id WHEN 7 THEN 'plain.png' WHEN 8 THEN 'two__parts'||event_id||'.png' ELSE 'bc/d' END AS scan, CASE WHEN event_id % 10 = 7 THEN -1 ELSE event_id END::INTEGER AS frame_idx, event_id % 10 = 1 AS calibrant FROM events"""),
    "s5_f18_axes": (axes, f"""WITH {V.BOXES} SELECT image_id, det, CASE det WHEN 1 THEN x2 WHEN 2 THEN 0.0::DOUBLE END AS second, CASE det WHEN 1 THEN y2 WHEN 2 THEN 0.0::DOUBLE END AS fourth,
      {_Q.format('CASE WHEN det = 1 THEN x2*1/4 ELSE 3.8::DOUBLE*1/4 END')} AS point1, {_Q.format('CASE WHEN det = 1 THEN x2 ELSE 3.8::DOUBLE END')} AS point4 FROM boxes"""),
}
