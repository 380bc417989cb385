"""Kernel queries on the grids view (8 x 8 frames of bytes), each with its SQL."""

from __future__ import annotations

import numpy as np

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import pixels as X
from . import views as V

UP = lambda c: F.round(c + 1e-9, 6)


def _frames(s, d):
    return V.grids(s, d).select(F.col("vec_id").cast("string").alias("key"), "h", "w", "pixels")


def _cells(frames, fn, side=None):
    """A row per cell of what fn makes of each frame: vec_id, cell, v."""
    out = X.per_frame(frames, lambda img, row: {"v": np.asarray(fn(img), np.float64).ravel()}, "key string, v array<double>")
    return out.select(F.col("key").cast("long").alias("vec_id"), F.posexplode("v").alias("cell", "v")).select("vec_id", F.col("cell").cast("long").alias("cell"), UP(F.col("v")).alias("v"))


def digests(s, d):
    return V.grids(s, d).select("vec_id", F.md5("pixels").alias("md5"))


def prints(s, d):
    """F2, F5, F6 in the one pass of `fingerprints`; the descriptor at one place of each of the 64 cells."""
    p = X.fingerprints(_frames(s, d))
    at = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("desc", (F.floor(i / 8) * 256 + i % 8 * 8).cast("int")).cast("double"))
    return p.select(
        F.col("key").cast("long").alias("vec_id"), F.round(F.col("frac_valid").cast("double"), 4).alias("frac_valid"), F.round(F.col("saturation").cast("double"), 4).alias("saturation"),
        F.col("mean").cast("double").alias("mean"), F.col("dyn").cast("double").alias("dyn"), "blank", "phash", F.array_join(F.transform(at, lambda x: F.round(x * 16777216).cast("long").cast("string")), ",").alias("descriptor"),
    )


def augmentations(s, d):
    """both versions; draws come from numpy's generator, so SQL has no form of it."""
    out = None
    for version in (1, 2):
        a = X.augmented(_frames(s, d), 7, version).select(F.lit(version).alias("version"), F.col("key").cast("long").alias("vec_id"), F.length("pixels").alias("n_bytes"), F.md5("pixels").alias("md5"))
        out = a if out is None else out.unionByName(a)
    return out


def inputs(s, d):
    """model input and mask, a row per cell."""
    x, m = X.model_input(F.col("g"))
    j = V.grids(s, d).select("vec_id", F.posexplode(F.arrays_zip(x.alias("x"), m.alias("m"))).alias("cell", "p"))
    return j.select("vec_id", F.col("cell").cast("long").alias("cell"), UP(F.col("p.x")).alias("x"), F.col("p.m").cast("long").alias("valid"))


def resampled(s, d):
    """the grid's values as a profile, on 60 points of the common q grid; every fifth has no known range."""
    rows = V.grids(s, d).select(F.col("vec_id").cast("string").alias("key"), "h", "w", "pixels", F.when(F.col("vec_id") % 5 != 0, F.col("vec_id") % 7 + 1.5).alias("q_max"))
    out = X.per_frame(rows, lambda img, r: {"v": K.resample_q(img.ravel().astype(float), r["q_max"], 60)}, "key string, v array<double>")
    return out.select(F.col("key").cast("long").alias("vec_id"), F.posexplode("v").alias("cell", "v")).select("vec_id", F.col("cell").cast("long").alias("cell"), UP(F.col("v")).alias("v"))


def reach(s, d):
    """an axis spaced anew, one from a given range, and the reach of a frame by size."""
    b = V.boxes(s, d)
    axis = F.array(F.col("x1"), F.col("y1"), F.col("x2"))
    new = X.axis_of_length(F.when(F.col("det") % 2 == 0, axis).otherwise(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0), F.lit(8.0), F.lit(16.0))), 5)
    qx = X.axis_or_default(F.array("x1", "x2", "y1", "y2"), 5, start=2)
    return b.select("image_id", "det", UP(F.get(new, F.lit(1))).alias("second"), UP(F.get(new, F.lit(4))).alias("last"), UP(F.get(qx, F.lit(3))).alias("qx3"), UP(X.q_reach_of_shape(F.col("y2"), F.col("x2"), 80.0)).alias("reach"))


# the grid as rows, values from 0 to 255
_C = V.GRIDS + """, cells AS (SELECT vec_id, (i-1)::BIGINT AS cell, (i-1)//8 AS r, (i-1)%8 AS c, g[i]::DOUBLE AS x FROM (SELECT vec_id, g, unnest(range(1, 65)) AS i FROM grids))"""
_STRETCH = _C + """, sl AS (SELECT *, CASE WHEN x<>0 THEN ln(1+x) END AS l, count_if(x<>0) OVER (PARTITION BY vec_id) AS n FROM cells),
 sq AS (SELECT vec_id, quantile_cont(l, 0.01) AS lo, quantile_cont(l, 0.99) AS hi FROM sl GROUP BY 1),
 st AS (SELECT vec_id, cell, r, c, CASE WHEN n < 16 OR x = 0 THEN 0 ELSE floor(least(greatest((l-lo)/(CASE WHEN hi>lo THEN hi-lo ELSE 1 END), 0), 1)*255) END::DOUBLE AS y FROM sl JOIN sq USING (vec_id))"""
_Q = "round({} + 1e-9::DOUBLE, 6)"


def _regrid(h: int, w: int, px: str, py: str, reach: int, weight, masked: bool) -> str:
    """SQL of a re-grid to h x w: px, py from angle a (row i), radius q; `weight(d)` of a neighbour at distance d; rows count from the top."""
    near = f"(SELECT unnest(range({1 - reach}, {reach + 1})) AS dy) CROSS JOIN (SELECT unnest(range({1 - reach}, {reach + 1})) AS dx)"
    a = "radians(90 - 90.0::DOUBLE * i / {0})".format(h - 1) if masked else "radians(90.0::DOUBLE * i / {0})".format(h - 1)
    value = "CASE WHEN sum(k * m) > 0.5 THEN sum(k * x) / sum(k * m) ELSE 0 END" if masked else "sum(k * x)"
    return f"""{_C}, ag AS (SELECT i, j, {a} AS a, sqrt(98.0::DOUBLE) * j / {w - 1} AS q FROM (SELECT unnest(range({h})) AS i) CROSS JOIN (SELECT unnest(range({w})) AS j)),
 pt AS (SELECT i, j, {px} AS px, {py} AS py FROM ag), nb AS (SELECT i, j, floor(px)::BIGINT + dx AS c, floor(py)::BIGINT + dy AS r, {weight('abs(px - (floor(px) + dx))')} * {weight('abs(py - (floor(py) + dy))')} AS k FROM pt, {near}),
 su AS (SELECT vec_id, i * {w} + j AS cell, {value} AS v FROM (SELECT *, CASE WHEN x <> 0 THEN 1 ELSE 0 END AS m FROM cells) JOIN nb USING (r, c) GROUP BY ALL),
 al AS (SELECT vec_id, cell::BIGINT AS cell FROM grids, (SELECT unnest(range({h * w})) AS cell)) SELECT vec_id, cell, {_Q.format('coalesce(v, 0)')} AS v FROM al LEFT JOIN su USING (vec_id, cell)"""


_LINEAR = lambda d: f"(1 - {d})"
_CUBIC = lambda d: f"(CASE WHEN {d} <= 1 THEN 1.25::DOUBLE*pow({d},3) - 2.25::DOUBLE*pow({d},2) + 1 ELSE -0.75::DOUBLE*(pow({d},3) - 5*pow({d},2) + 8*{d} - 4) END)"
_WIDE = "least(a * 0.6::DOUBLE / (1e-4::DOUBLE + q / sqrt(98.0::DOUBLE)), pi())"

PLANS = {
    "f3_md5": (digests, f"WITH {V.GRIDS} SELECT vec_id, md5(unhex(array_to_string(list_transform(g, lambda x: printf('%02X', x)), ''))) AS md5 FROM grids"),
    "f4_stretched": (lambda s, d: _cells(_frames(s, d), K.stretch), f"WITH {_STRETCH} SELECT vec_id, cell, y AS v FROM st"),
    "f2_f5_f6_fingerprints": (prints, f"""WITH {_STRETCH}, qu AS (SELECT vec_id, count_if(x<>0) AS n, count_if(x>=254) AS sa, avg(CASE WHEN x<>0 THEN x END) AS mean, max(CASE WHEN x<>0 THEN x END)-min(CASE WHEN x<>0 THEN x END) AS dyn FROM cells GROUP BY 1),
      dl AS (SELECT vec_id, cell, x, CASE WHEN n >= 16 AND x <> 0 THEN ln(1+x) ELSE x END AS y FROM sl), dz AS (SELECT vec_id, avg(y) AS m, stddev_pop(y) AS sd FROM dl WHERE x <> 0 GROUP BY 1),
      dv AS (SELECT vec_id, cell, CASE WHEN x = 0 OR n = 0 THEN 0 ELSE (y - m) / CASE WHEN sd < 1e-6 THEN 1 ELSE sd END END AS z FROM dl LEFT JOIN dz USING (vec_id) JOIN qu USING (vec_id)),
      de AS (SELECT vec_id, string_agg((CASE WHEN abs(z) < pow(2, -14) THEN round_even(z * 16777216, 0) ELSE round_even(z / pow(2, floor(log2(abs(z))) - 10), 0) * pow(2, floor(log2(abs(z))) - 10) * 16777216 END)::BIGINT::VARCHAR, ',' ORDER BY cell) AS descriptor FROM dv GROUP BY 1),
      lc AS (SELECT xx, x, x - (xx + 0.5::DOUBLE) / 4 + 0.5 AS d FROM (SELECT unnest(range(32)) AS xx), (SELECT unnest(range(8)) AS x) WHERE x >= greatest(trunc((xx + 0.5) / 4 - 2.5), 0) AND x < least(trunc((xx + 0.5) / 4 + 3.5), 8)),
      lk AS (SELECT xx, x, CASE WHEN d = 0 THEN 1.0::DOUBLE WHEN abs(d) >= 3 THEN 0 ELSE sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) END AS w FROM lc), ln AS (SELECT xx, x, w / sum(w) OVER (PARTITION BY xx) AS w FROM lk),
      lw AS (SELECT xx, x, trunc(w * 4194304 + CASE WHEN w < 0 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END) AS k FROM ln),
      hz AS (SELECT vec_id, r, xx AS c, least(greatest(floor((sum(y * k) + 2097152) / 4194304), 0), 255) AS y FROM st JOIN lw ON x = c GROUP BY ALL),
      vz AS (SELECT vec_id, xx AS r, c, least(greatest(floor((sum(y * k) + 2097152) / 4194304), 0), 255) AS y FROM hz JOIN lw ON x = r GROUP BY ALL),
      co AS (SELECT u, p, cos(pi() * (2 * p + 1) * u / 64) AS k FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(32)) AS p)), lv AS (SELECT vec_id, r, b.u AS v, sum(y * k) AS y FROM vz JOIN co b ON b.p = c GROUP BY ALL),
      lo AS (SELECT vec_id, a.u AS u, v, sum(y * k) AS low FROM lv JOIN co a ON a.p = r GROUP BY ALL), md AS (SELECT vec_id, quantile_cont(low, 0.5) AS md FROM lo GROUP BY 1),
      ph AS (SELECT vec_id, sum(CASE WHEN low > md THEN CASE WHEN u + v = 0 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << (63 - u * 8 - v)::INTEGER) END ELSE 0 END)::BIGINT AS phash FROM lo JOIN md USING (vec_id) GROUP BY 1)
      SELECT vec_id, round_even(n / 64.0::DOUBLE, 4) AS frac_valid, round_even(sa / greatest(n, 1)::DOUBLE, 4) AS saturation, round_even(coalesce(mean, 0), 2)::FLOAT::DOUBLE AS mean, coalesce(dyn, 0) AS dyn, n < 1.28 OR coalesce(dyn, 0) < 4 AS blank, phash, descriptor FROM qu JOIN de USING (vec_id) JOIN ph USING (vec_id)"""),
    "f7_cake": (lambda s, d: _cells(_frames(s, d), lambda i: K.polar(i, 16, 24)), "WITH " + _regrid(16, 24, "q * cos(a)", "7 - q * sin(a)", 1, _LINEAR, True)),
    "f8_quasi_polar": (lambda s, d: _cells(_frames(s, d), lambda i: K.quasi_polar(i.astype(float), 12, 16)), "WITH " + _regrid(12, 16, f"q * cos({_WIDE})", f"q * sin({_WIDE})", 1, _LINEAR, False)),
    "f8_polar_cubic": (lambda s, d: _cells(_frames(s, d), lambda i: K.polar_cubic(i.astype(float), 12, 16)), "WITH " + _regrid(12, 16, "q * cos(a)", "q * sin(a)", 2, _CUBIC, False)),
    "f9_contrast": (lambda s, d: _cells(_frames(s, d), lambda i: K.contrast(i.astype(float))), f"""WITH {_C}, cq AS (SELECT vec_id, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.995) AS hi FROM cells WHERE x <> 0 GROUP BY 1),
      cl AS (SELECT vec_id, cell, log10(least(greatest(x, lo), hi) + 1e-7::DOUBLE) AS l FROM cells JOIN cq USING (vec_id) WHERE x <> 0), cm AS (SELECT vec_id, min(l) AS lo, max(l) AS hi, count(*) AS n FROM cl GROUP BY 1),
      cv AS (SELECT vec_id, cell, n, floor((l - lo) / greatest(hi - lo, 1e-12::DOUBLE) * 255) AS v FROM cl JOIN cm USING (vec_id)), cc AS (SELECT *, count(*) OVER (PARTITION BY vec_id ORDER BY v) AS cum, count_if(v = 0) OVER (PARTITION BY vec_id) AS first FROM cv),
      ce AS (SELECT vec_id, cell, CASE WHEN n = first THEN v ELSE round_even((cum - first) * (255::FLOAT / (n - first)::FLOAT)::DOUBLE, 0) END / 255 AS v FROM cc) SELECT vec_id, cell, {_Q.format('coalesce(v, 0)')} AS v FROM cells LEFT JOIN ce USING (vec_id, cell)"""),
    "f11_model_input": (inputs, f"WITH {_C} SELECT vec_id, cell, {_Q.format('x / 255')} AS x, (x <> 0)::BIGINT AS valid FROM cells"),
    "f12_augmented": (augmentations, None),
    "f15_resampled": (resampled, f"""WITH {V.GRIDS}, p AS (SELECT vec_id, g, k, 6.0::DOUBLE * k / 59 AS q, CASE WHEN vec_id % 5 <> 0 THEN vec_id % 7 + 1.5::DOUBLE ELSE 5.4::DOUBLE END AS top FROM grids, (SELECT unnest(range(60)) AS k)),
      a AS (SELECT *, q / top * 63 AS t FROM p), b AS (SELECT *, least(floor(t), 62)::INTEGER AS i FROM a) SELECT vec_id, k::BIGINT AS cell, {_Q.format('CASE WHEN q > top THEN 0 ELSE g[i+1] + (g[i+2] - g[i+1]) * (t - i) END')} AS v FROM b"""),
    "f18_f23_reach": (reach, f"""WITH {V.BOXES}, a AS (SELECT *, CASE WHEN det % 2 = 0 THEN least(x1, y1, x2) ELSE 1.0::DOUBLE END AS lo, CASE WHEN det % 2 = 0 THEN greatest(x1, y1, x2) ELSE 16.0::DOUBLE END AS hi FROM boxes)
      SELECT image_id, det, {_Q.format('CASE WHEN det % 2 = 0 THEN lo + (hi - lo) / 4 ELSE 2 END')} AS second, {_Q.format('hi')} AS last, {_Q.format('y1 + (y2 - y1) * 3 / 4')} AS qx3, {_Q.format('sqrt(pow(y2/80,2)+pow(x2/80,2))')} AS reach FROM a"""),
    "f24_thumbnails": (lambda s, d: _cells(X.thumbnails(_frames(s, d), 4, 4), lambda i: i), f"WITH {_STRETCH} SELECT vec_id, ((r // 2) * 4 + c // 2)::BIGINT AS cell, round_even(avg(y), 0) AS v FROM st GROUP BY ALL"),
}
