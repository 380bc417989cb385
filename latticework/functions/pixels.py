"""Frame kernels as DataFrame transforms: frames are rows with h, w and pixels (bytes, row by row)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Frames in an Arrow batch: a frame of 0.5 MB must not be multiplied by the default batch size.
BATCH = 64


def image(h: int, w: int, pixels: bytes, dtype=np.uint8) -> np.ndarray:
    return np.frombuffer(pixels, dtype).reshape(h, w)


def per_frame(frames: DataFrame, fn: Callable[[np.ndarray, dict], dict], schema: str, keep: tuple[str, ...] = ("key",)) -> DataFrame:
    """One call of fn(image, row) per frame; kept columns pass through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), BATCH):
                rows = pdf.iloc[a : a + BATCH].to_dict("records")
                yield pd.DataFrame([{k: r[k] for k in keep} | fn(image(r["h"], r["w"], r["pixels"]), r) for r in rows])

    return frames.mapInPandas(run, schema)


def fingerprints(frames: DataFrame, keep: tuple[str, ...] = ("key",), keep_schema: str = "key string") -> DataFrame:
    """F2, F4-F6, F14 in one pass over the pixels: quality, hash, descriptor and profiles."""

    def fn(img: np.ndarray, row: dict) -> dict:
        frac, sat, mean, dyn, blank = K.quality(img)
        col, line = K.profiles(img)
        return {"frac_valid": frac, "saturation": sat, "mean": mean, "dyn": dyn, "blank": blank, "phash": K.perceptual_hash(img), "desc": K.descriptor(img), "col": col, "row": line}

    return per_frame(frames, fn, f"{keep_schema}, frac_valid float, saturation float, mean float, dyn float, blank boolean, phash long, desc array<float>, col array<float>, row array<float>", keep)


def augmented(frames: DataFrame, seed: int, version: int = 1) -> DataFrame:
    """augmented frames; the random numbers of a frame follow from its key and the seed, so a retried task repeats them."""
    keyed = frames.withColumn("_seed", F.xxhash64("key", F.lit(seed)))

    def fn(img: np.ndarray, row: dict) -> dict:
        return {"h": row["h"], "w": row["w"], "pixels": K.augment(img / 255.0, int(row["_seed"]), version).astype(np.float32).tobytes()}

    return per_frame(keyed, fn, "key string, h int, w int, pixels binary")


def thumbnails(frames: DataFrame, h: int = 64, w: int = 128) -> DataFrame:
    """F24."""
    return per_frame(frames, lambda img, row: {"h": h, "w": w, "pixels": K.area_resize(K.stretch(img), h, w).round().astype(np.uint8).tobytes()}, "key string, h int, w int, pixels binary")


def mask_cells(frames: DataFrame, cells: int, ratio: float, seed: int, key: str = "key") -> DataFrame:
    """round(ratio * cells) masked cells of a block grid per frame, drawn without replacement by seeded hashes."""
    n = round(ratio * cells)
    drawn = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda c: F.struct(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col(key).cast("string"), c.cast("string"))).alias("h"), c.alias("c"))))
    return frames.select(key, F.array_sort(F.transform(F.slice(drawn, 1, n), lambda x: x["c"])).alias("masked"))


# ---- column expressions on arrays ------------------------------------------------------------------------------------


# The path patterns of raw and converted frames and the trailing number of a name, capitals aside where (?i) says so.
RAW_PATH = r"(?i)beamtimes/([^/]+)/(?:raw|Converted|converted)/(.+?)/pe/.*?-(\d+)(?:\.raw)?\.tif"
TENSOR_PATH = r"(?i)tensor/([^/]+)/(.+)/[^/]+?_f?(\d+)\.(?:pt|png|tif)"
TRAILING_NUMBER = r"(\d+)\D*$"


def parse_scan(key: str = "key", source: str = "source") -> tuple[Column, Column]:
    """scan and frame number from the source path, or from the member name if there is none; a path of neither form
    leaves the member name's tokens and trailing number."""
    text = F.coalesce(F.nullif(F.col(source), F.lit("")), F.col(key))
    base = F.element_at(F.split(F.col(key), "/"), -1)
    tokens = F.split(F.regexp_replace(F.regexp_replace(base, r"\.raw", ""), r"\.[^.]*$", ""), "__")
    by_name = F.when(F.size(tokens) >= 3, F.concat_ws("/", F.element_at(tokens, -3), F.element_at(tokens, -2))).otherwise(base)
    scan, number = by_name, F.regexp_extract(base, TRAILING_NUMBER, 1)
    for pattern in (TENSOR_PATH, RAW_PATH):
        at = lambda k: F.regexp_extract(text, pattern, k)  # noqa: B023, E731
        scan = F.when(text.rlike(pattern), F.concat_ws("/", at(1), at(2))).otherwise(scan)
        number = F.when(text.rlike(pattern), at(3)).otherwise(number)
    return scan, F.coalesce(number.try_cast("int"), F.lit(-1))


def parse_axis(text: Column | str) -> Column:
    """The first four numbers of an axis given as text, null if there are fewer."""
    found = F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(r"[-+]?\d*\.?\d+"), F.lit(0))
    return F.when(F.size(found) >= 4, F.transform(F.slice(found, 1, 4), lambda x: x.cast("double")))


def axis_or_default(axis: Column, n: int, top: float = 3.8, start: int = 0) -> Column:
    """n evenly spaced points over the part of a 4-number range that begins at `start` (0: qz, 2: qx), or from 0 to the top if the
    range is missing or all zero."""
    known = axis.isNotNull() & F.exists(axis, lambda x: x != 0)
    return _spaced(F.when(known, F.get(axis, F.lit(start))).otherwise(0.0), F.when(known, F.get(axis, F.lit(start + 1))).otherwise(top), n)


def axis_of_length(axis: Column, n: int) -> Column:
    """a given axis, spaced anew between its least and largest value if it has not n points."""
    return F.when(F.size(axis) == n, axis).otherwise(_spaced(F.array_min(axis), F.array_max(axis), n))


def _spaced(low: Column, high: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + (high - low) * i / max(n - 1, 1))


def model_input(pixels: Column) -> tuple[Column, Column]:
    """values over 255 with zeros kept, and the mask of valid pixels."""
    return F.transform(pixels, lambda x: x.cast("double") / 255), F.transform(pixels, lambda x: (x != 0).cast("int"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row, not once per use or array element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def masked_z(v: Column, least: int = 8) -> Column:
    """z-scores over the values other than 0, which stay 0; null with fewer than `least` values or no spread."""

    def with_mean(s: Column) -> Column:
        n = F.size(s["some"])
        return F.struct(s["v"].alias("v"), s["some"].alias("some"), n.alias("n"), (total(s["some"]) / n).alias("mean"))

    def with_sd(s: Column) -> Column:
        square = F.aggregate(s["some"], F.lit(0.0), lambda t, x: t + (x - s["mean"]) * (x - s["mean"]))
        return F.struct(s["v"].alias("v"), s["n"].alias("n"), s["mean"].alias("mean"), F.sqrt(square / s["n"]).alias("sd"))

    def scored(s: Column) -> Column:
        return F.when((s["n"] >= least) & (s["sd"] >= 1e-9), F.transform(s["v"], lambda x: F.when(x == 0, 0.0).otherwise((x - s["mean"]) / s["sd"])))

    first = F.struct(v.alias("v"), F.filter(v, lambda x: x != 0).alias("some"))
    guarded = lambda s: F.when(s["n"] > 0, _let(with_sd(s), scored))
    return _let(first, lambda s: F.when(F.size(s["some"]) > 0, _let(with_mean(s), guarded)))


def unit(v: Column) -> Column:
    """divided by its length; a length below 1e-6 counts as 1."""

    def scaled(s: Column) -> Column:
        return F.transform(s["v"], lambda x: x / F.when(s["n"] < 1e-6, 1.0).otherwise(s["n"]))

    return _let(F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x)).alias("n")), scaled)


def masked_unit(v: Column) -> Column:
    """z-scores of unit length, all 0 if there are none."""
    return F.coalesce(unit(masked_z(v)), F.transform(v, lambda x: F.lit(0.0)))


def flips(v: Column, h: int, w: int) -> list[Column]:
    """the four flips of a grid stored row by row, as index permutations."""
    at = lambda f: F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.get(v, f(i)))
    row, col = (lambda i: F.floor(i / w).cast("int")), (lambda i: i % w)
    return [v, at(lambda i: (h - 1 - row(i)) * w + col(i)), at(lambda i: row(i) * w + (w - 1 - col(i))), F.reverse(v)]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def shared_correlation(a: Column, b: Column, least: int = 8) -> Column:
    """Each side z-scored over its own support, then the cosine over the shared support; 0 below `least` shared values."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"))

    def add(t: Column, p: Column) -> Column:
        x, y = p["x"], p["y"]
        more = F.struct((t["n"] + 1).alias("n"), (t["xy"] + x * y).alias("xy"), (t["xx"] + x * x).alias("xx"), (t["yy"] + y * y).alias("yy"))
        return F.when((x != 0) & (y != 0), more).otherwise(t)

    both = F.zip_with(masked_z(a, least), masked_z(b, least), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    sums = F.aggregate(both, zero, add)
    return F.coalesce(_let(sums, lambda s: F.when((s["n"] >= least) & (s["xx"] > 0) & (s["yy"] > 0), s["xy"] / F.sqrt(s["xx"] * s["yy"]))), F.lit(0.0))


def q_reach(qx: Column, qz: Column) -> Column:
    """largest |q| of a frame from the ends of its axes."""
    return F.sqrt(F.pow(F.element_at(qx, -1), 2) + F.pow(F.element_at(qz, -1), 2))


def q_reach_of_shape(h: Column, w: Column, per_angstrom: Column | float) -> Column:
    """largest |q| of a frame from its size and pixels per inverse angstrom."""
    return F.sqrt(F.pow(h / per_angstrom, 2) + F.pow(w / per_angstrom, 2))
