"""Running values along keys of any size, as scans: blocks of a key are summed up by themselves and put together through their summaries.

Rows have `_k` (the key), `_i` (place in the key, from 0) and `_x` (a double or null). A block has `BLOCK` places; a level has a BLOCK-th
of the rows of the one below.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .linked import runs
from .store import stored

BLOCK = 512
#: Exponents that doubles bear, with room for the values.
REACH = 600.0


def placed(df: DataFrame, keys: list[str], order: str, value: str | Column) -> DataFrame:
    """The rows with _k, _i and _x, stored."""
    x = F.col(value) if isinstance(value, str) else value
    x = x.cast("double")
    rows = runs(df.withColumns({"_k": F.struct(*keys), "_x": F.when(~F.isnan(x), x)}), "_k", [order])
    return stored(rows.drop("_slice", "_n"), "scan-rows")


def _in_blocks(rows: DataFrame, size: int = BLOCK) -> tuple[DataFrame, Window]:
    return rows.withColumn("_b", F.floor(F.col("_i") / size)), Window.partitionBy("_k", "_b").orderBy("_i")


def filled(rows: DataFrame) -> DataFrame:
    """_x with its gaps filled along a line between the known neighbours; what follows the last known value is that value."""
    rows, inside = _in_blocks(rows)
    known = F.when(F.col("_x").isNotNull(), F.struct("_i", "_x"))
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    per = rows.groupBy("_k", "_b").agg(F.min(known).alias("_first"), F.max(known).alias("_last"))
    blocks = Window.partitionBy("_k").orderBy("_b")
    edges = per.select("_k", "_b", F.last("_last", True).over(blocks.rowsBetween(first, -1)).alias("_left"), F.first("_first", True).over(blocks.rowsBetween(1, last)).alias("_right"))
    near = rows.withColumns({"_l": F.last(known, True).over(inside.rowsBetween(first, 0)), "_r": F.first(known, True).over(inside.rowsBetween(0, last))}).join(edges, ["_k", "_b"])
    a, z = F.coalesce("_l", "_left"), F.coalesce("_r", "_right")
    between = a["_x"] + (z["_x"] - a["_x"]) / (z["_i"] - a["_i"]) * (F.col("_i") - a["_i"])
    x = F.when(F.col("_x").isNotNull(), F.col("_x")).when(z.isNull(), a["_x"]).otherwise(between)
    return near.withColumn("_x", x).drop("_b", "_l", "_r", "_left", "_right")


def decayed(rows: DataFrame, sums: dict[str, str], decay: float, longest: int, level: int = 0) -> DataFrame:
    """The rows with the sums over all earlier values and their own, each times decay to the power of its distance. sums: new name by column;
    longest: rows of the longest key."""
    fall = -log(decay) if decay > 0 else REACH
    size = max(1, min(BLOCK, int(REACH / fall))) if fall > 0 else BLOCK
    rows, inside = _in_blocks(rows, size)
    at = (F.col("_i") - F.col("_b") * size).cast("double")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    own = {new: F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.exp(at * fall)).over(upto) * F.exp(at * -fall) for c, new in sums.items()}
    rows = rows.withColumns(own)
    blocks = -(-longest // size)
    if blocks <= 1 or size == 1:  # a step of more than half the reach leaves nothing of what came before
        return rows.drop("_b")
    # what a block hands on, as of its last place
    end = F.exp((at - (size - 1)) * fall)
    handed = {f"_t{level}_{k}": f"_p{level}_{k}" for k in range(len(sums))}
    totals = rows.groupBy("_k", "_b").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0.0)) * end).alias(t) for c, t in zip(sums, handed)])
    totals = stored(totals.withColumnRenamed("_b", "_i"), "scan-blocks")
    before = decayed(totals, handed, exp(-min(fall * size, REACH)), blocks, level + 1)
    before = before.select("_k", (F.col("_i") + 1).alias("_b"), *handed.values())
    joined = rows.join(before, ["_k", "_b"], "left")
    for new, p in zip(sums.values(), handed.values()):
        joined = joined.withColumn(new, F.col(new) + F.coalesce(p, F.lit(0.0)) * F.exp((at + 1) * -fall))
    return joined.drop("_b", *handed.values())
