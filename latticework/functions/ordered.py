"""Places in a total order, and exact percentiles, without one task for all rows.

Rows are dealt to slices by ranges of the whole sort key, so that neither a frequent value nor a dense part of the scale makes a
large slice. A window runs inside each slice; slices are put after each other by their counts, a row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import stored

#: Rows of a partition from which on larger tables get more partitions.
ROWS = 500_000


def parts_for(df: DataFrame) -> int | None:
    """Partitions of about ROWS rows each; None while Spark's own number of them is enough."""
    n = -(-df.count() // ROWS)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def sliced(df: DataFrame, keys: list[str], order: list[Column], label: str = "slices", n: int | None = None) -> DataFrame:
    """The rows with `_slice`: slices (n of them, if given) follow each other in the order of keys and order. Stored, so a slice keeps its number."""
    return stored(df.repartitionByRange(*([n] if n else []), *[F.col(k) for k in keys], *order).withColumn("_slice", F.spark_partition_id()), label)


def before(slices: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per key and slice, the sums over all slices before it."""
    per = slices.groupBy(*keys, "_slice").agg(*[c.alias(n) for n, c in sums.items()])
    w = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, "_slice", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums])


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles of a column (linear between neighbours) per key: one column per name in shares. Nulls do not count.

    Equal values are one row with their count, so a value that most rows have makes no large slice."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    rows = sliced(counted, keys, [F.col("_v")])
    offsets = before(rows, keys, {"_o": F.sum("_c")})
    inside = F.sum("_c").over(Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    totals = rows.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    by = [*keys, "_slice"]
    placed = rows.join(offsets, by).withColumn("_end", inside + F.col("_o"))  # places from _end - _c to before _end
    placed = placed.join(totals, keys) if keys else placed.crossJoin(F.broadcast(totals))  # one row without keys
    here = lambda at: (at >= F.col("_end") - F.col("_c")) & (at < F.col("_end"))
    out = []
    for name, share in shares.items():
        at = (F.col("_n") - 1) * F.lit(float(share))
        low, part = F.floor(at), at - F.floor(at)
        weight = F.when(here(low) & here(low + 1), 1.0).when(here(low), 1 - part).when(here(low + 1), part)
        out.append(F.sum(F.col("_v") * weight).alias(name))
    return placed.groupBy(*keys).agg(*out)
