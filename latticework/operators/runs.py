"""Run logs: best epochs, comparisons, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scans


def best_and_final(log: DataFrame) -> DataFrame:
    """Per run and dataset the best ap with its first epoch, and the last epoch's ap."""
    first = F.struct(F.col("ap"), (-F.col("epoch")).alias("e"))
    return log.groupBy("run", "dataset").agg(F.max("ap").alias("best_ap"), F.max_by("epoch", first).alias("best_epoch"), F.max_by("ap", "epoch").alias("final_ap"), F.max("epoch").alias("final_epoch"))


def compare(log: DataFrame, candidate: str, baseline: str) -> DataFrame:
    """R2: the candidate's epochs with the baseline's ap (null if it has none) and the difference."""
    a = log.where(F.col("run") == candidate).select("dataset", "epoch", "ap")
    b = log.where(F.col("run") == baseline).select("dataset", "epoch", F.col("ap").alias("baseline"))
    return a.join(b, ["dataset", "epoch"], "left").withColumn("delta", F.col("ap") - F.col("baseline"))


def sampled(log: DataFrame, epochs: list[int]) -> DataFrame:
    """The listed epochs that exist and each run's last one."""
    last = log.groupBy("run", "dataset").agg(F.max("epoch").alias("_last"))
    return log.join(last, ["run", "dataset"]).where(F.col("epoch").isin(epochs) | (F.col("epoch") == F.col("_last"))).drop("_last")


def verdict(best: Column, other: Column, margin: float = 0.01) -> Column:
    """R4."""
    return F.when(best - other > margin, "WIN").when(best - other > -margin, "tie").otherwise("behind")


def common_window(log: DataFrame, newer: str, older: str) -> DataFrame:
    """Best ap of both runs over their common epochs up to the newer run's last; NaN where there are none."""
    a = log.where(F.col("run") == newer).select("dataset", "epoch", F.col("ap").alias("a"))
    b = log.where(F.col("run") == older).select("dataset", "epoch", F.col("ap").alias("b"))
    both = a.join(b, ["dataset", "epoch"]).groupBy("dataset").agg(F.max("a").alias("newer"), F.max("b").alias("older"), F.max("epoch").alias("cap"))
    sets = log.select("dataset").distinct()
    nan = F.lit(float("nan"))
    return sets.join(both, "dataset", "left").select("dataset", "cap", F.coalesce("newer", nan).alias("newer"), F.coalesce("older", nan).alias("older"), F.coalesce(F.col("newer") - F.col("older"), nan).alias("delta"))


def best_validation(losses: DataFrame, loss: str = "val_loss", keys=("run",)) -> DataFrame:
    """The first epoch of least validation loss."""
    return losses.groupBy(*keys).agg(F.min_by("epoch", F.struct(F.col(loss), F.col("epoch"))).alias("epoch"), F.min(loss).alias(loss))


def running_best(log: DataFrame, value: str = "ap", largest: bool = True, keys=("run", "dataset")) -> DataFrame:
    """Best value so far and whether the epoch improved it strictly."""
    w = Window.partitionBy(*keys).orderBy("epoch")
    best = (F.max if largest else F.min)(value)
    before = best.over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = F.col(value) > before if largest else F.col(value) < before
    return log.withColumns({"best": best.over(w.rowsBetween(Window.unboundedPreceding, 0)), "improved": before.isNull() | better})


def best_by_kind(log: DataFrame, value: str = "ap", ema: str = "is_ema", largest: bool = True, keys=("run", "dataset")) -> DataFrame:
    """Best value and its first epoch of all rows, of those of averaged weights and of the regular ones: kind all, ema, regular."""
    kinds = F.explode(F.array(F.lit("all"), F.when(F.col(ema), "ema").otherwise("regular"))).alias("kind")
    sign = -1 if largest else 1
    first = F.min(F.struct((F.col(value) * sign).alias("v"), F.col("epoch"))).alias("_b")
    return log.select(*keys, "epoch", value, kinds).groupBy(*keys, "kind").agg(first).select(*keys, "kind", (F.col("_b.v") * sign).alias("best_res"), F.col("_b.epoch").alias("best_ep"))


def smoothed(log: DataFrame, value: str = "ap", window: int = 20, keys=("run", "dataset")) -> DataFrame:
    """Over the last values the lower median, mean, largest; the last one and the mean of all so far."""
    w = Window.partitionBy(*keys).orderBy("epoch")
    near = w.rowsBetween(1 - window, 0)
    sorted_ = F.array_sort(F.collect_list(value).over(near))
    median = F.get(sorted_, F.floor((F.size(sorted_) - 1) / 2).cast("int"))
    return log.withColumns({"median": median, "mean": F.avg(value).over(near), "most": F.max(value).over(near), "overall": F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})


def weighted_mean(rows: DataFrame, value: str, weight: str, keys: list[str]) -> DataFrame:
    """Mean over workers or batches by their counts."""
    return rows.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def interpolated(log: DataFrame, value: str = "ap", com: float = 5.0, keys=("run", "dataset")) -> DataFrame:
    """Gaps filled linearly, then exponential smoothing (adjusted weights) along each run, as scans: a log of any size is spread over
    blocks."""
    rows = scans.placed(log.select(*keys, "epoch", value), list(keys), "epoch", value)
    longest = (rows.agg(F.max("_i")).first()[0] or 0) + 1
    full = scans.filled(rows).withColumn("_w", F.when(F.col("_x").isNotNull(), 1.0))
    done = scans.decayed(full, {"_x": "_sum", "_w": "_weight"}, com / (1 + com), longest)
    return done.select(*keys, "epoch", F.col("_x").alias("filled"), (F.col("_sum") / F.nullif(F.col("_weight"), F.lit(0.0))).alias("smooth"))


def pr_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means of precision, recall and score, and F1 of the means."""
    m = rows.groupBy(*keys).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("score").alias("score"))
    return m.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8))


def timings(samples: DataFrame, seconds: str, order: str, warm_up: int, keys: list[str]) -> DataFrame:
    """Statistics of the samples after the first `warm_up`, and frames per second."""
    w = Window.partitionBy(*keys).orderBy(order)
    kept = samples.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > warm_up)
    s = kept.groupBy(*keys).agg(F.avg(seconds).alias("mean"), F.stddev_pop(seconds).alias("std"), F.min(seconds).alias("least"), F.max(seconds).alias("most"))
    return s.withColumn("fps", 1 / F.col("mean"))
