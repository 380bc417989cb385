"""Ordered work along keys of any size: a key's rows are cut into runs, which find the state that they begin with by speculation.

A key of at most `RUN_ROWS` rows is one run. The rows of a larger one are dealt to ranges of its order, a run each. A run's first guess is that
nothing came before it; what it ends with is handed to the next run, which repeats its work from there only until both
states agree, since all that follows is then the same. Runs whose beginning changes are repeated, until none does: the result is that of one walk
along the key, whatever the guesses were worth. After that every run knows its beginning, and all runs can be walked at once.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import before, sliced
from .store import stored
from .walk import walk

#: Rows of a key that one task walks along.
RUN_ROWS = 1_000_000


def cut(df: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, bool]:
    """The rows with _slice (the run within the key), _i (place in the key, from 0) and _n (rows of the key), and whether every key is one run."""
    large = stored(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > RUN_ROWS), "large-keys")
    total = large.agg(F.sum("_n")).first()[0]
    if not total:
        own = Window.partitionBy(key)
        return df.withColumns({"_slice": F.lit(0), "_i": F.row_number().over(own.orderBy(*order)).cast("long") - 1, "_n": F.count(F.lit(1)).over(own)}), True
    inside = Window.partitionBy(key, "_slice")
    number = F.row_number().over(inside.orderBy(*order)).cast("long") - 1
    few = F.broadcast(large.select(key))  # a row per RUN_ROWS rows at most
    dealt = sliced(df.join(few, key, "left_semi"), [key], [F.col(c) for c in order], "runs", -(-total // RUN_ROWS))
    offsets = before(dealt, [key], {"_o": F.count(F.lit(1))}).join(F.broadcast(large), key)
    rest = df.join(few, key, "left_anti").withColumn("_slice", F.lit(0)).withColumns({"_i": number, "_n": F.count(F.lit(1)).over(inside)})
    placed = dealt.withColumn("_i", number).join(offsets, [key, "_slice"]).withColumn("_i", F.col("_i") + F.col("_o")).drop("_o")
    return rest.unionByName(placed), False


def runs(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of `cut`."""
    return cut(df, key, order)[0]


#: advance(states, rows of one run) -> states; a state is a whole number or None. In tables they are texts, since pandas would round them.
Advance = Callable[[list, pd.DataFrame], list]


def _said(states: list) -> list:
    return [None if x is None else str(x) for x in states]


def _read(states) -> list:
    return [None if x is None else int(x) for x in states]


def beginnings(rows: DataFrame, key: str, order: list[str], advance: Advance, width: int) -> DataFrame | None:
    """key, _slice, begin (array of `width` states) of every run that is not the first of its key; None if no key has several runs. rows: stored runs."""
    each = rows.where(F.col("_n") > RUN_ROWS).select(key, "_slice").distinct()
    follows = Window.partitionBy(key).orderBy("_slice")
    chain = stored(each.withColumns({"_before": F.lag("_slice").over(follows), "_next": F.lead("_slice").over(follows)}), "chain")
    if chain.isEmpty():
        return None
    kind = dict(rows.dtypes)[key]
    schema = f"{key} {kind}, _slice int, part int, state array<string>"

    def guess(state, pdf):
        part, states = state
        states = advance(states, pdf)
        return (part + 1, states), pd.DataFrame({key: pdf[key].iloc[:1], "_slice": pdf["_slice"].iloc[:1], "part": [part], "state": [_said(states)]})

    def again(state, pdf):
        part, own, guessed, done = state or (0, _read(pdf["_begin"].iat[0]), [None] * width, False)
        for a in range(0, len(pdf), 256):
            if done:
                break
            own, guessed = advance(own, pdf.iloc[a : a + 256]), advance(guessed, pdf.iloc[a : a + 256])
            done = own == guessed
        states = list(pdf["_end"].iat[0]) if done else _said(own)
        return (part + 1, own, guessed, done), pd.DataFrame({key: pdf[key].iloc[:1], "_slice": pdf["_slice"].iloc[:1], "part": [part], "state": [states]})

    def last(found: DataFrame, name: str) -> DataFrame:
        return found.groupBy(key, "_slice").agg(F.max_by("state", "part").alias(name))

    # what the last run of a key ends with is asked by nobody
    asked = rows.join(F.broadcast(chain.where("_next IS NOT NULL").select(key, "_slice")), [key, "_slice"])
    asked = stored(asked, "linked-rows")
    first = stored(last(walk(asked, [key, "_slice"], order, lambda: (0, [None] * width), guess, schema), "end"), "guesses")
    ends, used = first, None
    while True:
        given = chain.where("_before IS NOT NULL").select(key, "_slice", F.col("_before").alias("_b"))
        given = given.join(ends.select(key, F.col("_slice").alias("_b"), F.col("end").alias("begin")), [key, "_b"]).drop("_b")
        given = stored(given, "beginnings")
        changed = given if used is None else given.join(used.withColumnRenamed("begin", "_u"), [key, "_slice"]).where(~F.col("begin").eqNullSafe(F.col("_u"))).drop("_u")
        todo = stored(changed.join(first.withColumnRenamed("end", "_end"), [key, "_slice"]).withColumnRenamed("begin", "_begin"), "todo")
        if todo.isEmpty():
            return given
        redone = last(walk(asked.join(F.broadcast(todo), [key, "_slice"]), [key, "_slice"], order, lambda: None, again, schema), "_new")
        ends = stored(ends.join(redone, [key, "_slice"], "left").select(key, "_slice", F.coalesce("_new", "end").alias("end")), "ends")
        used = given


def walk_runs(
    rows: DataFrame, key: str, order: list[str], advance: Advance, width: int, step: Callable[[list, pd.DataFrame], tuple[list, pd.DataFrame]], schema, whole: bool = False
) -> DataFrame:
    """step(states, rows of one run) -> (states, output rows) along every key, all runs at once. whole: every key is one run, so nothing is guessed,
    and rows that are dealt out by key stay where they are."""
    begin = None if whole else beginnings(rows, key, order, advance, width)
    none = F.lit(None).cast("array<string>")
    rows = rows.withColumn("begin", none) if begin is None else rows.join(F.broadcast(begin), [key, "_slice"], "left")

    def run(state, pdf):
        if state is None:
            given = pdf["begin"].iat[0]
            state = [None] * width if given is None else _read(given)
        return step(state, pdf)

    return walk(rows, [key] if whole else [key, "_slice"], order, lambda: None, run, schema)
