"""Sequential work per key without holding a key's rows in memory, and bounded groups without a call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def laid_out(df: DataFrame, keys: list[str], order: list, by: list[str] | None = None) -> DataFrame:
    """Rows of a key in one partition, in order; sorting spills, so a large key needs no memory of its size."""
    return df.repartition(*(by or keys)).sortWithinPartitions(*keys, *order)


def gathered(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """As `laid_out`, with a column `_place`; rows that lie together by key already are not shuffled again, since a window asks for no more than that."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).sortWithinPartitions(*keys, *order)


def walk(df: DataFrame, keys: list[str], order: list, start: Callable[[], object], step: Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]], schema) -> DataFrame:
    """Carry a small state along each key's rows. step(state, rows of one key) -> (state, output rows); a key may come in parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            same = np.ones(len(pdf), bool)
            for k in keys:
                v = pdf[k].to_numpy()
                same[1:] &= v[1:] == v[:-1]
            cuts = [0, *np.flatnonzero(~same[1:]) + 1, len(pdf)]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                key = tuple(pdf[k].iat[a] for k in keys)
                if key != last:
                    last, state = key, start()
                state, rows = step(state, pdf.iloc[a:b])
                out.append(rows)
            yield pd.concat(out)

    return laid_out(df, keys, order).mapInPandas(run, schema)


def begins(*keys: np.ndarray) -> np.ndarray:
    """The first row of each key, of rows in order of the keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for v in keys:
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def groups(
    df: DataFrame, keys: list[str], order: list, fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema, many: bool = False, by: list[str] | None = None, together: bool = False
) -> DataFrame:
    """Apply fn to each key's rows, for keys of bounded size (boxes of an image); many keys share one Python call.

    fn takes and returns a dict of equally long numpy columns; many: of all rows of several keys. by: some of the keys, if the rows are dealt out by them
    already. together: the rows of a key may lie together already (`gathered`).
    """

    def applied(columns: dict[str, np.ndarray], cuts: list[int]) -> pd.DataFrame:
        if many:
            return pd.DataFrame(fn({c: v[: cuts[-1]] for c, v in columns.items()}))
        out = [fn({c: v[a:b] for c, v in columns.items()}) for a, b in zip(cuts[:-1], cuts[1:])]
        return pd.DataFrame({c: np.concatenate([o[c] for o in out]) for c in out[0]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), bool)
            for k in keys:
                v = pdf[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            cuts = [0, *np.flatnonzero(new)]
            held = pdf.iloc[cuts[-1] :]
            if len(cuts) > 1:
                yield applied({c: pdf[c].to_numpy() for c in pdf.columns}, cuts)
        if held is not None and len(held):
            yield applied({c: held[c].to_numpy() for c in held.columns}, [0, len(held)])

    return (gathered(df, keys, order) if together else laid_out(df, keys, order, by)).mapInPandas(run, schema)
