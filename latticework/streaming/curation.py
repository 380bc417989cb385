"""Streaming forms of two batch operators that carry a state per key: last-kept decimation and the running best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.kernels import decimate


def decimate_stream(frames: DataFrame, threshold: int) -> DataFrame:
    """Frames of each scan in order of arrival batches, by frame_idx inside a batch; the last kept hash is the state."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(batches).sort_values(["frame_idx", "ord"])
        keep, last = decimate(pdf["phash"].to_numpy(), threshold, state.get[0] if state.exists else None)
        if last is not None:
            state.update((last,))
        yield pdf[["key", "scan", "frame_idx"]].assign(kept=keep)

    narrow = frames.select("scan", "key", "frame_idx", "ord", "phash")
    return narrow.groupBy("scan").applyInPandasWithState(run, "key string, scan string, frame_idx long, kept boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def running_best_stream(log: DataFrame) -> DataFrame:
    """Best ap so far of each run, one row per epoch that improves it."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(batches).sort_values("epoch")
        best = state.get[0] if state.exists else -np.inf
        before = np.maximum.accumulate(np.concatenate([[best], pdf["ap"].to_numpy()]))
        better = pdf["ap"].to_numpy() > before[:-1]
        state.update((float(before[-1]),))
        yield pdf.loc[better, ["run", "epoch", "ap"]]

    return log.select("run", "epoch", "ap").groupBy("run").applyInPandasWithState(run, "run string, epoch long, ap double", "best double", "append", GroupStateTimeout.NoTimeout)
