"""J3, J6-J9 by an inverted file of cells, for corpora on which the exact search is too dear.

Index. Centroids are fitted on a bounded sample of the corpus (`SAMPLE` rows, those of the lowest hashes), as many as the square root of the rows
but no more than a sixteenth of the sample. Every row is stored under its `SPILL` nearest centroids; a cell with more than `CELL_ROWS` rows is split into
parts, so rows that are all alike (a third of the corpus) fill no task.

Search. An evaluation frame is dealt to the cells nearest to it, in any of its flips, and meets their rows by an equi-join on (cell, part):
shuffled rows are linear in both sides. The rows that it meets are scored exactly. How many cells it probes is measured, not set:
up to `TRIED` evaluation frames are searched exactly in one pass, and the least number of cells that holds `SHARE` of their true
matches is taken. What the cells leave out is the error of the index; `similarity.top_matches` is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import matrix
from ..functions.store import stored
from . import similarity as S

SAMPLE, ROUNDS, SPILL = 65_536, 8, 2
CELL_ROWS, CELL_EVALS = 8192, 4096
TRIED, SHARE = 128, 0.95


@dataclass
class Index:
    """centroids; rows: key, vector (as searched), cell, part, stored; parts: cell, parts."""

    centroids: np.ndarray
    rows: DataFrame
    parts: DataFrame
    key: str
    vector: str
    masked: bool


def _scaled(v: np.ndarray, masked: bool) -> np.ndarray:
    return S._masked_units(v) if masked else S._units(v)


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids by rounds of assignment and mean; an empty cell keeps its centroid."""
    centre = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([(sample[a : a + 4096] @ centre.T).argmax(1) for a in range(0, len(sample), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(size > 1e-9, total / np.maximum(size, 1e-9), centre)
    return centre


def nearest_cells(v: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, the nearest first."""
    return np.argsort(-(v @ centroids.T), axis=1, kind="stable")[:, :n]


def build(corpus: DataFrame, key: str = "vec_id", vector: str = "v", masked: bool = False, sample: int = SAMPLE, spill: int = SPILL) -> Index:
    spark = corpus.sparkSession
    n = corpus.count()
    drawn = corpus.select(vector).orderBy(F.xxhash64(F.col(key)), key).limit(sample).toArrow()  # no more than the bound
    v = _scaled(matrix(drawn[vector], drawn.num_rows), masked)
    cells = max(1, min(int(n**0.5), len(v) // 16))
    centroids = fit(v, cells) if len(v) else np.zeros((1, 0))
    shared = spark.sparkContext.broadcast(centroids)  # SAMPLE / 16 vectors at most
    spill = min(spill, len(centroids))

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                near = nearest_cells(_scaled(matrix(pa.chunked_array([part.column(1)]), part.num_rows), masked), shared.value, spill)
                at = pa.array(np.repeat(np.arange(part.num_rows), spill))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(near.ravel().astype(np.int32))], [key, vector, "cell"])

    placed = stored(corpus.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector)).mapInArrow(assign, f"{key} long, {vector} array<double>, cell int"), "cells")
    parts = stored(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("parts")), "cell-parts")
    rows = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int")).drop("parts")
    return Index(centroids, rows, parts, key, vector, masked)


def _probed(evals: DataFrame, index: Index, probes: int, grid: tuple[int, int] | None) -> DataFrame:
    """A row per evaluation frame and cell that one of its views is near to: key, vector, cell, place (of the cell, the nearest is 0)."""
    shared = evals.sparkSession.sparkContext.broadcast(index.centroids)
    key, vector, masked = index.key, index.vector, index.masked

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                v = matrix(pa.chunked_array([part.column(1)]), part.num_rows)
                most = np.maximum.reduce([x @ shared.value.T for x in S.views_of(v, grid, masked)])
                cells = np.argsort(-most, axis=1, kind="stable")[:, :probes]
                n = cells.shape[1]
                at = pa.array(np.repeat(np.arange(part.num_rows), n))
                place = np.tile(np.arange(n, dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(cells.ravel().astype(np.int32)), pa.array(place)], [key, vector, "cell", "place"])

    asked = evals.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector))
    return asked.mapInArrow(near, f"{key} long, {vector} array<double>, cell int, place int")


def probes_needed(evals: DataFrame, corpus: DataFrame, index: Index, k: int, grid: tuple[int, int] | None = None, tried: int = TRIED, share: float = SHARE) -> int:
    """Cells that a search must probe to meet the share of the true matches of the tried evaluation frames (those of the lowest hashes)."""
    key = index.key
    some = stored(evals.orderBy(F.xxhash64(F.col(key)), key).limit(tried), "tried")
    true = stored(S.top_matches(some, corpus, k, key, index.vector, grid, index.masked).select("eval_id", key), "true")
    cells = index.rows.join(F.broadcast(true.select(key).distinct()), key).select(key, "cell")  # tried * k ids at most
    places = _probed(some, index, len(index.centroids), grid).select(F.col(key).alias("eval_id"), "cell", "place")
    found = true.join(cells, key).join(places, ["eval_id", "cell"]).groupBy("eval_id", key).agg(F.min("place").alias("place"))
    at = found.agg(F.percentile("place", share)).first()[0]
    return 1 if at is None else min(int(np.ceil(at)) + 1, len(index.centroids))


def top_matches(evals: DataFrame, index: Index, k: int, probes: int, grid: tuple[int, int] | None = None) -> DataFrame:
    """eval_id, key, score, rank as `similarity.top_matches`, among the rows of the probed cells."""
    key = index.key
    asked = _probed(evals, index, probes, grid).drop("place")
    asked = stored(asked, "probed")
    # a cell that many frames probe is met in groups of them
    met = stored(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_EVALS).cast("int").alias("groups")).join(index.parts, "cell"), "probed-cells")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(F.broadcast(met), "cell").select(key, index.vector, "cell", F.pmod(F.xxhash64(key), F.col("groups")).cast("int").alias("group"), every("parts").alias("part"))
    right = index.rows.join(F.broadcast(met), "cell").select(key, index.vector, "cell", "part", every("groups").alias("group"))
    found = S.in_cells(left, right, ["cell", "part", "group"], k, key, index.vector, grid, index.masked)
    once = found.groupBy("eval_id", key).agg(F.max("score").alias("score"))  # a row lies in SPILL cells
    return S.ranked(once, k, key)


def recall(found: DataFrame, true: DataFrame, key: str = "vec_id") -> DataFrame:
    """n_true and recall: the share of the true matches that were found."""
    hit = true.join(found.select("eval_id", key, F.lit(1).alias("_hit")), ["eval_id", key], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_true"), (F.count("_hit") / F.count(F.lit(1))).alias("recall"))
