"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Index. Rows are dealt evenly to blocks of `BLOCK`. A component's impact is its size rounded to three significant bits
(exact below 8). A posting segment of a block lists the rows that have one impact and sign in one dimension. The index, with
the rows' exact vectors, is a stored table; a block is built and searched by one task in bounded memory.

Search. Queries are dealt to groups of about `GROUP`; a cell is a block and a group. In a cell the segments are processed by descending
impact, in rounds (the impacts that hold all but 4 %, 1 % and 0 % of the block's squared length). After a round the true score of a pair is the
accumulated one, give or take |query| * |what the segments so far leave of the row|. Pairs that cannot reach the query's
k-th score are out, which is the only proof that ends a search: when few possible members are left they are scored exactly; else the
next round follows. All queries first meet the first `FIRST` blocks, whose k-th scores are lower bounds for the other blocks.
Cells emit at most k rows per query, those that reach its bound; a window keeps the best of all.

Defined results: a row takes no part if its id or vector is null, a component is null or not finite, or a scaled component reaches 2**27; missing
components count as 0, so vectors of unequal length and empty ones meet; rows that repeat an id are rows of their own (a query
meets all rows but its own row, and each of two query rows has its own ranks); equal scores go to the smaller id; an
empty table gives no rows. Only the id, the vector and the query mark are read: names of other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vectors as V
from .common import materialise, table

K = 20
SCALE = 64
BLOCK, GROUP, FIRST = 8192, 2048, 2
#: Share of a block's squared length that is left after each round, and the share of pairs that is scored exactly.
LEFT, FEW = (0.04, 0.01, 0.0), 0.02
#: Queries and pairs at once in a cell.
QUERIES, PAIRS = 256, 16384
INDEX = "block int, impact int, at int, vec_id long, asks boolean, ints array<int>"
NAMES = ["block", "impact", "at", "vec_id", "asks", "ints"]


def impact_of(size: np.ndarray) -> np.ndarray:
    """Impact of the size of a component: itself below 8, then four to each power of two."""
    power = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
    return np.where(size < 8, size, 8 + (power - 3) * 4 + ((size >> np.maximum(power - 2, 0)) & 3))


def value_of(impact: np.ndarray) -> np.ndarray:
    """Middle of the sizes of an impact."""
    power = np.maximum((impact - 8) // 4 + 3, 2)
    low, width = (4 + (impact - 8) % 4) << (power - 2), 1 << (power - 2)
    return np.where(impact < 8, impact, low + (width - 1) / 2)


def segments(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Signed impact, dimension and rows of every segment, by descending impact."""
    row, dim = np.nonzero(v)
    x = v[row, dim]
    impact = impact_of(np.abs(x))
    order = np.lexsort((row, dim, x < 0, -impact))
    row, dim, signed = row[order], dim[order], (impact * np.sign(x))[order]
    cut = np.flatnonzero((np.diff(signed) != 0) | (np.diff(dim) != 0)) + 1 if len(row) else np.zeros(0, np.int64)
    first = np.append(0, cut) if len(row) else cut
    return signed[first], dim[first], np.split(row, cut) if len(row) else []


def _posted(block: int, v: np.ndarray) -> pa.RecordBatch:
    """The segments of a block as rows of the index."""
    signed, dim, slots = segments(v)
    m = len(slots)
    ends = np.append(0, np.cumsum([len(s) for s in slots])).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*slots, np.zeros(0, np.int64)]).astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(np.full(m, block, np.int32)), pa.array(signed.astype(np.int32)), pa.array(dim.astype(np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), lists], NAMES)


def build(rows: DataFrame, id_col: str, vector_col: str, asks: Column, scale: int = SCALE) -> DataFrame:
    """The index: per block its rows (impact null; `at` is the row's slot) and its segments (`at` is the dimension, ints the slots)."""
    base = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(asks, F.lit(False)).alias("asks"), V.whole(F.col(vector_col), scale).alias("v"))
    base, n, _ = V.prepared(base, "vectors")

    def block(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in it if b.num_rows]  # one block
        if batches:
            part = pa.Table.from_batches(batches)
            rows, own = part.num_rows, part["block"][0].as_py()
            fixed = [pa.array(np.full(rows, own, np.int32)), pa.nulls(rows, pa.int32()), pa.array(np.arange(rows, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*fixed, *[part[c].combine_chunks() for c in ("vec_id", "asks", "v")]], NAMES)
            yield _posted(own, V.matrix(part["v"], rows))

    dealt = base.repartition(max(1, -(-n // BLOCK))).select(F.spark_partition_id().alias("block"), "vec_id", "asks", "v")
    return materialise(dealt.mapInArrow(block, INDEX), "score-index")


def _rounds(signed: np.ndarray, dim: np.ndarray, slots: list[np.ndarray], shape: tuple[int, int]) -> list[np.ndarray]:
    """Segments of each round as a matrix of impact values (rows x dimensions)."""
    if not len(signed):
        return [np.zeros(shape, np.float32)]
    value = value_of(np.abs(signed))
    energy = np.array([len(s) for s in slots]) * value**2
    order = np.argsort(-np.abs(signed), kind="stable")
    left = 1 - np.cumsum(energy[order]) / energy.sum()
    out, begin = [], 0
    for share in LEFT:
        end = int(np.searchsorted(-left, -share)) + 1 if share else len(order)
        while end < len(order) and abs(signed[order[end]]) == abs(signed[order[end - 1]]):
            end += 1  # all segments of an impact
        if end > begin:
            m = np.zeros(shape, np.float32)
            for k in order[begin:end]:
                m[slots[k], dim[k]] = value[k] * np.sign(signed[k])
            out.append(m)
            begin = end
    return out


def search_cell(rows: np.ndarray, ids: np.ndarray, rounds: list[np.ndarray], asked: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Members of each query's k best in a block as (query, row, score). own: the query's own row, -1 if it lies elsewhere; bound: score that
    its k-th best has at least."""
    rest, leaves = rows.astype(np.float32), []
    for m in rounds:
        rest = rest - m
        leaves.append(np.linalg.norm(rest, axis=1))
    size = np.linalg.norm(rows.astype(np.float64), axis=1)
    slack = (4e-7 * (rows.shape[1] + 8) * (size + max((x.max(initial=0) for x in leaves), default=0))).astype(np.float32)  # of single precision
    done, pairs = [], {"rounds": 0, "exact": 0, "pairs": 0}
    for a in range(0, len(asked), QUERIES):
        q = asked[a : a + QUERIES]
        mine, least = own[a : a + QUERIES], bound[a : a + QUERIES].astype(np.float64)
        single, length = q.astype(np.float32), np.linalg.norm(q.astype(np.float64), axis=1).astype(np.float32)[:, None]
        elsewhere = mine < 0
        score = np.zeros((len(q), len(rows)), np.float32)
        for m, far in zip(rounds, leaves):
            score += single @ m.T
            reach = length * (far + slack)
            if len(rows) > k:  # k rows have at least the least exact score of those that lead so far
                score[np.flatnonzero(~elsewhere), mine[~elsewhere]] = -np.inf
                lead = np.argpartition(score, len(rows) - k, axis=1)[:, len(rows) - k :]
                least = np.maximum(least, np.einsum("qd,qkd->qk", q, rows[lead]).min(1))
            possible = score + reach >= least[:, None]
            pairs["rounds"] += 1
            if possible.mean() <= FEW:
                break
        possible[np.flatnonzero(~elsewhere), mine[~elsewhere]] = False
        i, j = np.nonzero(possible)
        exact = np.concatenate([(q[i[b : b + PAIRS]] * rows[j[b : b + PAIRS]]).sum(1) for b in range(0, len(i), PAIRS)] or [np.zeros(0, np.int64)])
        pairs["exact"] += len(i)
        pairs["pairs"] += score.size
        keep = np.flatnonzero(exact >= np.where(np.isfinite(least), least, exact.min(initial=0) - 1)[i])
        keep = keep[V.first_k(i[keep], exact[keep], ids[j[keep]], k)]
        done.append((i[keep] + a, j[keep], exact[keep]))
    return *(np.concatenate(x) for x in zip(*done)), pairs


FOUND = "q_block int, q_at int, query_id long, vec_id long, score long"


def _cells(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """index: rows of the index with the number of a group; queries: with the block that they are to meet."""

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return V.no_rows(q_block=pa.int32(), q_at=pa.int32(), query_id=pa.int64(), vec_id=pa.int64(), score=pa.int64())
        posted = left.filter(left["impact"].is_valid())
        own = left.filter(left["impact"].is_null()).sort_by("at")
        rows = V.matrix(own["ints"], own.num_rows)
        slots = np.split(posted["ints"].combine_chunks().flatten().to_numpy() if posted.num_rows else np.zeros(0, np.int64), np.cumsum([len(x) for x in posted["ints"]])[:-1]) if posted.num_rows else []
        rounds = _rounds(posted["impact"].to_numpy(), posted["at"].to_numpy(), slots, rows.shape)
        here = right["block"].to_numpy()[:1]
        at = np.where(right["q_block"].to_numpy() == here, right["q_at"].to_numpy(), -1)
        bound = right["bound"].to_pandas().fillna(-np.inf).to_numpy(np.float64)
        bound = bound - np.abs(bound) * 1e-15  # a long may have been rounded up
        i, j, score, _ = search_cell(rows, own["vec_id"].to_numpy(), rounds, V.matrix(right["ints"], right.num_rows), at, bound, k)
        taken = right.select(["q_block", "q_at", "query_id"]).take(pa.array(i))
        return taken.append_column("vec_id", own["vec_id"].take(pa.array(j))).append_column("score", pa.array(score))

    # either side of a cell is bounded: a block, and a group of about GROUP queries
    return index.groupBy("block", "group").cogroup(queries.groupBy("block", "group")).applyInArrow(cell, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q_block", "q_at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of all rows that ask."""
    asking = index.where("impact IS NULL AND asks").select(F.col("block").alias("q_block"), F.col("at").alias("q_at"), F.col("vec_id").alias("query_id"), "ints")
    blocks, n = index.agg(F.max("block") + 1, F.count_if(F.col("asks"))).first()
    if not n:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups = max(1, -(-n // GROUP))
    asking = materialise(asking.withColumn("group", F.pmod(F.xxhash64("q_block", "q_at"), F.lit(groups)).cast("int")), "queries")
    spread = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(a: int, b: int, queries: DataFrame) -> DataFrame:
        """The queries against blocks a to b - 1."""
        return _cells(spread.where((F.col("block") >= a) & (F.col("block") < b)), queries.withColumn("block", F.explode(F.sequence(F.lit(a), F.lit(b - 1)))), k)

    first = materialise(meet(0, min(FIRST, blocks), asking.withColumn("bound", F.lit(None).cast("long"))), "first-blocks")
    found = first
    if blocks > FIRST:
        bound = _best(first, k).where(F.col("rank") == k).select("q_block", "q_at", F.col("score").alias("bound"))
        found = first.unionByName(meet(FIRST, blocks, asking.join(bound, ["q_block", "q_at"], "left")))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0))


SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""
