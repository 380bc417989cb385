"""Searches by Hamming distance with a multi-index table.

A 64-bit hash has four keys, its 16-bit quarters. Two hashes that differ in at most 4 r + 3 bits have a quarter that differs in at most r,
so a query that asks for its quarters with every change of at most r bits meets all hashes within 4 r + 3 by equi-joins. A
pair that several quarters bring together counts at the first one.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.store import stored
from .curation import hamming

QUARTERS, BITS = 4, 16
#: Bits changed in the first round of the nearest search, and how many more in each later one.
FIRST, MORE = 2, 2


def changes(radii: range) -> list[int]:
    """All 16-bit words with so many bits set."""
    return [sum(1 << b for b in at) for r in radii for at in combinations(range(BITS), r)]


def _quarter(hash_col: str, k: int) -> Column:
    return F.shiftrightunsigned(hash_col, BITS * k).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def table(hashes: DataFrame, hash_col: str) -> DataFrame:
    """A row per hash and quarter: q, value."""
    parts = F.array(*[F.struct(F.lit(k).alias("q"), _quarter(hash_col, k).alias("value")) for k in range(QUARTERS)])
    return hashes.select(*hashes.columns, F.inline(parts))


def probes(hashes: DataFrame, hash_col: str, radii: list[range]) -> DataFrame:
    """A row per hash, quarter and change of that quarter: q, value. radii: bits changed in each quarter."""
    out = None
    for words in {r: [k for k in range(QUARTERS) if radii[k] == r] for r in radii}.items():
        if not words[0]:  # these quarters are not asked for
            continue
        changed = F.explode(F.split(F.lit(",".join(map(str, changes(words[0])))), ",").cast("array<int>"))  # one literal, folded once
        parts = F.inline(F.array(*[F.struct(F.lit(k).alias("q"), _quarter(hash_col, k).alias("_own")) for k in words[1]]))
        rows = hashes.select(*hashes.columns, parts).withColumn("_c", changed)
        rows = rows.select(*hashes.columns, "q", F.col("_own").bitwiseXOR(F.col("_c")).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _met(asked: DataFrame, quarters: DataFrame) -> DataFrame:
    """Probes with the quarters that they ask for. Spark takes a query's thousands of probes for one row and would collect them for a broadcast:
    both sides are dealt out instead, and a task builds its table from the quarters, four rows per hash."""
    return asked.join(quarters.hint("shuffle_hash"), ["q", "value"])


def _earlier(a: str, b: str, most: list[int]) -> Column:
    """Whether a quarter before q is within its radius, too."""
    hit = F.lit(False)
    for k in range(QUARTERS - 1):
        near = F.bit_count(_quarter(a, k).bitwiseXOR(_quarter(b, k))) <= most[k]
        hit = hit | ((F.col("q") > k) & near)
    return hit


def within(a: DataFrame, b: DataFrame, radius: int, key: str = "vec_id", hash_col: str = "phash") -> DataFrame:
    """All pairs of a and b within the radius, other than of one key: a, b, distance. Equal hashes of b meet as one.

    The first quarters may differ in radius // 4 bits, and those after the (radius mod 4 + 1)-th in one less.
    """
    most = [radius // QUARTERS - (k > radius % QUARTERS) for k in range(QUARTERS)]
    radii = [range(0, m + 1) for m in most]
    left = probes(a.select(F.col(key).alias("a"), F.col(hash_col).alias("_a")), "_a", radii)
    right = table(b.select(F.col(hash_col).alias("_b")).distinct(), "_b")
    met = _met(left, right).where(~_earlier("_a", "_b", most)).withColumn("distance", hamming("_a", "_b")).where(F.col("distance") <= radius)
    found = met.select("a", "_b", "distance").join(b.select(F.col(key).alias("b"), F.col(hash_col).alias("_b")), "_b")
    return found.where(F.col("a") != F.col("b")).select("a", "b", "distance")


def nearest(evals: DataFrame, corpus: DataFrame, key: str = "vec_id", order: str = "frame_idx", hash_col: str = "phash") -> DataFrame:
    """The corpus frame of least distance, other than itself, for each evaluation frame, the first in order of several: eval_id, key, distance.

    Rounds change more and more bits; a query leaves once its best distance is proven. After 16 bits every hash has been met.
    """
    first = F.row_number().over(Window.partitionBy(hash_col).orderBy("place", key))
    rows = corpus.select(F.col(key), F.col(order).cast("long").alias("place"), F.col(hash_col))
    two = rows.withColumn("_n", first).where("_n <= 2").drop("_n")  # of equal hashes the first counts, or the second for the first itself
    right = stored(table(two.select(F.col(hash_col).alias("_b"), key, "place"), "_b"), "quarters")
    left = stored(evals.select(F.col(key).alias("eval_id"), F.col(hash_col).alias("_a")), "asked")
    best, done, r = None, left, FIRST
    while True:
        asked = probes(done, "_a", [range(0 if r == FIRST else r - MORE + 1, min(r, BITS) + 1)] * QUARTERS)
        met = _met(asked, right).where(F.col("eval_id") != F.col(key)).withColumn("distance", hamming("_a", "_b").cast("long"))
        found = met.select("eval_id", F.struct("distance", "place", key).alias("r"))
        found = (found if best is None else found.unionByName(best)).groupBy("eval_id").agg(F.min("r").alias("r"))
        best = stored(found, "nearest")
        proven = best.where(F.col("r.distance") <= QUARTERS * r + QUARTERS - 1).select("eval_id")
        done = stored(left.join(proven, "eval_id", "left_anti"), "unproven")
        if r >= BITS or done.isEmpty():
            return best.select("eval_id", f"r.{key}", "r.distance")
        r += MORE
