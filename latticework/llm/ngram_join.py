"""N-gram Jaccard self-join of documents with Bayesian pruning of candidates.

1. Every text becomes the set of its five-word shingles. Texts with equal sets form a copy class (128-bit digest of the set): one
   representative goes on, so thousands of copies cost one row.
2. A representative's MinHash signature is cut into `BANDS` bands of `ROWS` values. Texts of similarity 0.8 share no band
   with probability (1 - 0.8**6)**48 = 5e-7. Classes alone in all their band buckets are done.
3. The others are dealt to blocks of about `BLOCK` members. A class lives with the lowest class that it shares a bucket with, so near
   copies have one block or few; a block that would be larger is split by hash. Two blocks are compared if some
   bucket has members of both, once, however many buckets do: every pair that shares a bucket is compared exactly once, and
   chains of chance buckets between unlike texts bring no further blocks together.
4. In a task of two blocks, MinHash values are compared in steps, a pair is dropped once the posterior probability of reaching
   the threshold falls below `TOLERANCE`, and the remaining pairs are verified exactly on their shingle sets. Pairs are counted where they are
   compared; what leaves a task is one row per member.

Result per document: copy_id (lowest doc_id of equal shingle sets), class_id (lowest doc_id of the documents that links
connect), n_links (other documents at the threshold or above, copies included), n_class_links (linked copy classes), class_key (names
the class where all its ids are null, too).

Defined results: a null or empty text, or one of white space only, has no shingles and is a class of its own without
links, key null; a text of one to four words has one shingle of all its words; rows that repeat a doc_id are counted as documents
(classes are keyed by the digest of their shingles, so different texts of one doc_id, null too, stay apart); a null doc_id comes
after all others, so copy_id and class_id are null only where all ids of the class are; a text of any length is one set of shingles; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles as S
from .common import materialise, table

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 6, 48
#: MinHash values that the Bayesian comparison may use, and how many it reads at a step.
COMPARED, STEP = 256, 32
TOLERANCE = 1e-7
BLOCK = 128
#: Stands for a null doc_id inside the join.
NO_DOC = (1 << 63) - 1

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)


def sets_of(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    first, hashes, _, _ = S.words(texts)
    begin, all_shingles = S.shingles(first, hashes, SHINGLE)
    return [np.unique(all_shingles[a:b]) for a, b in zip(begin[:-1], begin[1:])]


def signature(one: np.ndarray) -> np.ndarray:
    """MinHash values of a set, without a Python loop over shingles; long sets go in parts that fit the cache."""
    low = (one >> np.uint64(32)).astype(np.uint32)
    out = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 512):
        np.minimum(out, (low[k : k + 512, None] * _MUL + _ADD).min(axis=0), out=out)
    return out


def band_buckets(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band of a signature."""
    summed = (sig.reshape(BANDS, ROWS).astype(np.uint64) * S._FACTORS[:ROWS]).sum(1) + np.arange(BANDS, dtype=np.uint64)
    return S.mix(summed).view(np.int64)


@lru_cache
def least_matches(threshold: float = THRESHOLD) -> np.ndarray:
    """Per step: the fewest equal values for which P(similarity >= threshold | data) is at least TOLERANCE, uniform prior."""
    out = []
    for n in range(STEP, COMPARED + 1, STEP):
        tail, m = 0.0, -1  # P(Binomial(n + 1, threshold) <= m) is the posterior after m matches of n
        while tail < TOLERANCE:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def _place(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: the doc_id and a 128-bit hash of the text. Rows equal in all have one text."""
    text = F.col(text_col)
    return [F.coalesce(F.col(id_col), F.lit(NO_DOC)).cast("long").alias("doc_id"), F.xxhash64(text).alias("m1"), F.xxhash64(F.lit(1), text).alias("m2")]


def digest(one: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingles, as two signed integers."""
    a = np.bitwise_xor.reduce(S.mix(one)) ^ np.add.reduce(one)
    b = np.add.reduce(S.mix(one ^ np.uint64(0x94D049BB133111EB)))
    return int(a.view(np.int64)), int(b.view(np.int64))


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, marks of the text, digest of the shingle set, band buckets; no shuffle. A text without words has a null digest."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in it for part in S.slices(whole, 3)):
            sets = sets_of(b.column(3))
            both = [digest(s) if len(s) else (None, None) for s in sets]
            flat = [band_buckets(signature(s)) for s in sets if len(s)]
            ends = np.concatenate([[0], np.cumsum([BANDS if len(s) else 0 for s in sets])])
            buckets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
            halves = [pa.array([x[k] for x in both], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *halves, buckets], ["doc_id", "m1", "m2", "d1", "d2", "buckets"])

    base = docs.select(*_place(id_col, text_col), F.col(text_col).alias("text"))
    return base.mapInArrow(batches, "doc_id long, m1 long, m2 long, d1 long, d2 long, buckets array<long>")


def _signed(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The members (rep, m1, m2 and their other columns) with sig and shingles, both little-endian bytes, from the text of the row (rep, m1, m2)."""
    base = docs.select(*_place(id_col, text_col), F.col(text_col).alias("text")).withColumnRenamed("doc_id", "rep")
    key = ["rep", "m1", "m2"]
    names = [c for c in members.columns if c not in key]
    # rows equal in id and text give one member; the join has dealt and sorted them by these keys
    chosen = base.join(members.hint("shuffle_merge"), key).dropDuplicates(key).select("text", "rep", *names)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in S.slices(b, 0):
                sets = sets_of(part.column(0))
                sigs = pa.array([signature(s)[:COMPARED].tobytes() for s in sets], pa.binary())
                flat = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], sigs, flat], ["rep", *names, "sig", "shingles"])

    return chosen.mapInArrow(batches, ", ".join(f"{c} {t}" for c, t in chosen.dtypes if c != "text") + ", sig binary, shingles binary")


def components(edges: DataFrame, label: str) -> DataFrame:
    """a, comp: lowest node connected to each node, for edges (a, b). Each round is a table in the shared folder."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), label)
    now = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")), label)
    while True:
        near = both.join(now.select(F.col("a").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = now.join(near, "a").select("a", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        step = materialise(step, label)
        jump = step.join(step.select(F.col("a").alias("c"), F.col("comp").alias("far")), step.comp == F.col("c"), "left")
        new = materialise(jump.select("a", F.least("comp", F.coalesce("far", "comp")).alias("comp"), "was"), label)
        if new.where("comp <> was").limit(1).count() == 0:
            return new.select("a", "comp")
        now = new.select("a", "comp")


def _local_groups(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Lowest index connected to each of n indexes."""
    label = np.arange(n)
    while links:
        before = label.copy()
        for a, b in links:
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def compare(sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions (one of left, one of right, each pair once) whose exact similarity reaches the threshold."""
    same = left is right
    i, j = np.triu_indices(len(left), 1) if same else (g.ravel() for g in np.indices((len(left), len(right))))
    i, j = left[i], right[j]
    size = np.array([len(s) for s in sets])
    ok = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
    i, j = i[ok], j[ok]
    matches = np.zeros(len(i), np.int32)
    for k, least in enumerate(least_matches(threshold)):
        for p in range(0, len(i), 1 << 16):
            q = slice(p, p + (1 << 16))
            matches[q] += (sigs[i[q], k * STEP : (k + 1) * STEP] == sigs[j[q], k * STEP : (k + 1) * STEP]).sum(1, dtype=np.int32)
        ok = matches >= least
        i, j, matches = i[ok], j[ok], matches[ok]
    common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    ok = common >= threshold * (size[i] + size[j] - common) - 1e-9
    return i[ok], j[ok]


def _compare_group(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # a block that meets itself comes once; members in the order of the classes
        pdf = pdf.drop_duplicates(["d1", "d2"]).sort_values(["rep", "d1", "d2"])
        ids, n = pdf.rep.to_numpy(), len(pdf)
        sigs = np.frombuffer(b"".join(pdf.sig), np.uint32).reshape(n, COMPARED)
        sets = [np.frombuffer(x, np.uint64) for x in pdf.shingles]
        members = pdf.members.to_numpy()
        x, y = int(pdf.x.iloc[0]), int(pdf.y.iloc[0])
        left = np.flatnonzero(pdf.block.to_numpy() == x)
        right = left if x == y else np.flatnonzero(pdf.block.to_numpy() == y)
        i, j = compare(sigs, sets, left, right, threshold)
        links = np.bincount(i, members[j], n) + np.bincount(j, members[i], n)
        kinds = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        low = _local_groups(n, [(i, j)] if len(i) else [])
        keys = {c: pdf[c].to_numpy() for c in ("rep", "d1", "d2")}
        out = keys | {"alone": pdf.alone.to_numpy(), "links": links.astype("int64"), "kinds": kinds.astype("int64")}
        return pd.DataFrame(out | {f"low_{c}": v[low] for c, v in keys.items()})[lambda o: (o.links > 0) | (o.kinds > 0)]

    return run


def _compared(classes: DataFrame) -> DataFrame:
    """d1, block, alone, pairs: the block of each class that shares a bucket, and the block pairs (x, y) in which its block is compared.

    The lower half of the digest is name enough here: classes that share it share a block.
    """
    bands = classes.select("d1", F.explode("buckets").alias("bucket"))
    heads = bands.groupBy("bucket").agg(F.min("d1").alias("head"), F.max("d1").alias("last")).where("head <> last").select("bucket", "head")
    shared = materialise(bands.join(heads, "bucket").select("d1", "bucket", "head").distinct(), "shared-buckets")
    home = shared.groupBy("d1").agg(F.min("head").alias("home"))
    sizes = home.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block = F.xxhash64("home", F.pmod(F.xxhash64("d1", F.lit(7)), "blocks")).alias("block")
    placed = materialise(home.join(sizes, "home").select("d1", block), "blocks")
    seen = shared.join(placed, "d1").select("bucket", "block").distinct()
    ends = seen.groupBy("bucket").agg(F.min("block").alias("x"), F.max("block").alias("y"))
    one = ends.where("x = y").select("x", "y")
    many = materialise(seen.join(ends.where("x <> y").select("bucket"), "bucket"), "bucket-blocks")
    two = many.withColumnRenamed("block", "x").join(many.withColumnRenamed("block", "y"), "bucket").where("x <= y").select("x", "y")
    pairs = materialise(one.union(two).distinct(), "block-pairs")
    pair = F.struct("x", "y")
    of_block = pairs.select(F.col("x").alias("block"), pair.alias("pair")).union(pairs.where("x <> y").select(F.col("y").alias("block"), pair.alias("pair")))
    lists = of_block.groupBy("block").agg(F.collect_list("pair").alias("pairs"))
    return placed.join(lists, "block").select("d1", "block", (F.size("pairs") == 1).alias("alone"), "pairs")


def _linked(docs: DataFrame, text_col: str, id_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The stored rows of _classes, and per digest: its lowest row (rep, m1, m2), members, links, kinds, and low, the lowest (rep, d1, d2) of
    the copy classes that links connect."""
    classes = materialise(_classes(docs, id_col, text_col), "classes")
    first = F.min(F.struct("doc_id", "m1", "m2"))
    reps = classes.where("d1 IS NOT NULL").groupBy("d1", "d2").agg(first.alias("first"), F.count(F.lit(1)).alias("members"))
    reps = reps.select("d1", "d2", F.col("first.doc_id").alias("rep"), F.col("first.m1").alias("m1"), F.col("first.m2").alias("m2"), "members")
    dealt = materialise(_compared(classes).join(reps, "d1"), "dealt")
    signed = _signed(docs, dealt, id_col, text_col).withColumn("pair", F.explode("pairs")).select("*", "pair.x", "pair.y").drop("pair", "pairs")
    schema = "rep long, d1 long, d2 long, alone boolean, links long, kinds long, low_rep long, low_d1 long, low_d2 long"
    found = materialise(signed.groupBy("x", "y").applyInPandas(_compare_group(threshold), schema), "links")
    own, low = F.struct("rep", "d1", "d2"), F.struct(F.col("low_rep").alias("rep"), F.col("low_d1").alias("d1"), F.col("low_d2").alias("d2"))
    counts = found.groupBy("d1", "d2").agg(F.sum("links").alias("links"), F.sum("kinds").alias("kinds"), F.min(low).alias("low"))
    # members of a block that meets no other know their class; those of others get it from the links between blocks
    wide = found.where("NOT alone AND (low_d1 <> d1 OR low_d2 <> d2)").select(own.alias("a"), low.alias("b"))
    if wide.limit(1).count():
        joined = components(wide, "wide").select(F.col("a.d1").alias("d1"), F.col("a.d2").alias("d2"), "comp")
        counts = counts.join(joined, ["d1", "d2"], "left").select("d1", "d2", "links", "kinds", F.coalesce("comp", "low").alias("low"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return classes, reps.join(counts, ["d1", "d2"], "left").select("d1", "d2", "rep", "m1", "m2", "members", F.coalesce("low", own).alias("low"), zero("links"), zero("kinds"))


def join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, copy_id, class_id, n_links, n_class_links, class_key."""
    classes, per_class = _linked(docs, text_col, id_col, threshold)
    # stored, so that the join below has both sides as they come and adaptive execution can split a class of very many copies
    per_class = materialise(per_class, "per-class")
    out = classes.select("doc_id", "d1", "d2").join(per_class, ["d1", "d2"], "left")
    real = lambda c, name: F.nullif(c, F.lit(NO_DOC)).alias(name)
    return out.select(
        real(F.col("doc_id"), "doc_id"),
        real(F.coalesce("rep", "doc_id"), "copy_id"),
        real(F.coalesce("low.rep", "doc_id"), "class_id"),
        F.coalesce(F.col("members") - 1 + F.col("links"), F.lit(0)).alias("n_links"),
        F.coalesce("kinds", F.lit(0)).alias("n_class_links"),
        F.concat(F.lpad(F.hex("low.d1"), 16, "0"), F.lpad(F.hex("low.d2"), 16, "0")).alias("class_key"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the lowest row of the lowest copy class stays (by doc_id, then text), whatever ids other texts have;
    texts without words stay. Of rows equal in id and text the lowest one stays."""
    classes, per_class = _linked(docs, "text", "doc_id", THRESHOLD)
    kept = per_class.where("low.d1 = d1 AND low.d2 = d2").select(F.col("rep").alias("doc_id"), "m1", "m2")
    kept = kept.union(classes.where("d1 IS NULL").select("doc_id", "m1", "m2").distinct())
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = docs.select(*_place("doc_id", "text"), row).join(kept, ["doc_id", "m1", "m2"], "left_semi")
    return rows.groupBy("doc_id", "m1", "m2").agg(F.min("row").alias("row")).select("row.*")
