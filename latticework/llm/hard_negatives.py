"""Hard negatives of anchors from Hilbert-ordered candidate blocks with zone maps.

Candidates. Every vector gets a place on a Hilbert curve through the `DIMS` dimensions that vary most, `BITS` bits each. Rows are dealt by
ranges of it, cut into blocks of `BLOCK` rows along the curve and written as Parquet, a part of the curve per folder. Equal places are told apart by a row
number, so equal vectors are spread over blocks. The zone map of a block holds the least and largest value of every dimension and its labels.

Search. An anchor looks for the first k rows of its own label, or of other labels, whose score lies in a window. Its home chunk
(`CHUNK` blocks along the curve) is read first: the k-th score found there bounds what other blocks must reach. Interval arithmetic on the zone
maps bounds the scores of a block from both sides: those that meet a window, and hold a fitting label, are the blocks that the anchor must
read. Only parts of the curve with such blocks are opened. Positives are one window without ends; each positive then opens the window from `LOW` to 1
of its score. Anchors go in groups of about `GROUP`; a cell is a group and a chunk, in bounded memory, and emits k rows per
window at most.

Defined results: a row takes no part if its id, label or vector is null, a component is null or not finite, or a scaled component
reaches 2**27; missing components count as 0; rows that repeat an id are rows of their own (an anchor meets all rows but its own); equal
scores go to the smaller id; a positive of negative score has an empty window; an anchor without positives or negatives has
no rows, and an empty table none at all. Only the named columns are read, so other names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vectors as V
from .common import materialise, scratch, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative scores at least so many hundredths of its positive, and no more than it.
LOW = 80
DIMS, BITS = 16, 4
#: Rows of a block (a power of two), blocks of a chunk, chunks whose zone maps meet a group of anchors at once, anchors of a group.
BLOCK, CHUNK, ZONES, GROUP = 512, 16, 256, 1024
LEAST, MOST = -(1 << 62), 1 << 62


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (rows x dimensions, values below 2**bits) on the Hilbert curve, as bytes whose order is that of the curve.

    Axes become the transposed place by undoing the excess work of the Gray code, from the high bit down; then the bits are interleaved.
    """
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in range(dims):
            hit = (x[d] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    planes = (x[None] >> np.arange(bits - 1, -1, -1)[:, None, None]) & 1  # high bits first, dimensions in order
    return np.packbits(planes.reshape(bits * dims, -1).T.astype(np.uint8), axis=1)


def _keyed(rows: DataFrame, width: int) -> DataFrame:
    """The rows with their place on the curve and a number, stored."""
    each = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    stats = each.orderBy(F.desc("sd"), "d").limit(DIMS).collect() if width else []  # a few dimensions
    dims = np.array([r.d for r in stats], np.int64)
    mean, sd = (np.array([getattr(r, c) for r in stats]) for c in ("mean", "sd"))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            v = V.matrix(pa.chunked_array([b.column(2)]), b.num_rows)
            if len(dims):
                cells = np.clip((v[:, dims] - mean) / np.maximum(sd, 1e-9) * (1 << (BITS - 2)) + (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)
                keys = [x.tobytes() for x in hilbert(cells, BITS)]
            else:
                keys = [b""] * b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *b.columns], ["place", *b.schema.names])

    return materialise(rows.mapInArrow(place, f"place binary, {', '.join(f'{c} {t}' for c, t in rows.dtypes)}").withColumn("n", F.monotonically_increasing_id()), "places")


def candidates(rows: DataFrame, anchors: Column) -> tuple[DataFrame, int]:
    """Stored candidate blocks: part (a folder), block, at (place in the block), vec_id, label, anchor, v. rows: vec_id, label, v (whole or null)."""
    spark = rows.sparkSession
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select("vec_id", "label", F.coalesce(anchors, F.lit(False)).alias("anchor"), "v")
    good, n, width = V.prepared(good.select("vec_id", "label", "v", "anchor"), "vectors")
    keyed = _keyed(good, width)
    along = keyed.repartitionByRange("place", "n").sortWithinPartitions("place", "n").withColumn("_m", F.monotonically_increasing_id())
    shift = BLOCK.bit_length() - 1
    cut = along.select(F.shiftright("_m", 33).cast("int").alias("part"), F.shiftright("_m", shift).alias("block"), F.col("_m").bitwiseAND(F.lit(BLOCK - 1)).cast("int").alias("at"), "vec_id", "label", "anchor", "v")
    path = scratch(spark, "hilbert-blocks")
    cut.write.partitionBy("part").parquet(path)
    names = [c for c in cut.columns if c != "part"]
    return spark.read.schema(cut.select(*names, "part").schema).parquet(path) if n else cut.where("false"), width


def zone_maps(blocks: DataFrame) -> DataFrame:
    """block, part, chunk, lo, hi (per dimension), labels; stored."""

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            v = V.matrix(pa.chunked_array([b.column(3)]), b.num_rows)
            block = b.column(0).to_numpy()
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
            ends = np.append(first[1:], len(block))
            labels = [np.unique(b.column(2).to_numpy()[a:z]).tolist() for a, z in zip(first, ends)]
            lo, hi = ([f.reduce(v[a:z], axis=0).tolist() for a, z in zip(first, ends)] for f in (np.minimum, np.maximum))
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(labels, pa.list_(pa.int32())), pa.array(lo, pa.list_(pa.int32())), pa.array(hi, pa.list_(pa.int32()))], ["block", "part", "labels", "lo", "hi"])

    parts = blocks.select("block", "part", "label", "v").mapInArrow(partial, "block long, part int, labels array<int>, lo array<int>, hi array<int>")
    # a block that lies in several batches has a few rows here
    both = lambda c, f: F.aggregate(F.collect_list(c), F.get(F.collect_list(c), F.lit(0)), lambda a, b: F.zip_with(a, b, f)).alias(c)
    merged = parts.groupBy("block", "part").agg(F.array_distinct(F.flatten(F.collect_list("labels"))).alias("labels"), both("lo", lambda a, b: F.least(a, b)), both("hi", lambda a, b: F.greatest(a, b)))
    return materialise(merged.withColumn("chunk", F.floor(F.col("block") / CHUNK)), "zone-maps")


#: An anchor: where it lies, its group, label and vector, and the ends of its windows.
ANCHOR = ["a_block", "a_at", "anchor_id", "a_label", "lo", "hi", "q"]
FOUND = "a_block long, a_at int, w int, vec_id long, score long"


def needed(q: np.ndarray, label: np.ndarray, windows: tuple[np.ndarray, np.ndarray], zones: tuple[np.ndarray, np.ndarray, list[list[int]]], same: bool) -> np.ndarray:
    """Whether each anchor must read each block: interval bounds of the scores meet a window, and a label fits."""
    lo, hi, labels = zones
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    most, least = V.products(up, hi) + V.products(down, lo), V.products(up, lo) + V.products(down, hi)
    out = np.zeros(most.shape, bool)
    for a, b in zip(windows[0].T, windows[1].T):
        out |= (most >= a[:, None]) & (least <= b[:, None]) & (a <= b)[:, None]
    of = {x: k for k, x in enumerate(np.unique(label).tolist())}
    has = np.zeros((len(of), len(labels)), bool)
    for k, names in enumerate(labels):
        for x in names:
            if x in of:
                has[of[x], k] = True
    own = has[np.array([of[x] for x in label.tolist()], np.int64)]
    return out & (own if same else np.array([len(x) for x in labels]) - own > 0)


def read_cell(rows: dict, anchors: dict, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First k rows of each anchor's windows in the blocks that it reads: anchor, window, row, score. rows: block, at, vec_id, label, v in block order."""
    got = [[], [], [], []]
    first = np.flatnonzero(np.append(True, rows["block"][1:] != rows["block"][:-1])) if len(rows["block"]) else np.zeros(0, np.int64)
    for a, z in zip(first, np.append(first[1:], len(rows["block"]))):
        block = int(rows["block"][a])
        who = np.flatnonzero((anchors["mask"] >> (block % CHUNK)) & 1)
        if not len(who):
            continue
        score = V.products(anchors["q"][who], rows["v"][a:z])
        fits = (anchors["label"][who][:, None] == rows["label"][None, a:z]) == same
        fits &= ~((anchors["block"][who] == block)[:, None] & (anchors["at"][who][:, None] == rows["at"][None, a:z]))
        for w in range(anchors["lo"].shape[1]):
            inside = fits & (score >= anchors["lo"][who, w][:, None]) & (score <= anchors["hi"][who, w][:, None])
            if z - a > k:  # what k others surpass is out
                held = np.where(inside, score, LEAST)
                inside &= held >= np.partition(held, z - a - k, axis=1)[:, z - a - k][:, None]
            i, j = np.nonzero(inside)
            for out, x in zip(got, (who[i], np.full(len(i), w), j + a, score[i, j])):
                out.append(x)
    who, w, j, score = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in got)
    keep = V.first_k(who * anchors["lo"].shape[1] + w, score, rows["vec_id"][j], k)
    return who[keep], w[keep], j[keep], score[keep]


def _read(rows: DataFrame, anchors: DataFrame, keys: list[str], same: bool, k: int) -> DataFrame:
    """Cells of candidate rows and of the anchors that read them (mask: which blocks of the chunk)."""

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:  # a chunk that no anchor reads
            return V.no_rows(a_block=pa.int64(), a_at=pa.int32(), w=pa.int32(), vec_id=pa.int64(), score=pa.int64())
        left = left.sort_by([("block", "ascending"), ("at", "ascending")])
        own = {c: left[c].to_numpy() for c in ("block", "at", "vec_id", "label")} | {"v": V.matrix(left["v"], left.num_rows)}
        ask = {"block": right["a_block"].to_numpy(), "at": right["a_at"].to_numpy(), "label": right["a_label"].to_numpy(), "mask": right["mask"].to_numpy()} | {c: V.matrix(right[c], right.num_rows) for c in ("q", "lo", "hi")}
        who, w, j, score = read_cell(own, ask, same, k)
        return pa.table({"a_block": ask["block"][who], "a_at": ask["at"][who].astype(np.int32), "w": w.astype(np.int32), "vec_id": own["vec_id"][j], "score": score})

    return rows.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInArrow(cell, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("a_block", "a_at", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(blocks: DataFrame, zones: DataFrame, anchors: DataFrame, groups: int, same: bool, k: int) -> DataFrame:
    """The first k rows of every window: a_block, a_at, w, vec_id, score, rank. anchors: the columns of ANCHOR and group; stored."""
    rows = blocks.select("part", "block", "at", "vec_id", "label", "v", F.floor(F.col("block") / CHUNK).alias("chunk"))
    at_home = anchors.select(*ANCHOR, F.floor(F.col("a_block") / CHUNK).alias("chunk"), F.lit((1 << CHUNK) - 1).cast("long").alias("mask"))
    home = materialise(_read(rows, at_home, ["chunk"], same, k), "home")
    # the k-th score of a window at home is reached by whatever else comes into its first k
    bound = _first(home, k).where(F.col("rank") == k).groupBy("a_block", "a_at").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("b"))
    tight = anchors.join(bound, ["a_block", "a_at"], "left").withColumn("lo", F.transform("lo", lambda x, i: F.greatest(x, F.coalesce(F.element_at("b", i.cast("int")), x)))).drop("b")

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select(["group", *ANCHOR]).slice(0, 0).append_column("chunk", pa.array([], pa.int64())).append_column("part", pa.array([], pa.int32())).append_column("mask", pa.array([], pa.int64()))
        q, lo, hi = (V.matrix(left[c], left.num_rows) for c in ("q", "lo", "hi"))
        maps = [V.matrix(right[c], right.num_rows) for c in ("lo", "hi")]
        must = needed(q, left["a_label"].to_numpy(), (lo, hi), (*maps, right["labels"].to_pylist()), same)
        chunk, block = right["chunk"].to_numpy(), right["block"].to_numpy()
        must &= (left["a_block"].to_numpy() // CHUNK)[:, None] != chunk[None, :]  # read already
        i, j = np.nonzero(must)
        mask = pd.DataFrame({"i": i, "chunk": chunk[j], "bit": 1 << (block[j] % CHUNK), "part": right["part"].to_numpy()[j]}).groupby(["i", "chunk", "part"], as_index=False).bit.sum()
        taken = left.select(["group", *ANCHOR]).take(pa.array(mask.i.to_numpy(np.int64)))
        for name in ("chunk", "part"):
            taken = taken.append_column(name, pa.array(mask[name].to_numpy(np.int64 if name == "chunk" else np.int32)))
        return taken.append_column("mask", pa.array(mask.bit.to_numpy(np.int64)))

    zoned = zones.withColumn("zone", F.floor(F.col("chunk") / ZONES)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = zones.select(F.floor(F.col("chunk") / ZONES).alias("zone")).distinct()
    numbers = [r.zone for r in met.collect()]  # a number per BLOCK * CHUNK * ZONES rows
    asked = materialise(tight, "tight").withColumn("zone", F.explode(F.array(*[F.lit(x).cast("long") for x in numbers])))
    schema = "group int, a_block long, a_at int, anchor_id long, a_label int, lo array<long>, hi array<long>, q array<int>, chunk long, part int, mask long"
    chosen = materialise(asked.groupBy("zone", "group").cogroup(zoned.groupBy("zone", "group")).applyInArrow(choose, schema), "chosen")
    # parts are the folders of the candidates, as many as a shuffle has partitions
    parts = [r.part for r in chosen.select("part").distinct().collect()]
    bits = F.transform(F.sequence(F.lit(0), F.lit(CHUNK - 1)), lambda b: F.when(F.call_function("shiftright", F.col("mask"), b).bitwiseAND(F.lit(1)) == 1, F.col("chunk") * CHUNK + b))
    opened = materialise(chosen.select("group", F.explode(F.filter(bits, lambda x: x.isNotNull())).alias("block")).distinct(), "opened")
    read = rows.where(F.col("part").isin(parts)).join(opened, "block").select("group", "chunk", "block", "at", "vec_id", "label", "v")
    return _first(home.unionByName(_read(read, chosen.select("group", "chunk", "mask", *ANCHOR), ["group", "chunk"], same, k)), k)


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: vec_id long, label int, v (whole numbers or null)."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks, width = candidates(rows, anchors)
    asking = blocks.where("anchor").select(F.col("block").alias("a_block"), F.col("at").alias("a_at"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("a_label"), F.col("v").alias("q"))
    n = asking.count()
    if not n or not width:
        return empty
    groups = -(-n // GROUP)
    zones = zone_maps(blocks)
    end = lambda x: F.array(F.lit(x).cast("long"))
    asking = materialise(asking.select(F.pmod(F.xxhash64("a_block", "a_at"), F.lit(groups)).cast("int").alias("group"), "a_block", "a_at", "anchor_id", "a_label", end(LEAST + 1).alias("lo"), end(MOST).alias("hi"), "q"), "anchors")
    near = materialise(search(blocks, zones, asking, groups, True, positives), "positives")
    # windows in the order of the positives; what is below 0 has none
    ordered = near.groupBy("a_block", "a_at").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
    div = lambda x: F.call_function("div", x, F.lit(100))
    lo = F.transform("p", lambda x: div(x["score"]) * LOW + div(x["score"] % 100 * LOW + 99))  # rounded up, without overflow
    pad = lambda c, x: F.concat(c, F.array_repeat(F.lit(x).cast("long"), positives - F.size("p")))
    windows = ordered.select("a_block", "a_at", pad(lo, 1).alias("lo"), pad(F.transform("p", lambda x: x["score"]), 0).alias("hi"))
    windows = materialise(asking.drop("lo", "hi").join(windows, ["a_block", "a_at"]), "windows")
    hard = search(blocks, zones, windows, groups, False, negatives).select("a_block", "a_at", (F.col("w") + 1).alias("_p"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("rank").alias("rank"))
    said = near.select("a_block", "a_at", F.col("rank").alias("_p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(said, ["a_block", "a_at", "_p"]).join(asking.select("a_block", "a_at", "anchor_id"), ["a_block", "a_at"])
    return out.select(*empty.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    rows = e.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), V.whole(F.col("embedding"), SCALE).alias("v"))
    return mine(rows, F.col("vec_id") % 100 == 0)


SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
