"""Two-pass external shuffle of records into shards.

Pass 1 scatters the records over memory-sized buckets by a seeded hash of the whole row. Equal rows would all fall into one bucket, so a
row with more than `COPIES` of them is kept once with its count, and its copies, being the same in every column, are made anew with
their numbers and scattered by hash and number. Pass 2 orders each bucket by content, applies a Fisher-Yates shuffle
seeded by the bucket, and writes it. The buckets one after the other are one random permutation of all records: position = records in earlier
buckets + place in the bucket.

Law `rows`: shard = position mod shards, slot = position div shards. Shard counts differ by one at most, slots have no
gaps, and every shard is a uniform sample in random order. Equal texts need not share a shard.

The number of buckets grows with the input (`BUCKET_BYTES` of text each), so a bucket always fits a task; only the
bucket counts (a row per bucket) are summed up in order. Results do not depend on partitions or retries.

Defined results: a null text has size 1 and the CRC-32 of the empty text; a null doc_id is an id like any other;
equal rows are kept, each with a slot of its own (their order among themselves does not show); extra columns are
written along; `shard` and `slot` get `_` added until their names are free; a text of any length is one record, alone in its
bucket if it fills it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, materialise, scratch, table

SHARDS = 16
SEED = 1977
BUCKET_BYTES = 24 << 20
#: Equal rows that may share a bucket as they are, and copies that are made anew in one run.
COPIES, RUN = 8, 4096


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of n: from the last place down, swap with a place drawn from those not yet fixed."""
    order = np.arange(n)
    draws = (np.random.default_rng(seed).random(n) * np.arange(1, n + 1)).astype(np.int64)
    swap = order.tolist()
    for i, j in zip(range(n - 1, 0, -1), draws[:0:-1].tolist()):
        swap[i], swap[j] = swap[j], swap[i]
    return np.array(swap, np.int64)


def bucket_count(docs: DataFrame, text_col: str = "text") -> int:
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 64)).first()[0] or 0
    return max(1, -(-total // BUCKET_BYTES))


def scattered(docs: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Pass 1: `row` (a struct of all columns), bucket, and k, k2: content keys that order a bucket."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # a null leaves a hash as it was, so it is hashed as a flag, too
    parts = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.isnull(f"`{c}`"))]
    keyed = docs.select(row.alias("row"), F.xxhash64(F.lit(seed), *parts).alias("k"), F.xxhash64(F.lit(~seed), *parts).alias("k2"))
    often = materialise(keyed.groupBy("k", "k2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COPIES), "often")
    rare = keyed.join(often, ["k", "k2"], "left_anti").withColumn("copy", F.lit(0).cast("long"))
    once = keyed.join(often, ["k", "k2"], "left_semi").groupBy("k", "k2").agg(F.first("row").alias("row")).join(often, ["k", "k2"])
    # numbers of copies in runs, so that no task makes all copies of a very common row
    runs = once.select("row", "k", "k2", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))).alias("run")).repartition("k", "run")
    made = runs.select("row", "k", "k2", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)).alias("copy"))
    all_ = rare.select("row", "k", "k2", "copy").unionByName(made)
    key = F.when(F.col("copy") == 0, F.col("k")).otherwise(F.xxhash64("k", "copy"))
    return all_.select("row", key.alias("k"), "k2").withColumn("bucket", F.pmod("k", F.lit(buckets)).cast("int"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, text_col: str = "text") -> None:
    """Shuffle the rows and write them as Parquet by shard, in slot order within each file, with shard and slot."""
    buckets = bucket_count(docs, text_col)
    spread = scattered(docs, buckets, seed)
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    rows = spread.join(F.broadcast(before) if buckets <= 100_000 else before, "bucket")
    shard, slot = (free_name(docs.columns, x) for x in ("shard", "slot"))

    def shuffled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = pa.Table.from_batches(list(it)).sort_by([("k", "ascending"), ("k2", "ascending")])
        n = bucket.num_rows
        order = fisher_yates(n, seed * 1_000_003 + bucket["bucket"][0].as_py())
        at = bucket["before"].to_numpy() + np.arange(n)
        records = bucket["row"].combine_chunks()
        records = records if isinstance(records, pa.Array) else records.chunk(0)
        out = pa.Table.from_batches([pa.RecordBatch.from_struct_array(records)]).take(pa.array(order))
        out = out.append_column(slot, pa.array(at // shards)).append_column(shard, pa.array((at % shards).astype(np.int32)))
        out = out.take(pa.array(np.lexsort((at // shards, at % shards))))
        yield from out.to_batches(max_chunksize=4096)

    schema = docs.withColumns({slot: F.lit(0).cast("long"), shard: F.lit(0)}).schema
    rows.groupBy("bucket").applyInArrow(shuffled, schema).write.partitionBy(shard).parquet(path)


def read(spark: SparkSession, path: str, shard: int | None = None, shard_col: str = "shard") -> DataFrame:
    """The rows of a shard or of all; a shard's order is that of slot."""
    rows = spark.read.parquet(path)
    return rows if shard is None else rows.where(F.col(shard_col) == shard)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch(spark, "shards")
    write(docs, path)
    schema = docs.withColumns({"slot": F.lit(0).cast("long"), "shard": F.lit(0)}).schema
    text = F.coalesce("text", F.lit(""))
    return spark.read.schema(schema).parquet(path).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
