"""Token ids in files of range-coded blocks.

Documents are sorted by doc_id over range partitions; each partition is a part of the file, cut into blocks of at most
`BLOCK_IDS` ids. A block is coded alone from a reset state and carries a CRC-32 of its ids, its first id's position in the
part, and the pieces of documents it holds. Blocks are rows of Parquet (one file per part), so the format works on any
store that Spark reads and a reader may take any subset of blocks.

Row of the file: part, block, first (ids of the part before it), n_ids, crc, docs (doc_id, pos: place in the part, seq: piece
of the document, last, n), payload (coded ids).

Defined results: a null text counts as empty and has the end id only; a null doc_id comes first; rows with one doc_id
follow each other, shorter text first, and are separate documents (key: part, position in the part); a long text is cut into pieces over blocks; an empty
table gives an empty file; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import bpe, range_coder
from .common import scratch, table

#: Ids of a block, at most: what a reader must decode at least, and a task holds at once.
BLOCK_IDS = 1 << 22
END_ID = 2

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("last", T.BooleanType()), T.StructField("n", T.IntegerType())])
FILE = T.StructType(
    [T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n_ids", T.IntegerType()), T.StructField("crc", T.LongType()), T.StructField("docs", T.ArrayType(DOC)), T.StructField("payload", T.BinaryType())]
)
_ARROW_DOC = pa.struct([("doc_id", pa.int64()), ("pos", pa.int64()), ("seq", pa.int32()), ("last", pa.bool_()), ("n", pa.int32())])
_ARROW_FILE = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("crc", pa.int64()), ("docs", pa.list_(_ARROW_DOC)), ("payload", pa.binary())])
_PIECE = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("seq", pa.int32()), ("last", pa.bool_()), ("start", pa.int64()), ("n", pa.int32()), ("crc", pa.int64()), ("ids", pa.binary())])


def _blocks(encoded: Iterator[tuple[int | None, np.ndarray]], most: int) -> Iterator[tuple[list[dict], np.ndarray]]:
    """Cut a run of documents into blocks: pieces of documents and ids. Only documents longer than a block are cut."""
    docs, parts, room = [], [], most
    for pos, (doc_id, ids) in enumerate(encoded):
        for seq, k in enumerate(range(0, len(ids), most)):
            piece = ids[k : k + most]
            if len(piece) > room:
                yield docs, np.concatenate(parts)
                docs, parts, room = [], [], most
            docs.append({"doc_id": doc_id, "pos": pos, "seq": seq, "last": k + most >= len(ids), "n": len(piece)})
            parts.append(piece)
            room -= len(piece)
    if docs:
        yield docs, np.concatenate(parts)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, text_col: str = "text", id_col: str = "doc_id", block_ids: int = BLOCK_IDS) -> None:
    """Encode the texts and write the file."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = bpe.encoder(tokenizer_path), TaskContext.get().partitionId()

        def encoded():
            for b in it:
                doc_ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
                for p, q in bpe.groups(texts):
                    ids, ends = enc.encode_flat(texts[p:q])
                    ends += np.arange(len(ends))  # with an end id after each text
                    flat = np.full(ends[-1], end_id, np.uint32)
                    own = np.ones(len(flat), bool)
                    own[ends[1:] - 1] = False
                    flat[own] = ids
                    cuts = ends.tolist()
                    yield from zip(doc_ids[p:q], (flat[x:y] for x, y in zip(cuts[:-1], cuts[1:])))

        first = 0
        for number, (own, ids) in enumerate(_blocks(encoded(), block_ids)):
            crc = zlib.crc32(ids.astype("<u4", copy=False).tobytes())
            row = {"part": part, "block": number, "first": first, "n_ids": len(ids), "crc": crc, "docs": own, "payload": range_coder.encode(ids)}
            yield pa.RecordBatch.from_pylist([row], _ARROW_FILE)
            first += len(ids)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = base.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.length("text"), F.xxhash64("text"))
    ordered.mapInArrow(batches, FILE).write.parquet(path)


def read_pieces(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents' pieces in the file: part, doc_id, pos, seq, last, start (ids of the part before it), n, crc (of its ids), ids
    (little-endian bytes; null if not asked for). Every block is decoded and checked."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(b.num_rows):
                (row,) = b.slice(k, 1).to_pylist()
                raw = range_coder.decode(row["payload"], row["n_ids"]).astype("<u4", copy=False).tobytes()
                if zlib.crc32(raw) != row["crc"]:
                    raise ValueError(f"checksum of block {row['block']} of part {row['part']} does not hold")
                out, at = [], 0
                for d in row["docs"]:
                    ids = raw[4 * at : 4 * (at + d["n"])]
                    out.append(d | {"part": row["part"], "start": row["first"] + at, "crc": zlib.crc32(ids), "ids": ids if with_ids else None})
                    at += d["n"]
                yield pa.RecordBatch.from_pylist(out, _PIECE)

    source = spark.read.schema(FILE).parquet(path)
    return source.mapInArrow(batches, "part int, doc_id long, pos long, seq int, last boolean, start long, n int, crc long, ids binary")


def _times(a: int, b: int) -> int:
    """Product of two polynomials over bits modulo that of CRC-32, highest bit first."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc_of_parts(crcs: list[int], sizes: list[int]) -> int:
    """CRC-32 of bytes in parts, from the parts' values and sizes: each part moves what is before it by x ** (8 * size)."""
    out = 0
    for crc, n in zip(crcs, sizes):
        move, power = 0x80000000, 0x00800000  # x ** 0, x ** 8
        while n:
            if n & 1:
                move = _times(move, power)
            power = _times(power, power)
            n >>= 1
        out = _times(move, out) ^ crc
    return out


def summary(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    joined = F.pandas_udf(lambda rows: pd.Series([crc_of_parts([x["crc"] for x in r], [4 * x["n"] for x in r]) if r is not None else None for r in rows], dtype="Int64"), "long")
    pieces = read_pieces(spark, path, with_ids=False)
    each = pieces.select("part", "pos", "doc_id", "start", "n", "crc", F.when(~F.col("last") | (F.col("seq") > 0), F.struct("seq", "crc", "n")).alias("more"))
    whole = each.groupBy("part", "pos").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n"), F.first("crc").alias("crc"), F.array_sort(F.collect_list("more")).alias("more")
    )
    whole = whole.withColumn("more", F.when(F.size("more") > 0, F.col("more")))
    totals = spark.read.schema(FILE).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return whole.join(before, "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), F.coalesce(joined("more"), "crc").alias("ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-file")
    write(table(spark, sf_dir, "documents"), path, bpe.public_path("byte_bpe_50k.json"))
    return summary(spark, path)
