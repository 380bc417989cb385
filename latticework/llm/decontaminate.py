"""Benchmark decontamination by SimHash of item-sized windows and exact weighted-shingle similarity.

Every benchmark item has a 128-bit SimHash of its weighted five-word shingles. Every window of a document as long as an
item has one too. The item fingerprints are indexed by `BLOCKS` blocks of two bits: each differing bit spoils one block at most, so
fingerprints within `RADIUS` agree in at least BLOCKS - RADIUS = 30 of 64 blocks, and looking up all blocks and counting
finds every item within the radius; unlike fingerprints agree in about 16 (see the test for how many pass). A candidate
is confirmed if the exact weighted Jaccard similarity of the two shingle bags is at least the threshold.

Windows that cannot reach the threshold are not fingerprinted: weights lie in [1, 2], so a window needs item shingles at
`threshold / 2` of its places at least. This loses nothing.

A text shorter than an item is one window. It is compared exactly with the items of which it has enough shingles.

The index is broadcast only up to `MAX_INDEX_ITEMS` items and `MAX_INDEX_CHARS` characters; a larger benchmark is dealt by
hash into slices of that size, and the documents pass each slice in turn. Shingle weights are those of the whole benchmark: they
are counted over all items, and what several items share goes along with each slice (12 bytes a shared shingle).

Words are runs of letters and digits with capitals folded, so case and punctuation do not hide a passage.

Defined results: null and empty texts are clean; an item without words matches nothing; an item of one to four words has one
shingle of all its words and is compared with windows of as many words; repeated rows and a null doc_id give a
row each; of windows that match equally well the first counts; a text of any length is searched whole; an empty table gives no rows, and an
empty benchmark leaves all texts clean; other columns are kept, and the new column `hits` gets `_` added until its name is free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles as S
from .common import free_name, table

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 34
BLOCKS = 64
MAX_INDEX_ITEMS = 20_000
MAX_INDEX_CHARS = 16_000_000


class Index:
    """Fingerprints, shingle bags and weights of a slice of the benchmark."""

    def __init__(self, ids: list[int], texts: list[str], radius: int = RADIUS, threshold: float = THRESHOLD, shared: tuple[np.ndarray, np.ndarray] | None = None):
        """`shared`: all shingles that several items of the whole benchmark have, sorted, and by how many; None: the slice is all."""
        first, hashes, _, _ = S.words(pa.array(texts, pa.string()), folded=True)
        self.threshold, self.radius, self.items, self.bags = threshold, radius, [], []
        self.words = []
        for k, item in enumerate(ids):
            h = hashes[first[k] : first[k + 1]]
            if len(h):
                _, bag = S.shingles(np.array([0, len(h)]), h, SHINGLE)
                self.items.append(item)
                self.bags.append(np.sort(bag))
                self.words.append(len(h))
        self.known, df = np.unique(np.concatenate([np.unique(b) for b in self.bags]) if self.bags else np.zeros(0, np.uint64), return_counts=True)
        self.shared = (self.known[df > 1], df[df > 1].astype(np.int32)) if shared is None else shared
        self.prints = np.array([self.fingerprint(b) for b in self.bags], np.uint64).reshape(-1, 2)
        self.words = np.array(self.words, np.int64)
        self.by_size = {int(n): np.flatnonzero(self.words == n) for n in np.unique(self.words)}
        # per size and block: which of the size's items have a block value
        self.tables = {n: (self.block_values(self.prints[own]).T[:, None, :] == np.arange(4, dtype=np.uint8)[None, :, None]).astype(np.uint8) for n, own in self.by_size.items()}
        # per known shingle, the items that have it
        each = [np.unique(b) for b in self.bags]
        shingle = np.searchsorted(self.known, np.concatenate(each) if each else self.known)
        self.holders = np.repeat(np.arange(len(each)), [len(x) for x in each])[np.argsort(shingle, kind="stable")].astype(np.int32)
        self.held = np.concatenate([[0], np.cumsum(np.bincount(shingle, minlength=len(self.known)))])
        # a small bit table answers "certainly no item shingle" at once
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.known >> np.uint64(42)).astype(np.int64)] = True

    def weight(self, bag: np.ndarray) -> np.ndarray:
        """1 + 1 / number of items of the whole benchmark; 2 for what at most one item has."""
        keys, df = self.shared
        if not len(keys):
            return np.full(len(bag), 2.0)
        at = np.minimum(np.searchsorted(keys, bag), len(keys) - 1)
        return np.where(keys[at] == bag, 1 + 1 / df[at], 2.0)

    def is_known(self, bag: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bag), bool)
        if len(self.known):
            maybe = np.flatnonzero(self.filter[(bag >> np.uint64(42)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.known, bag[maybe]), len(self.known) - 1)
            out[maybe] = self.known[at] == bag[maybe]
        return out

    def signs(self, bag: np.ndarray) -> np.ndarray:
        """Weighted +1 / -1 per bit, a row of 128 per shingle, in 1/64 units so that sums are exact."""
        both = np.stack([bag, S.mix(bag ^ np.uint64(0x2545F4914F6CDD1D))], axis=1).astype("<u8")
        bits = np.unpackbits(both.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").astype(np.int32)
        return (2 * bits - 1) * np.round(self.weight(bag) * 64).astype(np.int32)[:, None]

    @staticmethod
    def pack(sums: np.ndarray) -> np.ndarray:
        """Two 64-bit halves of each fingerprint."""
        return np.packbits(sums > 0, axis=-1, bitorder="little").view("<u8")

    def fingerprint(self, bag: np.ndarray) -> np.ndarray:
        return self.pack(self.signs(bag).sum(0)[None])[0]

    @staticmethod
    def block_values(prints: np.ndarray) -> np.ndarray:
        """The two bits of each block, a row of BLOCKS per fingerprint."""
        bits = np.unpackbits(np.ascontiguousarray(prints).astype("<u8").view(np.uint8).reshape(-1, 16), axis=1, bitorder="little")
        return bits[:, ::2] | bits[:, 1::2] << 1

    def candidates(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window position, item position) that agree in enough blocks; all within the radius are among them."""
        table_, found = self.tables[size], [(np.zeros(0, int), np.zeros(0, int))]
        for p in range(0, len(prints), 256):
            values = self.block_values(prints[p : p + 256])
            agree = np.zeros((len(values), table_.shape[2]), np.uint8)
            for block in range(BLOCKS):
                agree += table_[block, values[:, block]]
            w, i = np.nonzero(agree >= BLOCKS - self.radius)
            found.append((w + p, self.by_size[size][i]))
        return np.concatenate([w for w, _ in found]), np.concatenate([i for _, i in found])

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        """Weighted Jaccard similarity of two shingle bags."""
        keys = np.union1d(a, b)
        na, nb = (np.bincount(np.searchsorted(keys, x), minlength=len(keys)) for x in (a, b))
        w = self.weight(keys)
        return float((w * np.minimum(na, nb)).sum() / (w * np.maximum(na, nb)).sum())

    def near(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window position, item position) within the radius, through the block tables."""
        w, i = self.candidates(size, prints)
        ok = np.bitwise_count(prints[w] ^ self.prints[i]).sum(1, dtype=np.int64) <= self.radius
        return w[ok], i[ok]

    def matches(self, texts: pa.Array) -> list[list[tuple[int, float, int, int]]]:
        """The hits of each text; texts without any item shingle are passed over."""
        first, hashes, _, _ = S.words(texts, folded=True)
        begin, bags = S.shingles(first, hashes, SHINGLE)
        known = self.is_known(bags)
        sums = np.concatenate([[0], np.cumsum(known)])
        look = (sums[begin[1:]] > sums[begin[:-1]]) | any(n < SHINGLE for n in self.by_size)
        return [self.hits(hashes[first[k] : first[k + 1]], bags[begin[k] : begin[k + 1]], known[begin[k] : begin[k + 1]]) if look[k] else [] for k in range(len(texts))]

    def hits(self, words: np.ndarray, bag: np.ndarray, known: np.ndarray) -> list[tuple[int, float, int, int]]:
        """item_id, similarity, first word and word count of the best window of each matched item."""
        best: dict[int, tuple[float, int, int]] = {}
        hits = np.concatenate([[0], np.cumsum(known)])
        for size, own in self.by_size.items():
            if size > len(words) or size >= SHINGLE and hits[-1] < self.threshold / 2 * (size - SHINGLE + 1):
                continue
            if size < SHINGLE:  # one shingle of all the item's words
                at = np.arange(len(words) - size + 1)
                short = np.zeros(len(at), np.uint64)
                for k in range(size):
                    short += words[at + k] * S._FACTORS[k]
                short = S.mix(short)
                for i in own:
                    for p in np.flatnonzero(short == self.bags[i][0])[:1]:
                        best[i] = (1.0, int(p), size)
                continue
            n = size - SHINGLE + 1
            starts = np.flatnonzero(hits[n:] - hits[:-n] >= self.threshold / 2 * n)
            if not len(starts):
                continue
            lo, hi = int(starts[0]), int(starts[-1]) + n
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1) if hi - lo > 4 * n else [starts]:
                lo, hi = int(part[0]), int(part[-1]) + n
                sums = np.zeros((hi - lo + 1, 128), np.int32)
                np.cumsum(self.signs(bag[lo:hi]), axis=0, out=sums[1:])
                prints = self.pack(sums[part - lo + n] - sums[part - lo])
                for w, i in zip(*self.near(size, prints)):
                    p = int(part[w])
                    s = self.similarity(np.sort(bag[p : p + n]), self.bags[i])
                    if s >= self.threshold - 1e-12 and s > best.get(i, (0.0,))[0]:
                        best[i] = (s, p, size)
        for i in self.longer(bag[known], len(words)):
            s = self.similarity(np.sort(bag), self.bags[i])
            if s >= self.threshold - 1e-12:
                best[i] = (s, 0, len(words))
        return sorted((self.items[i], s, p, n) for i, (s, p, n) in best.items())

    def longer(self, found: np.ndarray, n_words: int) -> np.ndarray:
        """Items of more than n_words words that a text of so many words, all its known shingles given, may reach the threshold with."""
        if not len(found) or n_words >= self.words.max():
            return np.zeros(0, int)
        keys, times = np.unique(found, return_counts=True)
        at = np.searchsorted(self.known, keys)
        items = np.concatenate([self.holders[self.held[k] : self.held[k + 1]] for k in at])
        shared = np.bincount(items, np.repeat(times, self.held[at + 1] - self.held[at]), len(self.words))
        return np.flatnonzero((self.words > n_words) & (shared > 0) & (shared >= self.threshold / 2 * (self.words - SHINGLE + 1)))


def _slices(bench: DataFrame, id_col: str, text_col: str) -> int:
    found = bench.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("c")).first()
    return max(1, -(-found["n"] // MAX_INDEX_ITEMS), -(-found["c"] // MAX_INDEX_CHARS))


def _shared(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several items have, sorted, and by how many."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in it for part in S.slices(whole, 0)):
            first, hashes, _, _ = S.words(b.column(0), folded=True)
            begin, bags = S.shingles(first, hashes, SHINGLE)
            own = [np.unique(bags[x:y]) for x, y in zip(begin[:-1], begin[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64))], ["shingle"])

    each = items.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(batches, "shingle long")
    rows = each.groupBy("shingle").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1").toArrow()
    keys = rows.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows.column("df").to_numpy()[order]


def find(docs: DataFrame, bench: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, radius: int = RADIUS, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All input columns plus, as the last one, `hits`: item_id, similarity, start and length (in words) of each matched passage."""
    items = bench.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    slices = _slices(items, "item_id", "text")
    names = list(docs.columns)
    hits = free_name(names, "hits")
    struct = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))
    out = docs.withColumn(hits, F.array().cast(struct)) if slices > 1 else docs
    shared = _shared(items) if slices > 1 else None
    for k in range(slices):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k).orderBy("item_id").collect()
        index = bench.sparkSession.sparkContext.broadcast(Index([r.item_id for r in rows], [r.text or "" for r in rows], radius, threshold, shared))
        out = _one_pass(out, index, text_col, names, hits, struct)
    return out


def _one_pass(docs: DataFrame, index, text_col: str, names: list[str], hits: str, struct: T.DataType) -> DataFrame:
    at = docs.columns.index(text_col)
    n = len(names)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int32()), ("length", pa.int32())]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for b in (part for whole in it for part in S.slices(whole, at)):
            found = [[dict(zip(("item_id", "similarity", "start", "length"), h)) for h in each] for each in own.matches(b.column(at))]
            if b.num_columns > n:
                found = [(old or []) + new for old, new in zip(b.column(n).to_pylist(), found)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(found, kind)], [*b.schema.names[:n], hits])

    fields = docs.select(*names).schema.add(hits, struct)
    return docs.mapInArrow(batches, fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = find(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.array_sort("hits").alias("hits"))
    return hits.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_items"),
        F.col("hits.item_id").alias("item_ids"),
        F.round(F.array_max("hits.similarity"), 6).alias("best_similarity"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = find(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size(found.columns[-1]) == 0).select(*docs.columns)
