"""Byte ranges of tar shards as a Spark data source.

A job reads the headers of every shard once and stores an index: a row per PNG member with its place, its JSON sibling's place and the number of its
range (`range_bytes` of the shard). Ranges are dealt, neighbours together, to the partitions of the data source: a shard of any size is read by many
tasks, and many small shards by few. A task finds its members in the index and reads just their bytes. The driver knows the partitions, neither ranges nor members.

Shards and the shared folder must be in a store that pyarrow opens by its address.
"""

from __future__ import annotations

import json
import tarfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import folder, stored

#: Bytes of a shard in one range, and of shards that one task reads.
RANGE_BYTES = 64 << 20
#: Frames that a reader holds at once.
BATCH, BATCH_BYTES = 64, 64 << 20
INDEX = "path string, name string, pos int, at long, size long, json_at long, json_size long, part long"


def opened(path: str):
    """A file of any store that pyarrow knows, by its address or as a local path."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def index(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """PNG members of tar files (path), with their JSON siblings; only headers are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                with tarfile.open(fileobj=opened(path)) as tar:
                    files = [(m.name, m.offset_data, m.size) for m in tar if m.isfile()]
                by_name = {name: (at, size) for name, at, size in files}
                rows = []
                for pos, (name, at, size) in enumerate(files):
                    if name.endswith(".png"):
                        rows.append((path, name, pos, at, size, *by_name.get(name[:-4] + ".json", (-1, 0)), at // range_bytes))
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX.split(", ")])

    return files.mapInPandas(run, INDEX)


class Range(InputPartition):
    def __init__(self, place: str):
        self.place = place


class TarFrames(DataSource):
    """Options: places (JSON list of index folders, one per task), schema of the frames as given to load."""

    @classmethod
    def name(cls) -> str:
        return "tar_frames"

    def schema(self) -> str:
        from .readers import FRAME_SCHEMA

        return FRAME_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TarReader(self.options)


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.places = json.loads(options["places"])

    def partitions(self) -> list[Range]:
        return [Range(x) for x in self.places] or [Range("")]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from .readers import frame_row, record_batch

        if not partition.place:
            return
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(partition.place)
        members = pq.read_table(name, filesystem=store, partitioning=None).sort_by([("path", "ascending"), ("at", "ascending")]).to_pylist()
        rows, size, path, file = [], 0, None, None
        for m in members:
            if m["path"] != path:
                if file is not None:
                    file.close()
                path, file = m["path"], opened(m["path"])
            data = file.read_at(m["size"], m["at"])
            meta = file.read_at(m["json_size"], m["json_at"]) if m["json_at"] >= 0 else None
            row = frame_row(path, m["name"], m["pos"], data, meta)
            if row:
                rows.append(row)
                size += len(row[-1])
            if len(rows) == BATCH or size > BATCH_BYTES:
                yield record_batch(rows)
                rows, size = [], 0
        if rows:
            yield record_batch(rows)


def frames(spark: SparkSession, files: DataFrame, total_bytes: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames of tar files (path) of so many bytes in all. A task reads RANGE_BYTES of them, or less where there are cores for more tasks, and whole ranges."""
    cores = max(spark.sparkContext.defaultParallelism, 1)
    n = min(-(-total_bytes // range_bytes), max(2 * cores, -(-total_bytes // RANGE_BYTES)))
    path = folder(spark, "tar-places")
    dealt = stored(index(files, range_bytes), "tar-index").repartitionByRange(n, "path", "part")
    dealt.withColumn("place", F.spark_partition_id()).write.partitionBy("place").parquet(path)
    # a number per task
    places = [r.place for r in spark.read.schema(f"{INDEX}, place int").parquet(path).select("place").distinct().orderBy("place").collect()]
    spark.dataSource.register(TarFrames)
    return spark.read.format("tar_frames").option("places", json.dumps([f"{path}/place={x}" for x in places])).load()
