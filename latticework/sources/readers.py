"""Sources: tar shards of frames, box annotations, tables of predictions, run logs."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import tarfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import read_png
from ..functions.pixels import parse_scan
from . import tars

#: Frames that a shard reader holds at once.
BATCH, BATCH_BYTES = 64, 64 << 20

FRAME_SCHEMA = "key string, tar string, pos int, source string, beamtime string, q_max float, md5 string, is_raw boolean, h int, w int, pixels binary"


#: Shards of more bytes than this are not read as one cell but as byte ranges (tars.py).
STREAM_FROM = 64 << 20


def shards(spark: SparkSession, path: str, only: list[str] | None = None, stream_from: int = STREAM_FROM, range_bytes: int = tars.RANGE_BYTES) -> DataFrame:
    """Frames of tar shards (see `members`). `only` keeps shards whose name contains one of the texts.

    Small shards come as Spark reads them, a task for a few of them. A larger one is read in ranges of `range_bytes`, by several tasks;
    a task takes many neighbouring ranges if they are small.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(path)
    if only:
        name = F.element_at(F.split("path", "/"), -1)
        keep = F.lit(False)
        for x in only:
            keep = keep | name.contains(x)
        files = files.where(keep)
    is_large = F.col("length") > stream_from
    sizes = files.agg(F.count_if(~is_large).alias("n_small"), F.sum(F.when(is_large, F.col("length"))).alias("large_bytes")).first()
    small = members(files.where(~is_large).select("path", "content"))
    if sizes.large_bytes is None:
        return small
    large = files.where(is_large).select("path").repartition(max(spark.sparkContext.defaultParallelism, 1), "path")
    frames = _named(tars.frames(spark, large, sizes.large_bytes, range_bytes))
    return small.unionByName(frames) if sizes.n_small else frames


def frame_row(path: str, name: str, pos: int, data: bytes, sibling: bytes | None) -> tuple | None:
    """A row of FRAME_SCHEMA from a PNG member and its JSON sibling; None if it cannot be decoded."""
    try:
        img = read_png(data)
    except ValueError:
        return None
    try:
        meta = json.loads(sibling) if sibling is not None else {}
    except ValueError:
        meta = {}
    meta = meta if isinstance(meta, dict) else {}
    q = meta.get("q_max")
    return name, path.rsplit("/", 1)[-1], pos, meta.get("source") or "", meta.get("beamtime") or "", float("nan") if q is None else float(q), hashlib.md5(data).hexdigest(), name.endswith(".raw.png"), *img.shape, img.tobytes()


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of FRAME_SCHEMA for Arrow."""
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float32(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], NAMES)


def _frames_of(path: str, tar: tarfile.TarFile) -> Iterator[tuple]:
    files = [m for m in tar.getmembers() if m.isfile()]
    by_name = {m.name: m for m in files}
    for pos, m in enumerate(files):
        if m.name.endswith(".png"):
            sibling = by_name.get(m.name[:-4] + ".json")
            row = frame_row(path, m.name, pos, tar.extractfile(m).read(), tar.extractfile(sibling).read() if sibling is not None else None)
            if row:
                yield row


def members(files: DataFrame) -> DataFrame:
    """A row per readable PNG member of tar files (path, content), with its JSON sibling.

    Members that cannot be decoded are skipped; colour images keep their first channel; a missing sibling gives '', '' and NaN.
    `pos` is the member's place in the shard; (tar, pos) is the order of first occurrence.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows, size = [], 0
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for row in _frames_of(path, tar):
                        rows.append(row)
                        size += len(row[-1])
                        if len(rows) == BATCH or size > BATCH_BYTES:
                            yield pd.DataFrame(rows, columns=NAMES)
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=NAMES)

    return _named(files.mapInPandas(run, FRAME_SCHEMA))


def _named(frames: DataFrame) -> DataFrame:
    """With scan and frame number from the path."""
    scan, frame = parse_scan()
    return frames.withColumns({"scan": scan, "frame_idx": frame, "q_max": F.coalesce("q_max", F.lit(float("nan")).cast("float"))})


NAMES = [x.split()[0] for x in FRAME_SCHEMA.split(", ")]


def parts(spark: SparkSession, path: str) -> DataFrame:
    """S3: fingerprint parts written by shard (`sinks.write_parts`), with their shard."""
    return spark.read.parquet(path)


def layout(peaks: DataFrame) -> str:
    """Which of the two peak layouts a table has."""
    return "visibility" if {"visibility", "radius_width"} <= set(peaks.columns) else "roi"


def peak_table(peaks: DataFrame) -> DataFrame:
    """Peaks of either layout as one table: image_id, radius, radius_width, angle, angle_width, is_ring, visibility, score."""
    if layout(peaks) == "visibility":
        return peaks.select("image_id", "radius", "radius_width", "angle", "angle_width", "is_ring", "visibility", F.col("score").cast("double").alias("score"))
    level = F.col("confidence_level")
    visibility = F.when(level >= 1, 3).when(level >= 0.5, 2).otherwise(1)
    return peaks.select(
        "image_id", "radius", F.col("width").alias("radius_width"), "angle", F.col("angle_std").alias("angle_width"), (F.col("type") == 1).alias("is_ring"), visibility.alias("visibility"), level.cast("double").alias("score")
    )


def coco(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Annotations of box files (`lines`: a document per line) with their image's size: image_id, file_name, width, height, category_id, x, y, w, h, area, iscrowd."""
    schema = (
        "images array<struct<id:bigint,file_name:string,width:int,height:int>>,"
        "annotations array<struct<id:bigint,image_id:bigint,bbox:array<double>,category_id:int,area:double,iscrowd:int>>"
    )
    doc = spark.read.option("multiLine", not lines).schema(schema).json(path)
    images = doc.select(F.inline("images")).withColumnRenamed("id", "image_id")
    boxes = doc.select(F.inline("annotations"))
    j = boxes.join(images, "image_id")
    at = lambda k: F.get("bbox", F.lit(k))
    return j.select("image_id", "file_name", "width", "height", F.col("id").alias("ann_id"), "category_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("w"), at(3).alias("h"), "area", F.coalesce("iscrowd", F.lit(0)).alias("iscrowd"))


def coco_panoptic(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Segments of panoptic files (`lines`: a document per line), joined with images by the file's stem."""
    schema = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<file_name:string,segments_info:array<struct<id:bigint,category_id:int,iscrowd:int,area:bigint>>>>"
    doc = spark.read.option("multiLine", not lines).schema(schema).json(path)
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    images = doc.select(F.inline("images")).withColumn("stem", stem(F.col("file_name")))
    ann = doc.select(F.inline("annotations")).select(stem(F.col("file_name")).alias("stem"), "segments_info")
    return images.join(ann, "stem").select(F.col("id").alias("image_id"), "stem", "width", "height", F.inline_outer("segments_info").alias("segment_id", "category_id", "iscrowd", "area"))


def image_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Key, class and image bytes of a table whose last column is base64."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    return raw.select(F.get("c", F.lit(0)).alias("key"), F.get("c", F.lit(1)).try_cast("int").alias("label"), F.unbase64(F.element_at("c", -1)).alias("image"))


def _lines(spark: SparkSession, paths) -> DataFrame:
    """file, folder, line_no and value of text files. A file is read as one row so that its lines keep their numbers; a log has less than 2 GB."""
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2).alias("folder")
    rows = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_name").alias("file"), folder, F.col("_metadata.file_modification_time").alias("changed"), "value")
    return rows.select("file", "folder", "changed", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))


def parse_ap_lines(lines: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """`epoch ap` lines of exactly two numbers; the last line of an epoch wins."""
    t = F.split(F.trim("value"), r"\s+")
    epoch, ap = F.get(t, F.lit(0)).try_cast("double"), F.get(t, F.lit(1)).try_cast("double")
    ok = lines.select(*keys, "line_no", epoch.cast("int").alias("epoch"), ap.alias("ap"), F.size(t).alias("n")).where("n = 2 AND epoch IS NOT NULL AND ap IS NOT NULL")
    return ok.groupBy(*keys, "epoch").agg(F.max_by("ap", "line_no").alias("ap"))


def ap_text(spark: SparkSession, paths, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    return parse_ap_lines(_lines(spark, paths), keys)


#: Fixed value: the line that a run's log has per epoch and data set.
AP_LINE = r"\[epoch (\d+)\]\s+(41|organic)\s+ap_total\s*=\s*([0-9.]+)"


def parse_free_text(lines: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """`[epoch N] dataset ap_total = X` anywhere in a line; the last line of an epoch wins."""
    got = lines.where(F.col("value").rlike(AP_LINE)).select(*keys, "line_no", F.regexp_extract("value", AP_LINE, 1).cast("int").alias("epoch"), F.regexp_extract("value", AP_LINE, 2).alias("dataset"), F.regexp_extract("value", AP_LINE, 3).try_cast("double").alias("ap"))
    return got.where("ap IS NOT NULL").groupBy(*keys, "dataset", "epoch").agg(F.max_by("ap", "line_no").alias("ap"))


def newest(lines: DataFrame, prefix: Column) -> DataFrame:
    """Lines of the newest file of each prefix."""
    tagged = lines.withColumn("prefix", prefix)
    best = tagged.groupBy("prefix").agg(F.max_by("file", F.struct("changed", "file")).alias("file"))
    return tagged.join(best, ["prefix", "file"], "left_semi")


def free_text(spark: SparkSession, paths, prefix: Column | None = None) -> DataFrame:
    lines = _lines(spark, paths)
    return parse_free_text(newest(lines, prefix), ("prefix", "file")) if prefix is not None else parse_free_text(lines)


def loss_csv(spark: SparkSession, paths) -> DataFrame:
    """Epoch, train and validation loss (and what follows) of lines with three numbers or more."""
    t = F.split(F.trim("value"), r"\s*,\s*")
    n = lambda k: F.get(t, F.lit(k)).try_cast("double")
    rows = _lines(spark, paths).select("file", "folder", "line_no", n(0).cast("int").alias("epoch"), n(1).alias("train_loss"), n(2).alias("val_loss"), n(3).alias("lr"), n(4).alias("sec"))
    return rows.where("epoch IS NOT NULL AND train_loss IS NOT NULL AND val_loss IS NOT NULL")


def json_logs(spark: SparkSession, paths, schema: str | None = None) -> DataFrame:
    """JSON lines of several runs, with the run from the folder's name."""
    reader = spark.read.schema(schema) if schema else spark.read
    path = F.col("_metadata.file_path")
    return reader.json(paths).withColumn("run", F.element_at(F.split(path, "/"), -2))


def encode_image(data: bytes) -> str:
    return base64.b64encode(data).decode()


def frame_array(row) -> np.ndarray:
    return np.frombuffer(row["pixels"], np.uint8).reshape(row["h"], row["w"])
