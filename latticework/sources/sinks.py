"""Sinks: manifests, keep lists, leak reports, the training corpus, detection results, metric logs."""

from __future__ import annotations

import logging

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.pixels import per_frame

H, W = 512, 1024


def write_manifest(manifest: DataFrame, path: str) -> None:
    """TSV with header and Parquet."""
    m = manifest.select("keep", "reason", "scan", "frame_idx", "key")
    m.write.mode("overwrite").parquet(f"{path}/parquet")
    m.sparkSession.read.schema(m.schema).parquet(f"{path}/parquet").write.mode("overwrite").csv(f"{path}/tsv", sep="\t", header=True)


def write_parts(prints: DataFrame, path: str) -> None:
    """S3: fingerprints as one folder of parts per shard; a repeated write of a shard replaces its part only."""
    prints.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tar").parquet(path)


def write_keep_list(manifest: DataFrame, path: str) -> None:
    """Keys of the kept frames, a line each."""
    manifest.where("keep").select("key").write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str, score: str = "score") -> None:
    """A report by falling score, ties by the other columns; arrays as JSON text."""
    cols = [F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.orderBy(F.desc(score), *[c for c in rows.columns if c != score]).select(*cols).write.mode("overwrite").csv(path, header=True)


def corpus(frames: DataFrame, manifest: DataFrame, h: int = H, w: int = W) -> DataFrame:
    """Kept frames with their beamtime, resized where needed; the keep list meets the frames before pixels are touched."""
    kept = frames.join(manifest.where("keep").select("key"), "key", "left_semi")

    def fn(img: np.ndarray, row: dict) -> dict:
        out = img if img.shape == (h, w) else K.area_resize(img, h, w).round().astype(np.uint8)
        return {"h": h, "w": w, "pixels": out.tobytes()}

    narrow = kept.select("key", "scan", "frame_idx", "h", "w", "pixels")
    sized = per_frame(narrow, fn, "key string, scan string, frame_idx int, h int, w int, pixels binary", ("key", "scan", "frame_idx"))
    return sized.withColumn("beamtime", F.split("scan", "/")[0])


def write_corpus(rows: DataFrame, path: str) -> None:
    """Files range-sorted by scan and frame, so a scan's frames lie together; the one shuffle that moves pixels."""
    rows.repartitionByRange("scan", "frame_idx").sortWithinPartitions("scan", "frame_idx").write.mode("overwrite").parquet(path)


def coco_results(dets: DataFrame, category: str = "label") -> DataFrame:
    """image_id, category_id, bbox (x, y, w, h), score."""
    box = F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return dets.select("image_id", F.col(category).alias("category_id"), box.alias("bbox"), "score")


def write_coco_results(dets: DataFrame, path: str) -> None:
    coco_results(dets).write.mode("overwrite").json(path)


def append_metrics(by_dataset: dict[str, DataFrame], path: str) -> dict[str, bool]:
    """Append (epoch, ap) rows per data set; one that fails does not stop the others. Returns which were written."""
    done = {}
    for name, rows in by_dataset.items():
        try:
            rows.select("epoch", "ap").write.mode("append").parquet(f"{path}/{name}")
            done[name] = True
        except Exception as e:  # noqa: BLE001
            logging.getLogger(__name__).warning("metrics of %s were not written: %s", name, e)
            done[name] = False
    return done
