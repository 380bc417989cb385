"""Source and sink queries: a supplied table is written in a file format to the shared folder and read back, each with its SQL."""

from __future__ import annotations

import io
import json
import os
import struct
import tarfile
import zlib

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as X
from ..functions.store import folder
from ..operators import curation as C
from ..sources import readers as R
from ..sources import sinks as S
from . import boxes, curation, similarity
from . import views as V

UP = lambda c: F.round(F.col(c) + 1e-9, 6).alias(c)
#: Frames of a shard.
PER_TAR = 40


def _png(img: np.ndarray) -> bytes:
    """An 8-bit grey PNG."""
    h, w = img.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.hstack([np.zeros((h, 1), np.uint8), img.astype(np.uint8)]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """A tar of the frames of one shard: PNG members and, but for every fourth, their JSON siblings; one member is no PNG."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:

        def add(name: str, data: bytes) -> None:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))

        for r in pdf.sort_values("vec_id").itertuples():
            add(f"d/p__s{r.vec_id % 7}__f{r.vec_id}.png", _png(np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w)))
            if r.vec_id % 4:
                add(f"d/p__s{r.vec_id % 7}__f{r.vec_id}.json", json.dumps({"source": f"beamtimes/bt{r.vec_id % 3}/raw/s/x/pe/foo-{r.vec_id}.tif", "beamtime": f"bt{r.vec_id % 3}", "q_max": r.vec_id % 5 + 0.5}).encode())
        add("broken.png", b"\x89PNG")
    return pd.DataFrame({"path": [f"store/shard{pdf.tar.iloc[0]}.tar"], "content": [out.getvalue()]})


def _grids(s, d) -> DataFrame:
    """Frames with the number of their shard; a shard takes long to pack for its few bytes, so all cores have some."""
    g = V.grids(s, d).select("vec_id", "h", "w", "pixels", F.floor(F.col("vec_id") / PER_TAR).alias("tar"))
    return g.repartition(max(s.sparkContext.defaultParallelism, 1), "tar")


def _tars(s, d) -> DataFrame:
    path = folder(s, "tars")
    _grids(s, d).groupBy("tar").applyInPandas(_packed, "path string, content binary").write.parquet(path)
    return s.read.schema("path string, content binary").parquet(path)


def _tar_files(s, d) -> str:
    """The shards as files of the shared folder; a file gets its name when it is whole, so a task may be repeated."""
    path = folder(s, "tar-files")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        made = _packed(pdf)
        store, top = fs.FileSystem.from_uri(path)
        store.create_dir(top)
        name = f"{top}/{made.path.iloc[0].rsplit('/', 1)[-1]}"
        part = f"{name}.{os.getpid()}"
        with store.open_output_stream(part) as out:
            out.write(made.content.iloc[0])
        store.move(part, name)
        return made[["path"]]

    _grids(s, d).groupBy("tar").applyInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    return path


def _sum(pixels: str):
    """Sum of the byte values."""
    hexed = F.hex(pixels)
    return F.aggregate(F.sequence(F.lit(0), F.length(pixels) - 1), F.lit(0).cast("long"), lambda t, i: t + F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))


def shards(s, d):
    """Members of the shards whose name contains a 1 or a 2, each read as byte ranges by several tasks."""
    frames = R.shards(s, _tar_files(s, d), ["1", "2"], stream_from=0, range_bytes=16 << 10)
    return frames.select("key", "tar", F.col("pos").cast("long").alias("pos"), "source", "beamtime", F.when(F.isnan("q_max"), -1.0).otherwise(F.col("q_max").cast("double")).alias("q_max"), "scan", F.col("frame_idx").cast("long").alias("frame_idx"), "is_raw", "h", "w", _sum("pixels").alias("total"))


def parts(s, d):
    """S3: fingerprints of all shards, a part per shard, read together."""
    frames = R.members(_tars(s, d)).select("key", "tar", "h", "w", "pixels")
    path = folder(s, "parts")
    S.write_parts(X.fingerprints(frames, ("key", "tar"), "key string, tar string"), path)
    return R.parts(s, path).select("tar", "key", F.round(F.col("frac_valid").cast("double"), 4).alias("frac_valid"), F.col("dyn").cast("double").alias("dyn"))


def peak_tables(s, d):
    """Both layouts, told apart by their columns, as one table."""
    b = V.boxes(s, d)
    one = b.where("label = 1").select("image_id", F.col("x1").alias("radius"), (F.col("x2") - F.col("x1")).alias("radius_width"), F.col("y1").alias("angle"), (F.col("y2") - F.col("y1")).alias("angle_width"), (F.col("qty") % 2 == 0).alias("is_ring"), (F.col("qty") % 4).cast("int").alias("visibility"), "score")
    two = b.where("label = 0").select("image_id", F.col("x1").alias("radius"), (F.col("x2") - F.col("x1")).alias("width"), F.col("y1").alias("angle"), (F.col("y2") - F.col("y1")).alias("angle_std"), F.element_at(F.array(F.lit(0.1), F.lit(0.5), F.lit(1.0)), (F.col("qty") % 3 + 1).cast("int")).alias("confidence_level"), (F.col("qty") % 2).cast("int").alias("type"))
    return R.peak_table(one).unionByName(R.peak_table(two)).withColumn("score", UP("score"))


def manifest(s, d):
    """The manifest's TSV."""
    path = folder(s, "manifest")
    S.write_manifest(C.manifest_b(V.frames(s, d), curation.CAP), path)
    return s.read.csv(f"{path}/tsv", sep="\t", header=True, schema="keep boolean, reason string, scan string, frame_idx long, key string")


def keep_list(s, d):
    path = folder(s, "keep")
    S.write_keep_list(C.manifest_b(V.frames(s, d), curation.CAP), path)
    return s.read.text(path).withColumnRenamed("value", "key")


def report(s, d):
    """The report of combined leak scores."""
    path = folder(s, "report")
    S.write_report(similarity.combined(s, d), path)
    return s.read.csv(path, header=True, schema="eval_id long, vec_id long, score double, leak boolean")


def corpus_pixels(s, d):
    """Kept frames, resized, written in the order of scan and frame, and read back."""
    g = V.grids(s, d)
    frames = g.select(F.concat(F.lit("k"), "vec_id").alias("key"), F.concat(F.lit("bt"), F.col("vec_id") % 5, F.lit("/s"), F.col("vec_id") % 11).alias("scan"), F.col("vec_id").cast("int").alias("frame_idx"), "h", "w", "pixels")
    keep = g.select(F.concat(F.lit("k"), "vec_id").alias("key"), (F.col("vec_id") % 3 == 0).alias("keep"))
    path = folder(s, "corpus")
    S.write_corpus(S.corpus(frames, keep, 16, 32), path)
    return s.read.parquet(path).select("key", "scan", "beamtime", "frame_idx", "h", "w", _sum("pixels").alias("total"))


def coco(s, d):
    """A document per image with its annotations."""
    a = V.boxes(s, d)
    box = F.struct((F.col("image_id") * 100 + F.col("det")).alias("id"), "image_id", F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"), (F.col("label") + 1).alias("category_id"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"), F.when(F.col("qty") % 3 > 0, (F.col("qty") % 3 - 1).cast("int")).alias("iscrowd"))
    image = F.array(F.struct(F.col("image_id").alias("id"), F.concat(F.lit("i"), "image_id", F.lit(".jpg")).alias("file_name"), F.lit(400).alias("width"), F.lit(500).alias("height")))
    docs = a.groupBy("image_id").agg(F.collect_list(box).alias("annotations")).select(F.to_json(F.struct(image.alias("images"), "annotations")).alias("value"))
    path = folder(s, "coco")
    docs.write.text(path)
    return R.coco(s, path, lines=True)


def panoptic(s, d):
    """Segments of an image's mask file, joined by the file's stem."""
    a = V.boxes(s, d)
    part = F.struct(F.col("det").alias("id"), F.col("label").alias("category_id"), F.lit(0).alias("iscrowd"), F.col("qty").alias("area"))
    image = F.array(F.struct(F.col("image_id").alias("id"), F.concat(F.lit("i"), "image_id", F.lit(".jpg")).alias("file_name"), F.lit(400).alias("width"), F.lit(500).alias("height")))
    mask = F.array(F.struct(F.concat(F.lit("i"), "image_id", F.lit(".png")).alias("file_name"), F.col("segments_info")))
    docs = a.groupBy("image_id").agg(F.collect_list(part).alias("segments_info")).select(F.to_json(F.struct(image.alias("images"), mask.alias("annotations"))).alias("value"))
    path = folder(s, "panoptic")
    docs.write.text(path)
    return R.coco_panoptic(s, path, lines=True)


def image_tsv(s, d):
    g = V.grids(s, d)
    label = F.when(F.col("vec_id") % 9 == 0, F.lit("none")).otherwise((F.col("vec_id") % 9).cast("string"))
    path = folder(s, "tsv")
    g.select(F.concat_ws("\t", F.concat(F.lit("k"), "vec_id"), label, F.lit("x"), F.regexp_replace(F.base64("pixels"), r"\s", "")).alias("value")).write.text(path)
    return R.image_tsv(s, path).select("key", "label", F.md5("image").alias("md5"))


def results(s, d):
    path = folder(s, "results")
    S.write_coco_results(V.boxes(s, d), path)
    r = s.read.schema("image_id long, category_id int, bbox array<double>, score double").json(path)
    return r.select("image_id", "category_id", *[F.get("bbox", F.lit(k)).alias(n) for k, n in enumerate(("x", "y", "w", "h"))], UP("score"))


def _logs(s, d, line, label: str) -> str:
    """A folder per run with one text file, lines in the order of line_no. Status P makes runs of its own."""
    run = F.concat(F.substring("run", 1, 1), F.when(F.col("dataset") == "P", "P").otherwise(""))
    log = V.run_log(s, d).withColumn("run", run).withColumn("dataset", F.when(F.col("dataset") == "O", "41").otherwise("organic"))
    path = folder(s, label)
    lines = log.select("run", "line_no", line.alias("value")).repartition("run").sortWithinPartitions("run", "line_no")
    lines.select("run", "value").write.partitionBy("run").text(path)
    return path


def _run(column: str = "folder"):
    return F.regexp_extract(column, "run=(.*)", 1).alias("run")


def ap_text(s, d):
    """Two numbers a line; lines with a third word are skipped; a run's later line of an epoch wins over the other data set's."""
    line = F.when(F.col("line_no") % 11 == 0, F.concat_ws("\t", "epoch", "ap", F.lit("x"))).otherwise(F.concat_ws("\t", "epoch", "ap"))
    return R.ap_text(s, _logs(s, d, line, "ap") + "/*", ("folder",)).select(_run(), F.col("epoch").cast("long").alias("epoch"), UP("ap"))


def free_text(s, d):
    """Lines of the newest file of each run."""
    line = F.concat(F.lit("noise [epoch "), "epoch", F.lit("]  "), "dataset", F.lit(" ap_total = "), F.col("ap").cast("string"))
    rows = R.free_text(s, _logs(s, d, line, "out") + "/*", F.col("folder"))
    return rows.select(_run("prefix"), "dataset", F.col("epoch").cast("long").alias("epoch"), UP("ap"))


def loss_csv(s, d):
    """Lines of three numbers or more."""
    line = F.when(F.col("line_no") % 11 == 0, F.concat_ws(",", "epoch", "ap")).when(F.col("line_no") % 13 == 0, F.lit("epoch,train,val")).otherwise(F.concat_ws(",", "epoch", "ap", F.col("ap") / 2, F.lit("0.001")))
    rows = R.loss_csv(s, _logs(s, d, line, "loss") + "/*")
    return rows.select(_run(), F.col("epoch").cast("long").alias("epoch"), UP("train_loss"), UP("val_loss"), "lr")


def json_logs(s, d):
    """JSON lines, the run from the folder."""
    line = F.to_json(F.struct("epoch", "ap", "dataset"))
    rows = R.json_logs(s, _logs(s, d, line, "json") + "/*", "epoch long, ap double, dataset string")
    return rows.select(_run("run"), "dataset", "epoch", UP("ap"))


def appended(s, d):
    """Metric rows appended twice, in halves; a data set without the columns is skipped."""
    log, path = V.run_log(s, d), folder(s, "metrics")
    for half in (0, 1):
        own = log.where(F.col("line_no") % 2 == half)
        S.append_metrics({x: own.where(F.col("dataset") == x) for x in ("F", "O", "P")} | {"bad": own.drop("ap")}, path)
    one = lambda x: s.read.parquet(f"{path}/{x}").select(F.lit(x).alias("dataset"), "epoch", UP("ap"))
    return one("F").unionByName(one("O")).unionByName(one("P"))


_B = curation.PLANS["d7_manifest_b"][1]
_LOG = f"{V.RUN_LOG}, lg AS (SELECT run[1:1]||CASE dataset WHEN 'P' THEN 'P' ELSE '' END AS run, CASE dataset WHEN 'O' THEN '41' ELSE 'organic' END AS dataset, epoch, ap, line_no FROM run_log)"
_TAR = V.GRIDS + f""", tars AS (SELECT vec_id, g, 'd/p__s'||(vec_id % 7)||'__f'||vec_id||'.png' AS key, vec_id // {PER_TAR} AS t FROM grids),
 pos AS (SELECT *, 'shard'||t||'.tar' AS tar, coalesce(sum(CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 2 END) OVER (PARTITION BY t ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM tars)"""
_Q = "round({0} + 1e-9::DOUBLE, 6) AS {0}"

PLANS = {
    "s1_s2_shards": (shards, f"""WITH {_TAR} SELECT key, tar, pos, CASE WHEN vec_id % 4 = 0 THEN '' ELSE 'beamtimes/bt'||(vec_id % 3)||'/raw/s/x/pe/foo-'||vec_id||'.tif' END AS source, CASE WHEN vec_id % 4 = 0 THEN '' ELSE 'bt'||(vec_id % 3) END AS beamtime,
      CASE WHEN vec_id % 4 = 0 THEN -1 ELSE vec_id % 5 + 0.5::DOUBLE END AS q_max, CASE WHEN vec_id % 4 = 0 THEN 'p/s'||(vec_id % 7) ELSE 'bt'||(vec_id % 3)||'/s/x' END AS scan, vec_id AS frame_idx, false AS is_raw, 8 AS h, 8 AS w, list_sum(g)::BIGINT AS total
      FROM pos WHERE contains(tar, '1') OR contains(tar, '2')"""),
    "s3_parts": (parts, f"WITH {_TAR}, u AS (SELECT *, list_filter(g, lambda x: x <> 0) AS o FROM pos) SELECT tar, key, round_even(len(o) / 64.0::DOUBLE, 4) AS frac_valid, coalesce(list_max(o) - list_min(o), 0)::DOUBLE AS dyn FROM u"),
    "s4_peak_tables": (peak_tables, f"""WITH {V.BOXES} SELECT image_id, x1 AS radius, x2-x1 AS radius_width, y1 AS angle, y2-y1 AS angle_width, (qty % 2 = 0) = (label = 1) AS is_ring,
      (CASE WHEN label = 1 THEN qty % 4 ELSE qty % 3 + 1 END)::INTEGER AS visibility, round(CASE WHEN label = 1 THEN score ELSE [0.1::DOUBLE, 0.5, 1.0][qty % 3 + 1] END + 1e-9::DOUBLE, 6) AS score FROM boxes"""),
    "s6_manifest": (manifest, f"SELECT keep, reason, scan, frame_idx, key FROM ({_B})"),
    "s7_keep_list": (keep_list, f"SELECT key FROM ({_B}) WHERE keep"),
    "s8_report": (report, similarity.PLANS["j7_combined_leaks"][1]),
    "s9_corpus_pixels": (corpus_pixels, f"WITH {V.GRIDS} SELECT 'k'||vec_id AS key, 'bt'||(vec_id % 5)||'/s'||(vec_id % 11) AS scan, 'bt'||(vec_id % 5) AS beamtime, vec_id::INTEGER AS frame_idx, 16 AS h, 32 AS w, 8 * list_sum(g)::BIGINT AS total FROM grids WHERE vec_id % 3 = 0"),
    "s10_coco": (coco, f"""WITH {V.BOXES} SELECT image_id, 'i'||image_id||'.jpg' AS file_name, 400 AS width, 500 AS height, image_id * 100 + det AS ann_id, label + 1 AS category_id, x1 AS x, y1 AS y, x2-x1 AS w, y2-y1 AS h, (x2-x1)*(y2-y1) AS area, (CASE WHEN qty % 3 > 0 THEN qty % 3 - 1 ELSE 0 END)::INTEGER AS iscrowd FROM boxes"""),
    "s10_panoptic": (panoptic, f"WITH {V.BOXES} SELECT image_id, 'i'||image_id AS stem, 400 AS width, 500 AS height, det AS segment_id, label AS category_id, 0 AS iscrowd, qty AS area FROM boxes"),
    "s11_image_tsv": (image_tsv, f"WITH {V.GRIDS} SELECT 'k'||vec_id AS key, CASE WHEN vec_id % 9 > 0 THEN (vec_id % 9)::INTEGER END AS label, md5(unhex(array_to_string(list_transform(g, lambda x: printf('%02X', x)), ''))) AS md5 FROM grids"),
    "s12_results": (results, f"WITH {V.BOXES} SELECT image_id, label AS category_id, x1 AS x, y1 AS y, x2-x1 AS w, y2-y1 AS h, {_Q.format('score')} FROM boxes"),
    "s13_ap_text": (ap_text, f"WITH {_LOG}, m AS (SELECT run, epoch, max_by(ap, line_no) AS ap FROM lg WHERE line_no % 11 <> 0 GROUP BY ALL) SELECT run, epoch, {_Q.format('ap')} FROM m"),
    "s14_free_text": (free_text, f"WITH {_LOG} SELECT run, dataset, epoch, {_Q.format('ap')} FROM lg"),
    "s15_loss_csv": (loss_csv, f"WITH {_LOG}, m AS (SELECT run, epoch, ap AS train_loss, ap / 2 AS val_loss FROM lg WHERE line_no % 11 <> 0 AND line_no % 13 <> 0) SELECT run, epoch, {_Q.format('train_loss')}, {_Q.format('val_loss')}, 0.001::DOUBLE AS lr FROM m"),
    "s16_json_logs": (json_logs, f"WITH {_LOG} SELECT run, dataset, epoch, {_Q.format('ap')} FROM lg"),
    "s17_appended": (appended, f"WITH {V.RUN_LOG} SELECT dataset, epoch, {_Q.format('ap')} FROM run_log"),
}
