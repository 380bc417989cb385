"""Sources and sinks: shards to corpus, annotations, logs, streaming."""

import io
import json
import os
import tarfile

import numpy as np

from latticework.functions import pixels as X
from latticework.operators import curation as C
from latticework.sources import readers as R
from latticework.sources import sinks as S
from latticework.streaming.curation import decimate_stream, running_best_stream

from .test_kernels import RNG, frame, png


def add(tar, name, data):
    info = tarfile.TarInfo(name)
    info.size = len(data)
    tar.addfile(info, io.BytesIO(data))


def shards(folder):
    base = frame()
    for t in range(2):
        with tarfile.open(folder / f"shard{t}.tar", "w") as tar:
            for k in range(5):
                img = np.where(base > 0, (base.astype(int) + 20 * k * (np.arange(1024) // 128 % 2) + t).clip(1, 255), 0).astype(np.uint8)
                add(tar, f"m{t}_{k}.png", png(img))
                add(tar, f"m{t}_{k}.json", json.dumps({"source": f"beamtimes/bt{t}/raw/s/x/pe/foo-{k:05d}.tif", "beamtime": f"bt{t}", "q_max": 3.1}).encode())
            add(tar, f"d/p__q__name{t}.raw.png", png(base))
            add(tar, "broken.png", b"\x89PNG\r\n\x1a\nxx")
            add(tar, f"blank{t}.png", png(np.zeros((16, 16), np.uint8)))
            add(tar, f"rgb{t}.png", png(RNG.integers(0, 256, (16, 32, 3), dtype=np.uint8)))
            add(tar, f"rgb{t}.json", b"not json")
    return str(folder)


def test_small_ranges_share_tasks(spark, tmp_path):
    """many small shards, each of several ranges, are read by a bounded number of tasks; no frame is lost."""
    for t in range(60):
        with tarfile.open(tmp_path / f"shard{t}.tar", "w") as tar:
            for k in range(6):
                add(tar, f"m{t}_{k}.png", png(np.full((16, 16), t + k, np.uint8)))
                add(tar, f"m{t}_{k}.json", json.dumps({"q_max": float(k)}).encode())
    frames = R.shards(spark, str(tmp_path), stream_from=0, range_bytes=2048)
    assert 2 < frames.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    got = sorted((r.tar, r.pos, r.key, r.q_max, r.pixels[0]) for r in frames.collect())
    assert got == sorted((f"shard{t}.tar", 2 * k, f"m{t}_{k}.png", float(k), t + k) for t in range(60) for k in range(6))


def test_shards_to_corpus(spark, tmp_path):
    frames = R.shards(spark, shards(tmp_path)).cache()
    rows = {r.key: r for r in frames.drop("pixels").collect()}
    assert len(rows) == 16 and "broken.png" not in rows
    assert rows["m1_3.png"].scan == "bt1/s/x" and rows["m1_3.png"].frame_idx == 3 and abs(rows["m1_3.png"].q_max - 3.1) < 1e-6
    assert rows["d/p__q__name0.raw.png"].is_raw and rows["d/p__q__name0.raw.png"].scan == "p/q" and np.isnan(rows["blank0.png"].q_max) and rows["blank0.png"].frame_idx == 0
    assert R.shards(spark, str(tmp_path), ["shard1"]).count() == 8
    # byte ranges: siblings and members of a range lie anywhere, and one shard is read by many tasks
    ranges = R.shards(spark, str(tmp_path), stream_from=0, range_bytes=100_000)
    assert sorted(map(str, ranges.drop("pixels").collect())) == sorted(map(str, rows.values()))
    assert {r.key: bytes(r.pixels) for r in ranges.collect()} == {r.key: bytes(r.pixels) for r in frames.collect()}
    assert R.shards(spark, str(tmp_path), ["shard1"], stream_from=0, range_bytes=100_000).select(C.F.spark_partition_id()).distinct().count() > 2
    prints = X.fingerprints(frames.select("key", "h", "w", "pixels"))
    named = frames.drop("pixels").join(prints, "key").withColumn("ord", (C.F.substring("tar", 6, 1).cast("long") * 1000 + C.F.col("pos")))
    m = C.manifest_b(named.select("key", "scan", C.F.col("frame_idx").cast("long").alias("frame_idx"), "ord", "phash", "md5", "blank"), 3)
    reasons = {r.key: r.reason for r in m.collect()}
    assert reasons["d/p__q__name1.raw.png"] == "exact_dup" and reasons["blank0.png"] == "blank" and "within_scan_subsampled" in reasons.values()
    corpus = S.corpus(frames, m)
    S.write_corpus(corpus, str(tmp_path / "corpus"))
    out = spark.read.parquet(str(tmp_path / "corpus"))
    assert out.count() == sum(v == "keep" for v in reasons.values()) and {(r.h, r.w, len(r.pixels)) for r in out.collect()} == {(512, 1024, 512 * 1024)}
    S.write_manifest(m, str(tmp_path / "m"))
    S.write_keep_list(m, str(tmp_path / "k"))
    assert spark.read.csv(str(tmp_path / "m/tsv"), sep="\t", header=True).columns == ["keep", "reason", "scan", "frame_idx", "key"]
    assert spark.read.text(str(tmp_path / "k")).count() == out.count()
    a = {r.key: r.pixels for r in X.augmented(frames.select("key", "h", "w", "pixels"), 3).collect()}
    b = {r.key: r.pixels for r in X.augmented(frames.select("key", "h", "w", "pixels").repartition(5), 3, 1).collect()}
    assert a == b and X.thumbnails(frames.select("key", "h", "w", "pixels")).count() == 16
    frames.unpersist()


def test_annotations(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 40, "height": 30}], "annotations": [{"id": 9, "image_id": 1, "bbox": [1, 2, 3, 4], "category_id": 3, "area": 12.0, "iscrowd": 0}, {"id": 10, "image_id": 1, "bbox": [0, 0, 9, 9], "category_id": 4, "area": 81.0}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    rows = R.coco(spark, str(tmp_path / "c.json")).orderBy("ann_id").collect()
    assert [(r.x, r.y, r.w, r.h, r.iscrowd) for r in rows] == [(1, 2, 3, 4, 0), (0, 0, 9, 9, 0)]
    pan = {"images": doc["images"], "annotations": [{"file_name": "a.png", "segments_info": [{"id": 5, "category_id": 2, "iscrowd": 0, "area": 7}]}]}
    (tmp_path / "p.json").write_text(json.dumps(pan))
    assert [(r.image_id, r.segment_id) for r in R.coco_panoptic(spark, str(tmp_path / "p.json")).collect()] == [(1, 5)]
    (tmp_path / "t.tsv").write_text(f"k1\t3\tx\t{R.encode_image(b'abc')}\nk2\tbad\t{R.encode_image(b'z')}\n")
    assert [(r.key, r.label, bytes(r.image)) for r in R.image_tsv(spark, str(tmp_path / "t.tsv")).orderBy("key").collect()] == [("k1", 3, b"abc"), ("k2", None, b"z")]
    dets = spark.createDataFrame([(1, 1.0, 2.0, 4.0, 6.0, 0.5, 0)], "image_id long, x1 double, y1 double, x2 double, y2 double, score double, label int")
    S.write_coco_results(dets, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).collect()[0].bbox == [1, 2, 3, 4]
    S.write_report(dets.withColumn("best", C.F.array("image_id")), str(tmp_path / "rep"))
    assert spark.read.csv(str(tmp_path / "rep"), header=True).collect()[0].best == "[1]"


def test_logs(spark, tmp_path):
    (tmp_path / "ap.txt").write_text("12\t0.5\nbad line here\n13.0 0.6\n12 0.7\nx 1\n14\n")
    assert {(r.epoch, r.ap) for r in R.ap_text(spark, str(tmp_path / "ap.txt")).collect()} == {(12, 0.7), (13, 0.6)}
    for k, name in enumerate(("runa_1.out", "runa_2.out")):
        (tmp_path / name).write_text(f"noise\n[epoch 1] organic ap_total = 0.{k}5\n[epoch 1] 41 ap_total = 0.9\n")
        os.utime(tmp_path / name, (1000 + k, 1000 + k))
    rows = R.free_text(spark, str(tmp_path / "*.out"), C.F.regexp_extract("file", r"^([a-z]+)_", 1)).collect()
    assert {(r.dataset, r.ap) for r in rows} == {("organic", 0.15), ("41", 0.9)}
    (tmp_path / "l.csv").write_text("epoch,train,val\n1,0.5,0.4\n2,0.3\n3,0.2,0.1,0.001,9\n")
    assert [(r.epoch, r.val_loss, r.lr) for r in R.loss_csv(spark, str(tmp_path / "l.csv")).orderBy("epoch").collect()] == [(1, 0.4, None), (3, 0.1, 0.001)]
    (tmp_path / "run7").mkdir()
    (tmp_path / "run7/log.txt").write_text('{"epoch": 1, "loss": 2.5}\n')
    assert R.json_logs(spark, str(tmp_path / "run7")).collect()[0].run == "run7"
    good = spark.createDataFrame([(1, 0.5)], "epoch int, ap double")
    done = S.append_metrics({"41": good, "organic": good.drop("ap"), "third": good}, str(tmp_path / "metrics"))
    done2 = S.append_metrics({"41": good}, str(tmp_path / "metrics"))
    assert done == {"41": True, "organic": False, "third": True} and done2["41"] and spark.read.parquet(str(tmp_path / "metrics/41")).count() == 2


def test_paths(spark):
    cases = [("beamtimes/bt1/raw/sampleA/x/pe/foo-00012.tif", "bt1/sampleA/x", 12), ("beamtimes/bt1/Converted/s/pe/foo-7.raw.tif", "bt1/s", 7), ("tensor/bt2/a/b/frame_f003.pt", "bt2/a/b", 3), ("d/p__q__name0042.png", "p/q", 42), ("plain.png", "plain.png", -1)]
    both = cases[:3] + [
        ("tensor/bt1/s1/x_f12.png", "bt1/s1", 12), ("TENSOR/bt1/s1/x_7.tif", "bt1/s1", 7), ("beamtimes/b/raw/s/pe/sub/x-00012.tif", "b/s", 12),
        ("beamtimes/b/converted/s/a/pe/x-1-2.tif", "b/s/a", 2), ("beamtimes/b/RAW/s/pe/y/pe/z-3.tif", "b/s", 3),
    ]
    by_name = cases[3:] + [("a/p__q__12a.png", "p/q", 12), ("a__b.raw__c.raw.png", "a/b", -1), ("two__7.x.png", "two__7.x.png", 7)]
    rows = [(c[0], None) for c in both + by_name] + [("k.png", c[0]) for c in both] + [(c[0], "some/other_9.dat") for c in by_name]
    scan, number = X.parse_scan()
    got = [(r.s, r.n) for r in spark.createDataFrame(rows, "key string, source string").select(scan.alias("s"), number.alias("n")).collect()]
    assert got == [(c[1], c[2]) for c in both + by_name + both + by_name]


def test_streams(spark, tmp_path):
    rows = [(f"k{i}", f"s{i % 2}", i, i, (i * 37) % 64) for i in range(40)]
    schema = "key string, scan string, frame_idx long, ord long, phash long"
    batch = {r.key: r.kept for r in C.flag_decimated(spark.createDataFrame(rows, schema), 2).collect()}
    for part in range(2):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    src = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = decimate_stream(src, 2).writeStream.format("memory").queryName("dec").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.key: r.kept for r in spark.sql("SELECT * FROM dec").collect()} == batch
    spark.createDataFrame([("a", 1, 0.2), ("a", 2, 0.1), ("a", 3, 0.4)], "run string, epoch long, ap double").write.parquet(str(tmp_path / "log"))
    s = spark.readStream.schema("run string, epoch long, ap double").parquet(str(tmp_path / "log"))
    q = running_best_stream(s).writeStream.format("memory").queryName("best").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.epoch for r in spark.sql("SELECT * FROM best ORDER BY epoch").collect()] == [1, 3]
