"""Adapters: the supplied tables seen as frames, descriptors, boxes and run logs. Spark and SQL forms of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import parts_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, scan, frame_idx, ord, phash, md5, blank: a frame per event, a scan per user."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('f', event_id) AS key",
        "concat('bt', user_id % 7, CASE WHEN user_id % 25 = 0 THEN '/lab6_u' ELSE '/u' END, user_id) AS scan",
        "event_id AS frame_idx",
        "event_id AS ord",
        "CAST(floor(value) AS BIGINT) AS phash",
        "md5(concat_ws('|', user_id, event_type, CAST(floor(value) AS BIGINT))) AS md5",
        "value < 3 AS blank",
    )


FRAMES = """frames AS (SELECT 'f'||event_id AS key,
    'bt'||(user_id % 7)||CASE WHEN user_id % 25 = 0 THEN '/lab6_u' ELSE '/u' END||user_id AS scan,
    event_id AS frame_idx, event_id AS ord, CAST(floor(value) AS BIGINT) AS phash,
    md5(user_id||'|'||event_type||'|'||CAST(floor(value) AS BIGINT)) AS md5, value < 3 AS blank FROM events)"""


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, scan, frame_idx, is_eval, v (64 doubles, an 8 x 8 grid), sign hash of 62 bits. Every twentieth vector is a query (is_eval)."""
    v = F.col("embedding").cast("array<double>")
    bits = [F.when(F.get(F.col("v"), F.lit(i)) > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(62)]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("scan"), v.alias("v"), (F.col("vec_id") % 20 == 0).alias("is_eval"))
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return rows.select("vec_id", "scan", F.col("vec_id").alias("frame_idx"), "is_eval", "v", total.alias("phash"))


DESCRIPTORS = """descriptors AS (SELECT vec_id, label AS scan, vec_id AS frame_idx, vec_id % 20 = 0 AS is_eval, embedding::DOUBLE[] AS v,
    list_sum(list_transform(range(62), lambda i: CASE WHEN embedding[i+1] > 0 THEN (1::BIGINT << i) ELSE 0::BIGINT END))::BIGINT AS phash FROM embeddings)"""


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, h, w, g (64 levels from 0 to 255, row by row), pixels (the same as bytes): an 8 x 8 frame per vector; 0 is no data."""
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    g = F.transform(v, lambda x: F.when(x < 0.02, 0).otherwise(F.least(F.floor(x * 600) + 1, F.lit(255))).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("h"), F.lit(8).alias("w"), F.slice(g, 1, 64).alias("g"))
    return rows.withColumn("pixels", F.unhex(F.array_join(F.transform("g", lambda x: F.lpad(F.hex(x), 2, "0")), "")))


GRIDS = """grids AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN abs(x) < 0.02 THEN 0 ELSE least(floor(abs(x) * 600) + 1, 255) END::INTEGER)[1:64] AS g FROM embeddings)"""


def long_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, r, c, x: the 8 x 8 grid a row per pixel; |value| below 0.02 is no data (0)."""
    rows = descriptors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("pos", "x"))
    return rows.select("vec_id", F.floor(F.col("pos") / 8).cast("int").alias("r"), (F.col("pos") % 8).alias("c"), F.when(F.abs("x") < 0.02, 0.0).otherwise(F.col("x")).alias("x"))


LONG_PIXELS = DESCRIPTORS + """, long_pixels AS (SELECT vec_id, (i - 1)::INTEGER // 8 AS r, ((i - 1) % 8)::INTEGER AS c,
    CASE WHEN abs(v[i]) < 0.02 THEN 0.0 ELSE v[i] END AS x FROM (SELECT vec_id, v, unnest(range(1, 65)) AS i FROM descriptors))"""


def boxes(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """image_id, det, x1..y2, label, score, cents, qty, flag: detections of an image per order.

    spread: images are dealt to partitions of bounded size, whatever the table's; queries that do without det have no need of it.
    """
    # narrow rows are numbered, under the name of the result: what is grouped by image afterwards need not be shuffled again
    w = Window.partitionBy("image_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    lines = table(spark, sf_dir, "lineitem")
    b = lines.select(
        F.col("l_orderkey").alias("image_id"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
        F.col("l_quantity").cast("long").alias("qty"),
        F.round(F.col("l_tax") * 100).cast("long").alias("tax"),
        F.round(F.col("l_discount") * 100).cast("long").alias("disc"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("label"),
        F.col("l_returnflag").alias("flag"),
    )
    if spread and (n := parts_for(lines)):
        b = b.repartition(n, "image_id")
    b = b.withColumn("det", F.row_number().over(w).cast("long")).withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long"))
    return b.select(
        "image_id", "det",
        (F.col("cents") % 200).cast("double").alias("x1"),
        (F.col("qty") * 4).cast("double").alias("y1"),
        (F.col("cents") % 200 + 20 + F.col("tax") * 5).cast("double").alias("x2"),
        (F.col("qty") * 4 + 30 + F.col("disc") * 6).cast("double").alias("y2"),
        "label",
        (((F.col("cents") * 7919) % 10007).cast("double") / F.lit(10007.0)).alias("score"),
        "cents", "qty", "flag",
    )


BOXES = """b0 AS (SELECT l_orderkey AS image_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_shipdate)::BIGINT AS det,
    CAST(round(l_extendedprice*100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS qty,
    CAST(round(l_tax*100) AS BIGINT) AS tax, CAST(round(l_discount*100) AS BIGINT) AS disc, l_linestatus, l_returnflag AS flag FROM lineitem),
boxes AS (SELECT image_id, det, CAST(cents%200 AS DOUBLE) AS x1, CAST(qty*4 AS DOUBLE) AS y1,
    CAST(cents%200+20+tax*5 AS DOUBLE) AS x2, CAST(qty*4+30+disc*6 AS DOUBLE) AS y2,
    CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END AS label, CAST((cents*7919)%10007 AS DOUBLE)/CAST(10007 AS DOUBLE) AS score, cents, qty, flag FROM b0)"""


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, gt, x1..y2, label, level: the boxes with flag A or N, moved by a few pixels."""
    b = boxes(spark, sf_dir).where(F.col("flag").isin("A", "N"))
    return b.select("image_id", F.col("det").alias("gt"), *[(F.col(c) + F.col("cents") % 5).alias(c) for c in ("x1", "y1", "x2", "y2")], "label", (F.col("qty") % 3 + 1).cast("int").alias("level"))


TRUTHS = BOXES + """, truths AS (SELECT image_id, det AS gt, x1 + cents % 5 AS x1, y1 + cents % 5 AS y1, x2 + cents % 5 AS x2, y2 + cents % 5 AS y2,
    label, (1 + qty % 3)::INTEGER AS level FROM boxes WHERE flag IN ('A','N'))"""


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes as detections and, next to them, as `truths`: image_id, is_gt, id, x1..y2, score, label (-1 of a truth). The table is read and dealt out once."""
    b = boxes(spark, sf_dir, spread=True)
    row = lambda is_gt, score, label, moved: F.struct(
        F.lit(is_gt).alias("is_gt"), F.col("det").alias("id"), *[(F.col(c) + moved).alias(c) for c in ("x1", "y1", "x2", "y2")], score.alias("score"), label.alias("label")
    )
    truth = F.when(F.col("flag").isin("A", "N"), row(True, F.lit(0.0), F.lit(-1), F.col("cents") % 5))
    return b.select("image_id", F.inline(F.array_compact(F.array(row(False, F.col("score"), F.col("label"), F.lit(0.0)), truth))))


def matches(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """dataset, image_id, det, kind, score, level, xc, yc: stored match results (flag A found, N false, R missed)."""
    b = boxes(spark, sf_dir, spread)
    return b.select(
        F.when(F.col("image_id") % 5 == 0, "organic").otherwise("41").alias("dataset"),
        "image_id", "det",
        F.when(F.col("flag") == "A", "tp").when(F.col("flag") == "N", "fp").otherwise("fn").alias("kind"),
        F.when(F.col("flag") != "R", F.col("score")).alias("score"),
        F.when(F.col("flag") != "N", (F.col("qty") % 3 + 1).cast("int")).alias("level"),
        ((F.col("x1") + F.col("x2")) / 2).alias("xc"),
        ((F.col("y1") + F.col("y2")) / 2).alias("yc"),
        "label",
    )


MATCHES = BOXES + """, matches AS (SELECT CASE WHEN image_id % 5 = 0 THEN 'organic' ELSE '41' END AS dataset, image_id, det,
    CASE flag WHEN 'A' THEN 'tp' WHEN 'N' THEN 'fp' ELSE 'fn' END AS kind, CASE WHEN flag <> 'R' THEN score END AS score,
    CASE WHEN flag <> 'N' THEN (1 + qty % 3)::INTEGER END AS level, (x1 + x2) / 2 AS xc, (y1 + y2) / 2 AS yc, label FROM boxes)"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, dataset, epoch, ap, line_no: one row per run, dataset and epoch (the last line wins)."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("dataset"),
        F.floor(F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")) / 30).cast("long").alias("epoch"),
        (F.col("o_totalprice") / F.lit(500000.0)).alias("ap"), F.col("o_orderkey").alias("line_no"),
    )
    return rows.groupBy("run", "dataset", "epoch").agg(F.max_by("ap", "line_no").alias("ap"), F.max("line_no").alias("line_no"))


RUN_LOG = """run_log AS (SELECT run, dataset, epoch, max_by(ap, line_no) AS ap, max(line_no) AS line_no FROM (
    SELECT o_orderpriority AS run, o_orderstatus AS dataset, (date_diff('day', DATE '1990-01-01', o_orderdate::DATE) // 30)::BIGINT AS epoch,
    o_totalprice / 500000.0::DOUBLE AS ap, o_orderkey AS line_no FROM orders) GROUP BY ALL)"""
