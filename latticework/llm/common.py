"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; driver and executors of a cluster have no other one in common."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/latticework/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write a frame to the shared folder and read it back: later stages survive a lost executor."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def free_name(taken: Iterable[str], name: str) -> str:
    """The name with `_` added until no column has it, capitals aside."""
    taken = {x.lower() for x in taken}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text) -> "F.Column":
    """Array of the words of a text; null gives an empty array."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
