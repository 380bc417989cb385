"""Seeded draws as column expressions: a retried task draws the same, and SQL can repeat them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dice(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends on seed and keys only: 28 bits of an MD5 digest."""
    text = F.concat_ws("|", F.lit(seed).cast("string"), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("double") / float(1 << 28)
