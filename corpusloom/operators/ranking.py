"""Ranks by hash in two levels: counts of hash buckets, and ranks inside them, so that no window holds a whole group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket has on average at most.
BUCKET_ROWS = 1_000_000


def digits_for(rows: int) -> int:
    """Leading hex digits of a hash that part that many rows of one group into buckets of bounded size; three at least."""
    return max(3, math.ceil(math.log(max(1, rows) / BUCKET_ROWS, 16)))


def hash_ranks(rows: DataFrame, by: list[str], tie: str, digits: int = 3, h: str = "h") -> DataFrame:
    """rows with ``rank``, from 1, in the order of the hex hash ``h`` and ``tie`` within each group of ``by``."""
    keyed = rows.withColumn("bucket", F.substring(h, 1, digits))
    sizes = keyed.groupBy(*by, "bucket").agg(F.count("*").alias("c"))  # 16 ** digits rows a group at most
    group = [F.col(c) for c in by] or [F.lit(1)]
    base = sizes.select(*by, "bucket", (F.sum("c").over(Window.partitionBy(*group).orderBy("bucket")) - F.col("c")).alias("base"))
    inside = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy(h, tie))
    return keyed.withColumn("inside", inside).join(base, [*by, "bucket"]).withColumn("rank", F.col("base") + F.col("inside")).drop("bucket", "inside", "base")
