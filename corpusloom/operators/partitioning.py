"""Partitions by content hash, hot keys, salting and how even partitions are. A null key is taken as an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.settings import Compute

PARTITIONS, REPEAT, HOT_SHARE = Compute.partitions, Compute.repeat, Compute.hot_share
HOT = "hot-key"


def expanded(docs: DataFrame, total: DataFrame, repeat: int = REPEAT, hot: float = HOT_SHARE) -> DataFrame:
    """Every document ``repeat`` times; the first rows, a share of ``hot``, get one key. docs: ordinal (from 0), source_id, domain, n_chars."""
    each = docs.crossJoin(F.broadcast(total)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1)))).withColumn("row_id", F.col("k") * F.col("n") + F.col("ordinal"))
    key = F.when(F.col("row_id") < F.floor(F.col("n") * repeat * F.lit(hot)), F.lit(HOT)).otherwise(F.col("source_id"))
    return each.select(F.col("row_id").cast("long").alias("row_id"), "source_id", "domain", F.col("n_chars").alias("char_count"), key.alias("join_key"))


def salted(rows: DataFrame, parts: int = PARTITIONS) -> DataFrame:
    """rows with the plain partition, the salted key and its partition."""
    key = F.when(F.col("join_key") == HOT, F.concat(F.lit(f"{HOT}:"), (F.col("row_id") % parts).cast("string"))).otherwise(F.col("join_key"))
    return rows.withColumn("salted_key", key).withColumn("part", X.hash_partition("join_key", parts)).withColumn("salted_part", X.hash_partition("salted_key", parts))


def distribution(rows: DataFrame, column: str, parts: int = PARTITIONS) -> DataFrame:
    """One row: the fewest and most rows of a partition, the ratio of the most to the mean, and how many are empty."""
    counts = rows.groupBy(F.col(column).alias("p")).agg(F.count("*").alias("c"))
    every = rows.sparkSession.range(parts).select(F.col("id").cast("int").alias("p")).join(counts, "p", "left").select("p", F.coalesce("c", F.lit(0)).alias("c"))
    return every.agg(F.min("c").alias("least"), F.max("c").alias("most"), F.bround(F.coalesce(F.try_divide(F.max("c"), F.avg("c")), F.lit(0.0)), 6).alias("max_mean_ratio"), F.count_if(F.col("c") == 0).alias("n_empty"))
