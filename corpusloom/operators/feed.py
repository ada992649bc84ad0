"""Feeding batches, percentiles, line indexes and comparisons of training runs. Empty tables give empty or zero results."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.ranking import hash_ranks
from corpusloom.session import Stages


def epochs(rows: DataFrame, n: int) -> DataFrame:
    """Every row once for each epoch, without a join."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def workers(shards: DataFrame, n: int) -> DataFrame:
    """Shards dealt to workers in strides."""
    return shards.withColumn("worker", (F.col("shard") % n).cast("int"))


def schedule(rows: DataFrame, n: int, batch: int, seed: int, digits: int = 3) -> DataFrame:
    """(epoch, step, id): a hash-random order of each epoch, cut in batches; ranks come in two levels, so that an epoch isn't one task."""
    keyed = epochs(rows, n).withColumn("h", X.seeded_rank(seed, F.col("epoch").cast("string"), F.col("id").cast("string")))
    return hash_ranks(keyed, ["epoch"], "id", digits).select("epoch", F.floor((F.col("rank") - 1) / batch).alias("step"), "id")


def percentiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, p50, p99, median): nearest-rank percentiles from value counts, so that no list of a group's values is built.

    Counts are sorted over all tasks by group and value; running counts start in each range from the sum of the ranges before, so that
    a group of any size is many tasks' work. The ranges are staged, as their limits come from a sample.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    ranged = Stages(rows.sparkSession).write(counts.repartitionByRange(group, value).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy(group).agg(F.sum("c").alias("n"))
    sums = ranged.groupBy(group, "part").agg(F.sum("c").alias("s"))
    base = sums.select(group, "part", (F.sum("s").over(Window.partitionBy(group).orderBy("part")) - F.col("s")).alias("base"))
    inside = F.sum("c").over(Window.partitionBy(group, "part").orderBy(value))
    upto = ranged.withColumn("inside", inside).join(base, [group, "part"]).withColumn("cum", F.col("base") + F.col("inside"))
    first = lambda rank: F.min(F.when(F.col("cum") > rank, F.col(value)))
    at = lambda p: first(F.bround((F.col("n") - 1) * F.lit(p)))
    lo, hi = first(F.floor((F.col("n") - 1) / 2)), first(F.ceil((F.col("n") - 1) / 2))
    return upto.join(totals, group).groupBy(group).agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.99).alias("p99"), ((lo + hi) / 2).alias("median"))


def ordered_by(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """rows in the order of a list of ids (key, position), one for each place of the list; an id without a row is an error."""
    j = ids.join(rows.withColumn("_known", F.lit(True)), key, "left")
    lost = F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string"))).cast("boolean")
    return j.where(F.coalesce("_known", lost)).drop("_known").orderBy("position")


def batches(rows: DataFrame, size: int) -> Iterator[list]:
    """Batches of rows for a training loop; the next partition is fetched while one is used."""
    held = []
    for row in rows.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def line_index(rows: DataFrame, path: str, order: str, line: str, *keep: str) -> DataFrame:
    """(path, line_number, offset, length) of lines in files of bounded size, with the columns to keep."""
    w = Window.partitionBy(path).orderBy(order)
    size = F.octet_length(line) + 1
    return rows.select(path, (F.row_number().over(w) - 1).cast("long").alias("line_number"), (F.sum(size).over(w) - size).cast("long").alias("offset"), size.cast("long").alias("length"), *keep)


def run_means(losses: DataFrame) -> DataFrame:
    """(sequence_id, baseline, candidate, delta): means over all seeds and their difference."""
    mean = lambda run: F.avg(F.when(F.col("run") == run, F.col("loss")))
    every = losses.groupBy("sequence_id").agg(mean("baseline").alias("b"), mean("candidate").alias("c"))
    both = every.where("b IS NOT NULL AND c IS NOT NULL")  # one_sided() has the others, for which the reference raises
    return both.select("sequence_id", F.bround("b", 6).alias("baseline"), F.bround("c", 6).alias("candidate"), F.bround(F.col("c") - F.col("b"), 6).alias("delta"))


def one_sided(losses: DataFrame) -> DataFrame:
    """Sequences that only one of the two runs has a loss of."""
    has = lambda run: F.count_if((F.col("run") == run) & F.col("loss").isNotNull()) > 0
    sides = losses.groupBy("sequence_id").agg(has("baseline").alias("in_baseline"), has("candidate").alias("in_candidate"))
    return sides.where("in_baseline <> in_candidate")


def masked_mean(losses: Column, mask: Column) -> Column:
    """The mean of the unmasked losses of two arrays; null where nothing is unmasked."""
    total = F.aggregate(F.zip_with(losses, mask, lambda x, m: x * m), F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.aggregate(mask, F.lit(0), lambda a, x: a + x))
