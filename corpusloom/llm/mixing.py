"""Mixing sources to target weights (problem 8).

Every record gets a hash-random key; records are range-sorted by source and key, token counts are summed up by distributed
prefix sums, and each source is cut at its exact budget, in as many epochs as it needs.

The size of the mixture is the largest at which no source needs more than its max_repeats epochs, unless total_tokens is given.

Defined results: records with a null source, a source not listed or no token are unused; rows of the specification with a null
or non-positive weight, or max_repeats below 1, are unused, and of repeated rows the largest values count; weights are scaled to
sum to 1; listed sources without any token can't be used, and their weight is shared by the others; other columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.encoding import token_counts
from corpusloom.session import Stages

#: A specification is configuration; one of more rows than this is refused rather than sent to every executor.
SPEC_ROWS = 10_000


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Prefix sums inside one sorted partition, by source, carried from batch to batch."""
    from pyspark import TaskContext

    part, carry = TaskContext.get().partitionId(), {}
    for pdf in batches:
        ends = pdf.groupby("source", sort=False)["n_tokens"].cumsum() + pdf["source"].map(carry).fillna(0).astype("int64")
        carry.update(dict(zip(pdf["source"], ends, strict=True)))
        yield pdf.assign(part=part, local_end=ends.astype("int64"))


def mixture(documents: DataFrame, spec: DataFrame, total_tokens: int | None = None, seed: int = 42, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, uses) of every record in the mixture; uses is the number of epochs that it is in.

    Range partitions split a source of any size evenly; of each partition only its sum by source goes into the second,
    small sum. Neither texts nor ids of tokens are shuffled.
    """
    stages = Stages(documents.sparkSession)
    wanted = spec.where("source IS NOT NULL AND weight > 0 AND max_repeats >= 1").groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").cast("long").alias("max_repeats"))
    if wanted.limit(SPEC_ROWS + 1).count() > SPEC_ROWS:
        raise ValueError(f"the specification has more than {SPEC_ROWS} sources")
    listed = documents.join(F.broadcast(wanted.select("source")), "source", "left_semi")
    sized = stages.write(token_counts(listed, ["doc_id", "source"], ranks_path=ranks_path).where("n_tokens > 0").withColumn("key", F.xxhash64(F.lit(seed), "doc_id")))
    ranged = sized.repartitionByRange("source", "key", "doc_id").sortWithinPartitions("source", "key", "doc_id")
    placed = stages.write(ranged.mapInPandas(_running, T.StructType(sized.schema.fields + [T.StructField("part", T.IntegerType()), T.StructField("local_end", T.LongType())])))
    sums = placed.groupBy("source", "part").agg(F.sum("n_tokens").alias("n")).selectExpr("source", "part", "sum(n) OVER (PARTITION BY source ORDER BY part) - n AS base")
    have = placed.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    plan = wanted.join(have, "source").selectExpr("source", "available", "max_repeats", "weight / sum(weight) OVER (PARTITION BY 1) AS share")
    size = F.lit(float(total_tokens)) if total_tokens is not None else F.expr("min(available * max_repeats / share) OVER (PARTITION BY 1)")
    plan = plan.withColumn("size", size).withColumn("budget", F.least(F.floor(F.col("share") * F.col("size") + 1e-6), F.col("available") * F.col("max_repeats")))
    ends = placed.join(sums, ["source", "part"]).join(F.broadcast(plan), "source").withColumn("end", F.col("base") + F.col("local_end"))
    left = F.col("budget") - F.col("end") + F.col("n_tokens") / 2  # the record at the cut is in if most of it is
    uses = F.when(left >= 0, F.least(F.floor(left / F.col("available")) + 1, F.col("max_repeats"))).otherwise(0)
    return ends.select("doc_id", "source", "n_tokens", uses.cast("int").alias("uses")).where("uses > 0")


def shares(mixed: DataFrame, spec: DataFrame) -> DataFrame:
    """For each listed source its weight and what the mixture has of it: records, uses, tokens and share actually reached."""
    got = mixed.groupBy("source").agg(F.count("*").alias("n_records"), F.max("uses").alias("most_uses"), F.sum(F.col("n_tokens") * F.col("uses")).alias("n_tokens"))
    total = got.agg(F.sum("n_tokens").alias("total"))
    named = spec.where("source IS NOT NULL").groupBy("source").agg(F.max("weight").alias("weight"))
    return named.join(got, "source", "left").crossJoin(F.broadcast(total)).select("source", "weight", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_records", "most_uses", "n_tokens")), F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)).alias("share"))
