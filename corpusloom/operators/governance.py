"""Admission by quality marks, mixing by quotas, and policies over admitted records.

Nulls: a missing licence isn't allowed, missing safety counts as safe when the record has no such field at all and as unsafe when
it is null; reasons are sorted and distinct. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.ranking import hash_ranks
from corpusloom.settings import Audit

def reasons(setting: Audit) -> Column:
    """The marks against a document, as a sorted array. The reasons' names are fixed values."""
    say = lambda cond, word: F.when(cond, F.lit(word))
    return F.array_sort(F.array_compact(F.array(
        say(F.length("text") < setting.min_chars, "too_short"),
        say(~F.coalesce(F.col("license").isin(*setting.licenses), F.lit(False)), "license_not_allowed"),
        say(F.coalesce(F.col("safety"), F.lit("")) != "safe", "unsafe_metadata"),
        say(X.has_email("text") | X.has_phone("text"), "pii_detected"),
    )))


def decided(docs: DataFrame, duplicates: DataFrame, contaminated: DataFrame, setting: Audit) -> DataFrame:
    """source_id, domain, reasons, decision: marks, membership in a cluster without being its keeper, and contamination together."""
    marked = docs.select("source_id", "pos", "domain", reasons(setting).alias("own"))
    joined = marked.join(duplicates.select("source_id", F.lit("near_duplicate").alias("d")).distinct(), "source_id", "left").join(contaminated.select("source_id", F.lit("evaluation_contamination").alias("c")).distinct(), "source_id", "left")
    every = F.array_sort(F.array_distinct(F.concat("own", F.array_compact(F.array("d", "c")))))
    return joined.select("source_id", "pos", "domain", every.alias("reasons")).withColumn("decision", F.when(F.size("reasons") == 0, "accept").otherwise("reject"))


def quotas(weights: DataFrame, total: DataFrame) -> DataFrame:
    """(source, weight, quota): largest remainders of the total, ties by name. The specification is small by nature."""
    exact = weights.crossJoin(F.broadcast(total)).select("source", "weight", "total", (F.col("weight") * F.col("total")).alias("x")).withColumn("base", F.floor("x"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.bround(F.col("x") - F.col("base"), 9).desc(), "source")
    left = F.col("total") - F.sum("base").over(Window.partitionBy(F.lit(1)))
    return exact.withColumn("extra", (F.row_number().over(w) <= left).cast("long")).select("source", "weight", (F.col("base") + F.col("extra")).cast("long").alias("quota"))


def selected(docs: DataFrame, quota: DataFrame, seed: int, digits: int = 3) -> DataFrame:
    """Of each source its quota of records, by hash rank, or all of them where it has fewer: the reference raises then, here
    shortages() says for each source how many are missing, and shares are the weights only where none is (see required()). Ranks come in two
    levels, so that a source that holds most of all rows is many tasks' work."""
    ranked = docs.join(F.broadcast(quota.select("source", "quota")), "source").withColumn("h", X.seeded_rank(seed, F.col("doc_id").cast("string")))
    placed = hash_ranks(ranked, ["source"], "doc_id", digits)
    return placed.where(F.col("rank") <= F.col("quota")).select("source", "doc_id", "h", F.col("rank").cast("long").alias("rank"))


def required(docs: DataFrame, quota: DataFrame) -> None:
    """Raises like the reference where a source has fewer records than its quota."""
    lacking = shortages(docs, quota).where("missing > 0").select("source", "missing").orderBy("source").collect()  # a row a source
    if lacking:
        raise ValueError("too few records: " + ", ".join(f"{r['source']} lacks {r['missing']}" for r in lacking))


def weights_checked(spec: DataFrame) -> DataFrame:
    """The specification, or an error if a weight isn't positive or they don't sum to 1. It is small by nature."""
    bad, total = spec.agg(F.count_if(F.coalesce(F.col("weight"), F.lit(0.0)) <= 0), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    if bad or abs(total - 1) > 1e-9:
        raise ValueError(f"weights must be positive and sum to 1: {bad} aren't, the sum is {total}")
    return spec


def shortages(docs: DataFrame, quota: DataFrame) -> DataFrame:
    """(source, quota, available, missing) of every source with a quota: how many records it has, and how many its quota lacks."""
    has = docs.groupBy("source").agg(F.count("*").alias("available"))
    both = quota.select("source", "quota").join(has, "source", "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long")))
    return both.withColumn("missing", F.greatest(F.col("quota") - F.col("available"), F.lit(0).cast("long")))


def split(ranked: DataFrame, fraction: float, digits: int = 3) -> DataFrame:
    """(source_id, part) of (source_id, h): the lowest max(1, min(n - 1, round(n * fraction))) by h, source_id are for validation, of
    a single record that one."""
    n = ranked.agg(F.count("*").alias("n"))
    wanted = n.select(F.greatest(F.lit(1), F.least(F.col("n") - 1, F.bround(F.col("n") * F.lit(fraction)).cast("long"))).alias("wanted"))
    placed = hash_ranks(ranked, [], "source_id", digits).crossJoin(F.broadcast(wanted))
    return placed.select("source_id", F.when(F.col("rank") <= F.col("wanted"), "validation").otherwise("train").alias("part"))


def policy_difference(decisions: DataFrame, contaminated: DataFrame) -> DataFrame:
    """(source_id, baseline_policy, candidate_policy, reasons): the baseline takes all records, the candidate the accepted ones that aren't contaminated."""
    c = contaminated.select("source_id").distinct().withColumn("leaks", F.lit(True))
    j = decisions.join(c, "source_id", "left")
    take = (F.col("decision") == "accept") & F.col("leaks").isNull()
    why = F.when(F.size("reasons") == 0, F.array(F.lit("quality_policy_accept"))).otherwise(F.col("reasons"))
    return j.select("source_id", F.lit("include").alias("baseline_policy"), F.when(take, "include").otherwise("exclude").alias("candidate_policy"), why.alias("reasons"))
