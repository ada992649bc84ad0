"""Exact duplicates, similarity joins over word shingles, and clusters.

Every operator takes a null text as no text, ties on the smaller id, and ignores columns it doesn't name; empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.session import Stages

#: Postings of a small side that are sent to every executor; above it both sides are shuffled.
BROADCAST_POSTINGS = 2_000_000


def identified(docs: DataFrame) -> DataFrame:
    """docs with the content hash and the id that follows from it."""
    return docs.withColumn("content_sha256", X.digest("text")).withColumn("doc_id", X.doc_id("content_sha256"))


def first_occurrences(docs: DataFrame) -> DataFrame:
    """Of documents with the same text the first one by pos, source_id: aggregated before the shuffle, so that a text that a
    third of all rows share costs one row for each task."""
    d = identified(docs)
    keep = F.min(F.struct("pos", "source_id"))
    return d.groupBy("content_sha256").agg(keep.alias("k"), F.count("*").alias("copies")).select(X.doc_id("content_sha256").alias("doc_id"), F.col("k.source_id").alias("source_id"), F.col("k.pos").alias("pos"), "content_sha256", "copies")


def first_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns of first_occurrences' rows. Each is taken by its own minimum over pos, source_id, so that columns that nobody
    reads are pruned, texts above all, and rows are reduced before the shuffle."""
    order = F.struct("pos", "source_id")
    kept = identified(docs).groupBy("content_sha256").agg(*(F.min_by(c, order).alias(c) for c in columns))
    return kept.drop("content_sha256")


def shingle_classes(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(classes, members): documents with one set of shingles are one class, named by its smallest source_id. Sets are staged once."""
    stages = Stages(docs.sparkSession)
    own = docs.select("source_id", X.shingle_hashes("text", size).alias("s"))
    sets = stages.write(own.withColumn("set_id", F.md5(F.array_join(F.col("s").cast("array<string>"), ","))))
    names = stages.write(sets.groupBy("set_id").agg(F.min("source_id").alias("class_id"), F.count("*").alias("n_members")))
    classes = sets.join(names, "set_id").where("source_id = class_id").select("class_id", "s", "n_members")
    return stages.write(classes), sets.select("source_id", "set_id").join(names, "set_id").select("source_id", "class_id")


def _prefixes(sets: DataFrame, rarity: DataFrame, threshold: float) -> DataFrame:
    """The rarest shingles of each set: two sets as similar as the threshold share one of them."""
    pairs = sets.select("class_id", F.size("s").alias("n"), F.explode("s").alias("w")).join(rarity, "w")
    order = F.array_sort(F.collect_list(F.struct("df", "w")))
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    return pairs.groupBy("class_id", "n").agg(order.alias("o")).select("class_id", "n", F.explode(F.slice("o", F.lit(1), keep)).alias("o")).select("class_id", "n", F.col("o.w").alias("w"))


def similar_pairs(left: DataFrame, right: DataFrame | None = None, threshold: float = 0.8, broadcast_postings: int = BROADCAST_POSTINGS) -> DataFrame:
    """(left_source_id, right_source_id, similarity) of classes whose shingle sets have that Jaccard similarity at least.

    Exact. A small right side is sent to every executor and its shingles are counted where they are met, so that no shingle of the left
    one is shuffled but those in common. Else only the rarest shingles of each set are joined, so that phrases of every document make
    no candidates; prefix and length filters lose no pair, and each candidate is verified on whole sets. Without ``right`` the pairs
    are of one collection, the smaller id first. Sets without a word are all alike; classes have at most one such set.
    """
    if right is None:
        return _by_prefixes(left, None, threshold)
    postings = right.agg(F.coalesce(F.sum(F.size("s")), F.lit(0)).alias("n")).first()[0]
    found = _counted(left, right, threshold) if postings <= broadcast_postings else _by_prefixes(left, right, threshold)
    empty = left.where(F.size("s") == 0).select(F.col("class_id").alias("left_source_id")).crossJoin(right.where(F.size("s") == 0).select(F.col("class_id").alias("right_source_id")))
    return found.union(empty.withColumn("similarity", F.lit(1.0)))  # one class at most on either side


def _counted(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    long = lambda df, name, size: df.select(F.col("class_id").alias(name), F.size("s").alias(size), F.explode("s").alias("w"))
    near = F.least("n", "m") >= F.greatest("n", "m") * threshold - 1e-9
    met = long(left, "left_source_id", "n").join(F.broadcast(long(right, "right_source_id", "m")), "w").where(near)
    counts = met.groupBy("left_source_id", "right_source_id", "n", "m").agg(F.count("*").alias("k"))
    j = counts.withColumn("j", F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).where(F.col("j") >= threshold)
    return j.select("left_source_id", "right_source_id", F.bround("j", 6).alias("similarity"))


def _by_prefixes(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    both = left if right is None else left.unionByName(right, allowMissingColumns=True)
    rarity = both.select(F.explode("s").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    stages = Stages(left.sparkSession)
    a = stages.write(_prefixes(left, rarity, threshold))
    b = a if right is None else stages.write(_prefixes(right, rarity, threshold))
    l, r = a.alias("l"), b.alias("r")
    near = (F.col("l.w") == F.col("r.w")) & (F.least("l.n", "r.n") >= F.greatest("l.n", "r.n") * threshold - 1e-9)
    if right is None:
        near &= F.col("l.class_id") < F.col("r.class_id")
    candidates = l.join(r, near).select(F.col("l.class_id").alias("left_source_id"), F.col("r.class_id").alias("right_source_id")).distinct()
    ls = left.select(F.col("class_id").alias("left_source_id"), F.col("s").alias("ls"))
    rs = (left if right is None else right).select(F.col("class_id").alias("right_source_id"), F.col("s").alias("rs"))
    checked = candidates.join(ls, "left_source_id").join(rs, "right_source_id").withColumn("j", X.jaccard("ls", "rs")).where(F.col("j") >= threshold)
    return checked.select("left_source_id", "right_source_id", F.bround("j", 6).alias("similarity"))


def connected(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source_id, cluster_id): the smallest id that each is linked with. Minimum labels with pointer jumps, each round written
    to the shared folder, until none changes."""
    stages = Stages(vertices.sparkSession)
    edges = stages.write(pairs.select(F.col("left_source_id").alias("a"), F.col("right_source_id").alias("b")).where("a <> b").distinct())
    both = stages.write(edges.union(edges.select("b", "a")))
    label = stages.write(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c"), F.lit(True).alias("moved")))
    while not label.where("moved").isEmpty():
        own = label.select("v", "c")
        around = both.join(own.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("c").alias("near"))
        low = own.join(around, F.col("v") == F.col("a")).select("v", "c", F.least("c", "near").alias("low"))
        hop = own.select(F.col("v").alias("low"), F.col("c").alias("jump"))
        nexts = stages.write(low.join(hop, "low", "left").select("v", "c", F.least("low", F.coalesce("jump", "low")).alias("new")).select("v", F.col("new").alias("c"), (F.col("new") != F.col("c")).alias("moved")))
        stages.drop(label)
        label = nexts
    stages.drop(both)
    stages.drop(edges)
    return vertices.select("source_id").join(label, F.col("source_id") == F.col("v"), "left").select("source_id", F.coalesce("c", "source_id").alias("cluster_id"))


def confusion(outcomes: DataFrame) -> DataFrame:
    """Counts and rates of predicted against labelled pairs; a rate without cases is 0."""
    p, a = F.col("predicted_duplicate"), F.col("is_duplicate")
    c = outcomes.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    rate = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    c = c.withColumn("p", rate(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r", rate(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.select("tp", "fp", "fn", "tn", F.bround("p", 6).alias("precision"), F.bround("r", 6).alias("recall"), F.bround(rate(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 6).alias("f1"))


def latest(df: DataFrame, *order: str) -> DataFrame:
    """One row for each source_id: the first by the given columns."""
    w = Window.partitionBy("source_id").orderBy(*(F.col(c).asc_nulls_last() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
