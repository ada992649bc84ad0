"""The library's own queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import dedup, feed, governance, packing, partitioning, recovery
from corpusloom.operators.ranking import digits_for
from corpusloom.plans.corpus import documents
from corpusloom.session import Stages, table
from corpusloom.settings import REFERENCE, Audit, Comparison, Compute, Feed, Storage, Version
from corpusloom.sources import files
from corpusloom.streaming.feed import windowed_counts

SEED = Version.seed
EPOCHS, WORKERS, BATCH = Feed.epochs, Feed.workers, Feed.batch
SAMPLE = Storage.samples
SCANNED = ("raw_documents", "lab04", "documents")


def raw(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d, "raw_documents")


def lab(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d, "lab04")


def one(s: SparkSession, df: DataFrame) -> DataFrame:
    """df written once, for plans that read it several times."""
    return Stages(s).write(df)


# scans and identity


def doc_scan_validate(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "raw_documents")
    kinds = {"no_source_id": F.col("source_id").isNull(), "no_text": F.col("text").isNull(), "empty_text": X.normalize("text") == "", "no_metadata": F.col("metadata").isNull(), "delivered_again": F.lit(False)}
    counts = t.agg(*(F.count_if(c).alias(k) for k, c in kinds.items() if k != "delivered_again"))
    again = t.where("source_id IS NOT NULL").groupBy("source_id").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("delivered_again"))
    return counts.crossJoin(again).unpivot([], [*kinds], "violation", "n").withColumn("n", F.col("n").cast("long"))


def normalize_text(s, d):
    return raw(s, d).select("source_id", X.digest("text").alias("sha256"), F.length("text").alias("n_chars"))


def content_hash_id(s, d):
    return dedup.identified(raw(s, d)).select("source_id", "content_sha256", "doc_id")


def exact_dedup(s, d):
    return dedup.first_occurrences(raw(s, d)).select("doc_id", "source_id", "pos", "copies")


def exact_dedup_stats(s, d):
    return dedup.first_occurrences(raw(s, d)).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n_documents"), F.count("*").alias("n_unique"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n_duplicates"))


def ctas_json_infer(s, d):
    stages = Stages(s)
    path = f"{stages.root}/json"
    files.write_jsonl(table(s, d, "documents").select("doc_id", "domain", "n_chars"), path)
    s.read.json(path).createOrReplaceTempView("loom_documents")
    return s.sql("SELECT domain, count(*) AS n, sum(n_chars) AS n_chars FROM loom_documents GROUP BY domain")


def seq_scan_bytes(s, d):
    """Every byte of the files of the corpus tables: how many files and bytes, and one digest, of the blocks' digests in order of file and block."""
    blocks = files.sequential_bytes(s, [f"{d}/{n}.parquet" for n in SCANNED])
    ordered = F.array_sort(F.collect_list(F.struct("path", "block", "sha256")))  # one entry for 8 MB
    return blocks.agg(F.count_distinct("path").alias("n_files"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"), F.sha2(F.array_join(ordered["sha256"], ""), 256).alias("sha256"))


# similarity and governance: each with this library's setting, and as NAME_ref with the reference's


class _Audit:
    """What the queries of one call share: normalised texts, shingle classes, pairs, clusters and leaks, each made once."""

    def __init__(self, s: SparkSession, d: str, setting: Audit):
        self.s, self.d, self.setting = s, d, setting

    @cached_property
    def lab(self) -> DataFrame:
        return one(self.s, lab(self.s, self.d))

    @cached_property
    def _lab(self) -> tuple[DataFrame, DataFrame]:
        return dedup.shingle_classes(self.lab, self.setting.words)

    @property
    def classes(self) -> DataFrame:
        return self._lab[0]

    @property
    def members(self) -> DataFrame:
        return self._lab[1]

    @cached_property
    def pairs(self) -> DataFrame:
        return one(self.s, dedup.similar_pairs(self.classes, None, self.setting.similarity))

    @cached_property
    def leaks(self) -> DataFrame:
        held_out = dedup.shingle_classes(documents(self.s, self.d, "evaluation"), self.setting.words)[0]
        return one(self.s, dedup.similar_pairs(self.classes, held_out, self.setting.contamination))

    @cached_property
    def clusters(self) -> DataFrame:
        labels = dedup.connected(self.classes.select(F.col("class_id").alias("source_id")), self.pairs)
        every = self.members.join(labels.withColumnRenamed("source_id", "class_id"), "class_id").select("source_id", "cluster_id")
        sizes = every.groupBy("cluster_id").agg(F.count("*").alias("n_members")).where("n_members > 1")
        return one(self.s, every.join(sizes, "cluster_id").select("source_id", "cluster_id", "n_members"))

    @cached_property
    def decisions(self) -> DataFrame:
        lost = self.clusters.where("source_id <> cluster_id").select("source_id")
        leaked = self.members.join(self.leaks.select(F.col("left_source_id").alias("class_id")).distinct(), "class_id").select("source_id")
        return one(self.s, governance.decided(self.lab, lost, leaked, self.setting))

    @cached_property
    def outcomes(self) -> DataFrame:
        """Labelled pairs of known records; truth_violations counts the others."""
        sets = one(self.s, self.lab.select("source_id", X.shingle_hashes("text", self.setting.words).alias("s")))
        side = lambda name, c: sets.select(F.col("source_id").alias(name), F.col("s").alias(c))
        j = _truth(self.s, self.d).join(side("left_source_id", "a"), "left_source_id").join(side("right_source_id", "b"), "right_source_id")
        similar = j.withColumn("similarity", X.jaccard("a", "b"))
        return similar.select("left_source_id", "right_source_id", "is_duplicate", "similarity", (F.col("similarity") >= self.setting.similarity).alias("predicted_duplicate"))


def shingles(a: _Audit):
    c = a.lab.select("source_id", F.array_sort(X.shingles("text", a.setting.words)).alias("s"))
    return c.select("source_id", F.size("s").alias("n_shingles"), F.sha2(F.array_join("s", "|"), 256).alias("digest"))


def _labels(s, d):
    usable = "left_source_id IS NOT NULL AND right_source_id IS NOT NULL AND is_duplicate IS NOT NULL AND left_source_id <> right_source_id"
    t = table(s, d, "duplicate_labels").where(usable)
    return t.select(F.least("left_source_id", "right_source_id").alias("left_source_id"), F.greatest("left_source_id", "right_source_id").alias("right_source_id"), "is_duplicate")


def _truth(s, d):
    return _labels(s, d).groupBy("left_source_id", "right_source_id").agg(F.bool_or("is_duplicate").alias("is_duplicate"), F.count("*").alias("n_rows"), F.count_if("is_duplicate").alias("n_true"))


def truth_pair_canonical(s, d):
    return _truth(s, d)


def truth_violations(s, d):
    """What the reference refuses in labels: null ids or labels, records paired with themselves, ids that lab04 doesn't have, pairs that are
    repeated and pairs that are labelled both ways."""
    t = table(s, d, "duplicate_labels")
    plain = t.agg(F.count_if(F.expr("left_source_id IS NULL OR right_source_id IS NULL")).alias("null_id"), F.count_if(F.expr("is_duplicate IS NULL")).alias("null_label"), F.count_if(F.expr("left_source_id = right_source_id")).alias("self_pair"))
    named = t.select(F.explode(F.array("left_source_id", "right_source_id")).alias("source_id")).where("source_id IS NOT NULL").distinct()
    known = table(s, d, "lab04").where("text IS NOT NULL").select("source_id")
    unknown = named.join(known, "source_id", "left_anti").agg(F.count("*").alias("unknown_id"))
    pairs = _truth(s, d).agg(F.count_if(F.expr("n_rows > 1")).alias("repeated_pair"), F.count_if(F.expr("n_true > 0 AND n_true < n_rows")).alias("contradicted_pair"))
    kinds = ["null_id", "null_label", "self_pair", "unknown_id", "repeated_pair", "contradicted_pair"]
    return plain.crossJoin(unknown).crossJoin(pairs).unpivot([], kinds, "violation", "n")


def jaccard_scalar(a: _Audit):
    return a.outcomes.select("left_source_id", "right_source_id", F.bround("similarity", 6).alias("similarity"))


def truth_outcomes(a: _Audit):
    return a.outcomes.withColumn("similarity", F.bround("similarity", 6))


def dedup_confusion(a: _Audit):
    return dedup.confusion(a.outcomes)


def near_dup_pairs(a: _Audit):
    return a.pairs.orderBy("left_source_id", "right_source_id")


def near_dup_members(a: _Audit):
    return a.members


def near_dup_links(a: _Audit):
    """(source_id, class_id, n_links): one row a document, with the number of other classes that its class is similar to."""
    ends = a.pairs.select(F.explode(F.array("left_source_id", "right_source_id")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return a.members.join(ends, "class_id", "left").select("source_id", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def contamination_pairs(a: _Audit):
    return a.leaks.orderBy("left_source_id", "right_source_id")


def dup_clusters(a: _Audit):
    return a.clusters


def pii_email(s, d):
    return lab(s, d).where(X.has_email("text")).select("source_id")


def pii_phone(s, d):
    return lab(s, d).where(X.has_phone("text")).select("source_id")


def quality_reasons(s, d):
    return lab(s, d).select("source_id", F.array_join(governance.reasons(Audit()), ",").alias("reasons"))


def quality_decision(a: _Audit):
    return a.decisions.select("source_id", "decision", F.array_join("reasons", ",").alias("reasons"))


def reason_counts(a: _Audit):
    return a.decisions.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason")


def quality_metrics(a: _Audit):
    has = lambda reason: F.count_if(F.array_contains("reasons", reason))
    own = a.decisions.agg(F.count("*").alias("n_documents"), F.count_if(F.col("decision") == "accept").alias("n_accepted"), F.count_if(F.col("decision") == "reject").alias("n_rejected"), has("near_duplicate").alias("n_near_duplicates"), has("evaluation_contamination").alias("n_contaminated"))
    counts = (a.pairs.agg(F.count("*").alias("n_pairs")), a.leaks.agg(F.count("*").alias("n_contamination_pairs")), a.clusters.agg(F.count_distinct("cluster_id").alias("n_clusters")))
    for x in counts:  # a row each
        own = own.crossJoin(x)
    return own


def policy_candidate(a: _Audit):
    x = a.decisions
    return x.where("decision = 'accept'").join(x.where(F.array_contains("reasons", "evaluation_contamination")).select("source_id"), "source_id", "left_anti").select("source_id")


def policy_diff(a: _Audit):
    x = a.decisions
    return governance.policy_difference(x, x.where(F.array_contains("reasons", "evaluation_contamination"))).withColumn("reasons", F.array_join("reasons", ","))


AUDITED = (shingles, jaccard_scalar, truth_outcomes, dedup_confusion, near_dup_pairs, near_dup_members, near_dup_links, contamination_pairs, dup_clusters, quality_decision, reason_counts, quality_metrics, policy_candidate, policy_diff)


# mixing


def _spec(s, d):
    return governance.weights_checked(table(s, d, "mix_spec").where("source IS NOT NULL").select("source", "weight"))


def _listed(s, d):
    return table(s, d, "documents").join(F.broadcast(_spec(s, d)), "source", "left_semi").select("doc_id", "source")


def _quota(s, d):
    return governance.quotas(_spec(s, d), _listed(s, d).agg(F.count("*").alias("total")))


def mix_quota(s, d):
    return _quota(s, d).select("source", F.bround("weight", 6).alias("weight"), "quota")


def mix_shortage(s, d):
    """What mix_select, mix_order and mix_actual_weights lack: of each source its quota, the records it has and those missing."""
    return governance.shortages(_listed(s, d), _quota(s, d))


def _selected(s, d):
    return governance.selected(_listed(s, d), _quota(s, d), SEED, digits_for(table(s, d, "documents").count()))


def mix_select(s, d):
    """Of each source its quota of records, or all it has: see mix_shortage."""
    return _selected(s, d).select("source", "doc_id", "rank")


def mix_order(s, d):
    """The records of mix_select in mixed order."""
    chosen = _selected(s, d).withColumn("order_key", F.sha2(F.concat(F.lit(f"mix:{SEED}:"), F.col("doc_id").cast("string")), 256))
    return chosen.select("doc_id", "source", "order_key").orderBy("order_key", "doc_id")


def mix_actual_weights(s, d):
    """Shares of what was selected; they aren't the weights where mix_shortage has missing records."""
    n = _selected(s, d).groupBy("source").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("source", "n", F.bround(F.col("n") / F.col("total"), 6).alias("actual_weight"))


def hash_split(s, d):
    """A tenth for validation by hash rank, one record at least on either side where there are two."""
    ranked = one(s, raw(s, d).select("source_id", X.seeded_rank(SEED, "source_id").alias("h")))
    return governance.split(ranked, Comparison.validation, digits_for(ranked.count()))


def split_check(s, d):
    """Records on both sides of the split, on none, and on each: the sides must be disjoint and cover all."""
    parts, ids = one(s, hash_split(s, d)), raw(s, d).select("source_id")
    side = lambda p: parts.where(F.col("part") == p).select("source_id")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    both = n(side("train").intersect(side("validation")), "in_both")
    neither = n(ids.exceptAll(parts.select("source_id")), "in_neither")
    return both.crossJoin(neither).crossJoin(n(side("train"), "n_train")).crossJoin(n(side("validation"), "n_validation"))


# packing


def _stream(s, d, *more):
    """The token stream: first occurrences of each text only, like the reference's build-dataset. They are written once, as offsets
    read them several times; the text is among the columns only if it is named."""
    sized = raw(s, d).withColumn("n_tokens", (F.octet_length("text") + 2).cast("long"))
    docs = one(s, dedup.first_rows(sized, "source_id", "domain", "pos", "n_tokens", *more))
    return packing.offsets(docs.withColumn("doc", F.col("source_id")))


def _lean(s, d):
    return one(s, _stream(s, d).select("doc", "source_id", "domain", "pos", "n_tokens", "global_start", "global_end"))


def _total(placed):
    return placed.agg(F.coalesce(F.max("global_end"), F.lit(0)).alias("total"))


def token_offsets(s, d):
    return _stream(s, d).select("source_id", "n_tokens", "global_start", "global_end")


def _sequences(s, d):
    """Windows follow from the number of tokens alone, which takes no offsets."""
    sized = raw(s, d).withColumn("n_tokens", (F.octet_length("text") + 2).cast("long"))
    return packing.sequences(dedup.first_rows(sized, "n_tokens").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total")))


def packing_metrics(s, d):
    q = _sequences(s, d)
    return q.agg((F.sum("trainable") + 1).alias("total_tokens"), F.sum("trainable").alias("trainable_tokens"), F.count("*").alias("n_sequences"), F.bround(F.sum("trainable") / (F.count("*") * packing.LENGTH), 6).alias("efficiency"))


def pack_provenance(s, d):
    return packing.provenance(_lean(s, d)).drop("doc", "domain")


def pack_sequences(s, d):
    w = packing.token_windows(_stream(s, d, "text"))
    text = lambda c: F.sha2(F.array_join(c, ","), 256)
    return w.select(F.format_string("seq_%08d", "seq").alias("sequence_id"), text("input_ids").alias("input_sha"), text("labels").alias("label_sha"), F.aggregate("loss_mask", F.lit(0), lambda a, x: a + x).alias("trainable"))


def sequence_contract_check(s, d):
    """Windows that break the contract (lengths, mask, shift): none are expected, one row a kind says how many."""
    w = packing.token_windows(_stream(s, d, "text"))
    n = packing.LENGTH
    kinds = {"length": (F.size("input_ids") != n) | (F.size("labels") != n) | (F.size("loss_mask") != n), "mask": F.exists(F.zip_with("labels", "loss_mask", lambda x, m: (x != 0).cast("int") != m), lambda x: x), "shift": F.exists(F.zip_with(F.slice("input_ids", 2, n - 1), F.slice("labels", 1, n - 1), lambda a, b: a != b), lambda x: x)}
    return w.agg(*(F.count_if(c).alias(k) for k, c in kinds.items())).unpivot([], [*kinds], "violation", "n")


def shard_assign(s, d):
    return _sequences(s, d).select("sequence_id", F.format_string("shard-%05d", "shard").alias("shard"))


def shard_stats(s, d):
    placed = _lean(s, d)
    q = packing.sequences(_total(placed))
    prov = packing.provenance(placed).withColumn("shard", F.floor(F.col("seq") / packing.SHARD_SEQUENCES))
    n_docs = prov.groupBy("shard").agg(F.countDistinct("doc").alias("n_documents"), F.countDistinct("domain").alias("n_domains"), F.sha2(F.array_join(F.array_sort(F.collect_set("source_id")), ","), 256).alias("source_ids_sha"))
    return q.groupBy("shard").agg(F.count("*").alias("n_sequences"), F.sum("trainable").alias("trainable_tokens")).join(n_docs, "shard").select(F.format_string("shard-%05d", "shard").alias("shard"), "n_sequences", "trainable_tokens", "n_documents", "n_domains", "source_ids_sha")


def shard_domains(s, d):
    """How many spans of each domain a shard has."""
    prov = packing.provenance(_lean(s, d))
    return prov.groupBy(F.format_string("shard-%05d", F.floor(F.col("seq") / packing.SHARD_SEQUENCES)).alias("shard"), "domain").agg(F.count("*").alias("n_spans"))


def sequence_lineage(s, d):
    prov = packing.provenance(_lean(s, d))
    return prov.select(F.format_string("seq_%08d", "seq").alias("sequence_id"), F.format_string("shard-%05d", F.floor(F.col("seq") / packing.SHARD_SEQUENCES)).alias("shard"), "source_id", "domain", "sequence_token_start", "sequence_token_end")


def dataset_version_metrics(s, d):
    placed = _lean(s, d)
    q = packing.sequences(_total(placed))
    sizes = q.groupBy("shard").agg(F.count("*").alias("n"))
    covered = packing.provenance(placed).select("seq").distinct().agg(F.count("*").alias("covered"))
    return sizes.agg(F.count("*").alias("n_shards"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("n_sequences")).crossJoin(covered).select("n_shards", "least", "most", "n_sequences", F.bround(F.col("covered") / F.col("n_sequences"), 6).alias("lineage_coverage"))


def shard_roundtrip(s, d):
    """Sequences written by shard and read again: how many are missing, how many are new."""
    stages = Stages(s)
    q = _sequences(s, d).select("seq", "sequence_id", F.col("shard").cast("long").alias("shard"), "trainable")
    files.write_shards(q, f"{stages.root}/shards")
    back = s.read.schema(q.schema).parquet(f"{stages.root}/shards").select(q.columns)
    return q.exceptAll(back).agg(F.count("*").alias("missing")).crossJoin(back.exceptAll(q).agg(F.count("*").alias("added")))


def strict_budget_filter(s, d):
    return _sequences(s, d).where(F.col("trainable") == packing.LENGTH).select("sequence_id")


def token_budget(s, d):
    n = _sequences(s, d).where(F.col("trainable") == packing.LENGTH).agg(F.count("*").alias("n"))
    return n.select(F.floor(F.col("n") / BATCH).alias("steps"), (F.floor(F.col("n") / BATCH) * BATCH * packing.LENGTH).alias("tokens"))


# partitions


def domain_agg(s, d):
    return table(s, d, "documents").groupBy("domain").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars")).orderBy("domain")


def domain_agg_equiv(s, d):
    """The aggregate in one pass against the aggregate by partial groups: rows that differ."""
    t = table(s, d, "documents").select("domain", F.length("text").alias("c"))
    direct = t.groupBy("domain").agg(F.count("*").alias("n"), F.sum("c").alias("n_chars"))
    parts = t.groupBy("domain", F.pmod(F.xxhash64("c"), F.lit(16)).alias("salt")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).groupBy("domain").agg(F.sum("n").alias("n"), F.sum("c").alias("n_chars"))
    return direct.exceptAll(parts).unionAll(parts.exceptAll(direct)).agg(F.count("*").alias("n_different"))


def _expanded(s, d):
    """Ordinals are ranks by doc_id, whatever gaps the ids have."""
    t = table(s, d, "documents")
    sized = one(s, t.select("doc_id", "domain", F.length("text").alias("n_chars")))
    placed = packing.offsets(sized.select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("pos"), "domain", "n_chars", F.lit(1).cast("long").alias("n_tokens")))
    docs = placed.select(F.col("global_start").alias("ordinal"), F.col("doc").cast("string").alias("source_id"), "domain", "n_chars")
    return partitioning.expanded(docs, sized.agg(F.count("*").alias("n")))


def skew_expand(s, d):
    return _expanded(s, d)


def hash_partition_id(s, d):
    return raw(s, d).select("source_id", X.hash_partition("source_id", partitioning.PARTITIONS).alias("part"))


def skew_salted_partition(s, d):
    return partitioning.salted(_expanded(s, d)).select("row_id", "salted_key", "part", "salted_part")


def partition_distribution(s, d):
    rows = partitioning.salted(_expanded(s, d))
    each = [partitioning.distribution(rows, c).withColumn("strategy", F.lit(n)) for c, n in (("part", "hash"), ("salted_part", "salted"))]
    return each[0].unionByName(each[1])


def skew_improvement(s, d):
    rows = partitioning.salted(_expanded(s, d))
    a, b = (partitioning.distribution(rows, c).select(F.col("max_mean_ratio").alias(c)) for c in ("part", "salted_part"))
    return a.crossJoin(b).select(F.col("part").alias("hash_ratio"), F.col("salted_part").alias("salted_ratio"), F.bround(F.col("part") - F.col("salted_part"), 6).alias("improvement"))


def _partition_files(s, d):
    """The folder with the files of both strategies."""
    root = f"{Stages(s).root}/partitions"
    rows = partitioning.salted(_expanded(s, d))
    for strategy, column in (("hash", "part"), ("salted", "salted_part")):
        files.write_partitions(rows.select("row_id", F.col(column).alias("part")), f"{root}/{strategy}", "part")
    return root


def partition_files(s, d):
    """(strategy, part, n_rows) as read from the partition files of both strategies."""
    root = _partition_files(s, d)
    each = [s.read.parquet(f"{root}/{x}").groupBy("part").agg(F.count("*").alias("n_rows")).select(F.lit(x).alias("strategy"), "part", "n_rows") for x in ("hash", "salted")]
    return each[0].union(each[1])


def task_recovery_summary(s, d):
    """Partitions counted from their files, where the first attempt at one fails, is made again, and a further pass finds the markers of all."""
    root = _partition_files(s, d)
    found = files.listed(s, f"{root}/salted", "/part=([0-9]+)/", "p").select(F.col("p").cast("int").alias("part"), "paths")
    parts = one(s, s.range(Compute.partitions).select(F.col("id").cast("int").alias("part")).join(found, "part", "left"))
    runs = recovery.run_with_retry(s, parts, f"{root}/markers", Compute.failing)
    done = F.count_if(F.col("done") & (F.col("round") < 3))
    return runs.agg(done.alias("completed"), F.count_if(F.col("round") < 3).alias("attempts"), F.count_if(F.col("round") == 2).alias("retries"), F.count_if((F.col("round") == 3) & F.col("reused")).alias("reused"), F.sum(F.when(F.col("round") == 3, F.col("n_rows"))).alias("n_rows"))


def parallelism_contract(s, d):
    return recovery.parallelism_contract(s)


# feed


def epoch_repeat(s, d):
    return feed.epochs(_sequences(s, d).select("sequence_id"), EPOCHS)


def worker_shard_assign(s, d):
    return feed.workers(_sequences(s, d).groupBy("shard").agg(F.count("*").alias("n_sequences")), WORKERS)


def feed_integrity(s, d):
    """Delivered samples and batches, counted over the delivered rows: every worker forms batches of its own, the last one may be short."""
    delivered = feed.epochs(feed.workers(_sequences(s, d), WORKERS), EPOCHS)
    each = delivered.groupBy("worker", "sequence_id").agg(F.count("*").alias("n"), F.sum("trainable").alias("t")).groupBy("worker").agg(F.sum("n").alias("n"), F.count("*").alias("q"), F.sum("t").alias("t"))
    return each.agg(F.sum("n").alias("samples"), F.sum("q").alias("distinct_sequences"), F.sum("t").alias("trainable_tokens"), F.sum(F.ceil(F.col("n") / BATCH)).alias("batches"))


def batch_schedule(s, d):
    ids = one(s, _sequences(s, d).select(F.col("sequence_id").alias("id")))
    return feed.schedule(ids, EPOCHS, BATCH, SEED, digits_for(ids.count())).withColumnRenamed("id", "sequence_id")


def resume_equivalence(s, d):
    """A run that stops at a cursor and one that is made anew from the source and goes on at the stored cursor, against one that doesn't
    stop: rows that differ."""
    root = f"{Stages(s).root}/cursor.json"
    done = one(s, batch_schedule(s, d).where(recovery.before(1, 2)))
    recovery.store_cursor(root, 1, 2)
    went_on = batch_schedule(s, d).where(~recovery.before(*recovery.load_cursor(root)))
    parts, whole = one(s, done.unionAll(went_on)), one(s, batch_schedule(s, d))
    return whole.exceptAll(parts).unionAll(parts.exceptAll(whole)).agg(F.count("*").alias("n_different"))


def latency_percentiles(s, d):
    return feed.percentiles(table(s, d, "events"), "event_type", "value").select("event_type", "n", F.bround("p50", 6).alias("p50"), F.bround("p99", 6).alias("p99"), F.bround("median", 6).alias("median"))


def _lines(s, d):
    return raw(s, d).select(F.format_string("part-%05d", F.floor(F.col("pos") / 500).cast("long")).alias("path"), "pos", "source_id", "text")


def line_offset_index(s, d):
    return feed.line_index(_lines(s, d), "path", "pos", "text")


def random_sample_read(s, d):
    """256 lines by hash rank, read from their files through the line index. The index is over all files; only files that hold one of the 256 are written."""
    stages = Stages(s)
    lines = stages.write(_lines(s, d).withColumn("order", F.struct("pos", "source_id")))
    picks = lines.select("source_id", F.sha2(F.concat(F.lit(f"{SEED}:"), "source_id"), 256).alias("h")).orderBy("h", "source_id").limit(SAMPLE)
    entries = stages.write(feed.line_index(lines, "path", "order", "text", "source_id").join(F.broadcast(picks), "source_id").select("source_id", "path", "offset", "length"))
    root = f"{stages.root}/lines"
    files.write_lines(lines.join(F.broadcast(entries.select("path").distinct()), "path", "left_semi"), root)
    return files.read_lines(s, entries, root).select("source_id", (F.octet_length("line") - 1).alias("n_bytes"))


def storage_workloads(s, d):
    """(workload, operations, n_bytes): whole scans again and again, reads by the index, and lines written by several writers at once and read again."""
    setting, stages = Storage(), Stages(s)
    scans = [files.sequential_bytes(s, [f"{d}/{n}.parquet" for n in SCANNED]) for _ in range(setting.scans)]
    read = reduce(DataFrame.unionAll, scans).agg(F.count("*").alias("operations"), F.sum("n_bytes").alias("n_bytes"))
    picked = random_sample_read(s, d).agg(F.count("*").alias("operations"), F.sum("n_bytes").cast("long").alias("n_bytes"))
    raw(s, d).select("text").repartition(setting.writers).write.text(f"{stages.root}/written")
    back = s.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{stages.root}/written").select("length")
    wrote = back.agg(F.count("*").alias("operations"), F.sum("length").alias("n_bytes"))
    named = [x.select(F.lit(n).alias("workload"), "operations", "n_bytes") for n, x in (("sequential_read", read), ("indexed_read", picked), ("parallel_write", wrote))]
    return reduce(DataFrame.unionAll, named)


# comparisons of runs; the loss facts stand in lineitem


def _losses(s, d):
    run = F.when(F.col("l_returnflag") == "A", "baseline").when(F.col("l_returnflag") == "R", "candidate")
    return table(s, d, "lineitem").select(F.col("l_linenumber").alias("seed"), run.alias("run"), F.col("l_suppkey").alias("sequence_id"), (F.col("l_extendedprice") / 10000).alias("loss"), F.col("l_quantity").cast("long").alias("n_tokens"))


def ab_sequence_delta(s, d):
    return feed.run_means(_losses(s, d))


def ab_one_sided(s, d):
    """Sequences that one run lacks, for which the reference refuses the comparison; ab_sequence_delta is over the others."""
    return feed.one_sided(_losses(s, d))


def failure_topk(s, d):
    return ab_sequence_delta(s, d).orderBy(F.desc("delta"), "sequence_id").limit(3)


def ab_compare(s, d):
    mean = lambda r: F.avg(F.when(F.col("run") == r, F.col("loss")))
    return _losses(s, d).agg(mean("baseline").alias("b"), mean("candidate").alias("c")).select(F.bround("b", 6).alias("baseline"), F.bround("c", 6).alias("candidate"), F.bround(F.col("c") - F.col("b"), 6).alias("delta"), F.bround(F.try_divide("c", "b"), 6).alias("ratio"))


def ab_seed_aggregate(s, d):
    mean = lambda r: F.avg(F.when(F.col("run") == r, F.col("loss")))
    by = _losses(s, d).groupBy("seed").agg((mean("candidate") - mean("baseline")).alias("delta"))
    return by.agg(F.bround(F.avg("delta"), 6).alias("mean_delta"), F.bround(F.stddev_pop("delta"), 6).alias("std_delta"), F.count_if(F.col("delta") < 0).alias("better"), F.count_if(F.col("delta") > 0).alias("worse"), F.count_if(F.col("delta") == 0).alias("equal"))


def ab_controls(s, d):
    """Whether both runs saw the same sequences and seeds."""
    x = _losses(s, d).where("run IS NOT NULL")
    return x.groupBy("sequence_id").agg(F.countDistinct("run").alias("n")).agg(F.count("*").alias("n_sequences"), F.count_if(F.col("n") == 2).alias("in_both")).crossJoin(x.agg(F.countDistinct("seed").alias("n_seeds")))


def masked_mean(s, d):
    """Of each order the mean price of its lines that were not returned."""
    t = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", F.round(F.col("l_extendedprice") * 100).alias("cents"), (F.col("l_returnflag") != "R").cast("int").alias("m"))).alias("x"))  # seven lines an order at most
    return t.select("l_orderkey", F.bround(feed.masked_mean(F.col("x.cents"), F.col("x.m")), 6).alias("mean_cents"))


def token_weighted_loss(s, d):
    return _losses(s, d).where("run IS NOT NULL").groupBy("run").agg(F.bround(F.sum(F.col("loss") * F.col("n_tokens")) / F.sum("n_tokens"), 6).alias("loss"), F.sum("n_tokens").alias("n_tokens"))


# fingerprints and counts


def content_fingerprint(s, d):
    """A fingerprint of a table's content whatever its order: counts and sums of row hashes, which are added up in parallel."""
    part = lambda a: F.conv(F.substring("h", a, 8), 16, 10).cast("long")
    return raw(s, d).select(F.sha2(F.concat_ws("|", "source_id", "text"), 256).alias("h")).agg(F.count("*").alias("n"), *(F.sum(part(1 + 8 * i)).alias(f"sum_{i}") for i in range(4)))


def pretoken_counts(s, d):
    """Words in lower case: counts for vocabulary statistics. No tokenizer is trained here; public ones are used as they are."""
    return raw(s, d).select(F.explode(X.words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def event_windows(s, d):
    """The streaming aggregate run as a batch."""
    return windowed_counts(table(s, d, "events"))


PLAIN = """doc_scan_validate normalize_text content_hash_id exact_dedup exact_dedup_stats ctas_json_infer seq_scan_bytes truth_pair_canonical truth_violations
pii_email pii_phone quality_reasons mix_quota mix_shortage mix_select mix_order mix_actual_weights hash_split split_check token_offsets
packing_metrics pack_provenance pack_sequences sequence_contract_check shard_assign shard_stats shard_domains sequence_lineage dataset_version_metrics shard_roundtrip
strict_budget_filter token_budget domain_agg domain_agg_equiv skew_expand hash_partition_id skew_salted_partition partition_distribution skew_improvement
partition_files task_recovery_summary parallelism_contract epoch_repeat worker_shard_assign feed_integrity batch_schedule resume_equivalence latency_percentiles line_offset_index
random_sample_read storage_workloads ab_sequence_delta ab_one_sided failure_topk ab_compare ab_seed_aggregate ab_controls masked_mean token_weighted_loss content_fingerprint
pretoken_counts event_windows""".split()


def _audited(query: Callable[[_Audit], DataFrame], setting: Audit) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: query(_Audit(s, d, setting))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {n: globals()[n] for n in PLAIN}
    for q in AUDITED:
        found |= {q.__name__: _audited(q, Audit()), f"{q.__name__}_ref": _audited(q, REFERENCE)}
    return found
