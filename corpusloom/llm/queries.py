"""The queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import containers, encoding, formatting, groups, leaks, lookalike, mixing, personal, spans
from corpusloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(table(spark, d, "raw_documents"), table(spark, d, "lab04"))


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    """The classes behind p1_found: one row a record, with its canonical member, instead of all pairs."""
    return lookalike.look_alike_members(table(spark, d, "raw_documents"), table(spark, d, "lab04")).select("canonical_source_id", "source_id").distinct()


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_texts(table(spark, d, "raw_documents"), table(spark, d, "lab04"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.group_identifiers(table(spark, d, "duplicate_labels"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting.copies(table(spark, d, "raw_documents"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return formatting.copy_counts(table(spark, d, "raw_documents"))


def p4_sequences(spark: SparkSession, d: str) -> DataFrame:
    return containers.pack(table(spark, d, "raw_documents"))


#: Edits that a run of 40 letters may have in p5_edits, and in the search behind p5_found.
P5_EDITS = 2


def p5_edits(spark: SparkSession, d: str) -> DataFrame:
    """Leaks with the fewest edits of each: up to two in a run of 40 letters, one from 20 letters on, none in shorter items."""
    return leaks.leaks(table(spark, d, "lab04"), table(spark, d, "evaluation"), max_edits=P5_EDITS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The leaks of p5_edits that have no edit: windows that are equal agree in every repetition, so that none is missed."""
    return p5_edits(spark, d).where("edits = 0").select("eval_source_id", "source_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.found_types(table(spark, d, "lab04"))


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(table(spark, d, "lab04"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_spec"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    spec = table(spark, d, "mix_spec")
    return mixing.shares(mixing.mixture(table(spark, d, "documents"), spec), spec).withColumn("share", F.bround("share", 9))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"))


def p9_amounts(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_amounts(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_members, p1_texts, p2_found, p3_found, p3_counts, p4_sequences, p5_found, p5_edits, p6_found, p6_texts, p7_ids, p8_mixture, p8_shares, p9_found, p9_amounts)}


#: The smallest reachable id of every id: DuckDB walks the links from each id.
P2_SQL = """
WITH RECURSIVE links AS (
  SELECT left_source_id AS a, right_source_id AS b FROM duplicate_labels WHERE is_duplicate AND left_source_id IS NOT NULL AND right_source_id IS NOT NULL
  UNION SELECT right_source_id, left_source_id FROM duplicate_labels WHERE is_duplicate AND left_source_id IS NOT NULL AND right_source_id IS NOT NULL),
ids AS (SELECT left_source_id AS id FROM duplicate_labels WHERE left_source_id IS NOT NULL UNION SELECT right_source_id FROM duplicate_labels WHERE right_source_id IS NOT NULL),
reach AS (SELECT id, id AS other FROM ids UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT min(other) AS group_source_id, id AS source_id FROM reach GROUP BY id
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL}
