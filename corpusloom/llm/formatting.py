"""Duplicates hidden by formatting differences (problem 3).

Every record becomes a multiset of fields: a list of named fields one element per name and value, any other text a single
element. Elements are hashed with their letters and digits only, hashes are added up, which no order changes, records are
grouped by the sums, and the fields themselves of each record are then held against those of the kept one by counting, not by sorting.

Defined results: a null or empty text, or one without a letter or digit, is no copy of anything; rows of one source_id
are one record; equal fields of one record count as often as they stand; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.lookalike import fold, letters, records
from corpusloom.session import Stages

_NAME = r"""(?P<quote>["'“]?)(?P<name>[^\W_][\w.\-/]*)["'”]?"""
_ENTRY = re.compile(rf"""\s*(?:[-*•]\s+)?{_NAME}\s*[:=：＝]\s*(?P<value>\S.*?|)\s*,?\s*""", re.S)
_PARTED = re.compile(r"[\n\r;|；｜  ]+")
_OPEN, _CLOSE, _QUOTES = "[{(", "]})", "\"'"


def _entries(body: str) -> list[str]:
    """The members of an object's inside: cut at commas, semicolons and line breaks outside quotes and brackets."""
    out, depth, quote, start, skip = [], 0, "", 0, False
    for i, c in enumerate(body):
        if skip:
            skip = False
        elif quote:
            if c == "\\":
                skip = True
            elif c == quote:
                quote = ""
        elif c in _QUOTES and (i == 0 or not body[i - 1].isalnum()):
            quote = c
        elif c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth -= 1
        elif c in ",;\n，；" and depth == 0:
            out.append(body[start:i])
            start = i + 1
    return [x for x in (*out, body[start:]) if x.strip()]


def fields(text: str, within: str = "") -> list[tuple[str, str]] | None:
    """The (name, value) pairs, letters and digits only, of a folded text that is wholly a list of named fields; else None."""
    body = text.strip()
    if body[:1] == "{" and body[-1:] == "}":
        parts = _entries(body[1:-1])
    else:
        parts = [x for x in _PARTED.split(body) if x.strip()]
        if len(parts) < 2:
            return None
    out = []
    for part in parts:
        if not (m := _ENTRY.fullmatch(part)):
            return None
        name, value = f"{within}{letters(m['name'])}", m["value"].strip()
        inner = fields(value, f"{name}\0") if value[:1] == "{" and value[-1:] == "}" else None
        out += inner if inner is not None else [(name, letters(value))]
    return out or None


def forms(text: str | None) -> list[str]:
    """The normalised form of each field, or of the whole of any other text; none where there is no letter or digit."""
    if not text or not (whole := letters(text)):
        return []
    named = fields(fold(text))
    return [f"f\1{n}\1{v}" for n, v in named] if named else [f"t\1{whole}"]


def digest(form: str) -> bytes:
    """16 bytes for one field."""
    return blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _signed(total: int) -> int:
    return (total + (1 << 63)) % (1 << 64) - (1 << 63)


RECORD = "source_id string, sum_a long, sum_b long, forms array<string>"


def fingerprints(df: DataFrame, hashed: Callable[[str], bytes] = digest) -> DataFrame:
    """(source_id, sum_a, sum_b, forms) of every record with a letter or digit: sums of the fields' hashes, which no order changes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for source_id, text in zip(pdf["source_id"], pdf["text"], strict=True):
                if own := forms(text):
                    digests = [hashed(x) for x in own]
                    a = _signed(sum(int.from_bytes(x[:8], "big") for x in digests))
                    b = _signed(sum(int.from_bytes(x[8:], "big") for x in digests))
                    rows.append((source_id, a, b, own))
            yield pd.DataFrame(rows, columns=["source_id", "sum_a", "sum_b", "forms"])

    return records(df).mapInPandas(run, RECORD)


def _same_fields(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([Counter(a) == Counter(b) for a, b in zip(left, right, strict=True)], dtype=bool)


def copies(df: DataFrame, hashed: Callable[[str], bytes] = digest) -> DataFrame:
    """(kept_source_id, copy_source_id): for each set of copies every record but the one with the smallest source_id.

    Records are grouped by their two sums, from ids and sums alone; only records of a group of several have their normalised fields
    fetched and held, text against text, against those of the kept record: a single field by comparison, several by counting each, never
    by sorting. A set that holds a third of all rows is aggregated before the shuffle, and its join against the one kept record is split
    by Spark where skewed. Records whose sums agree but whose fields differ go through the same steps again among themselves, until
    none is left, whatever the hash.
    """
    stages = Stages(df.sparkSession)
    rest = stages.write(fingerprints(df, hashed))
    same, out = F.pandas_udf(_same_fields, T.BooleanType()), None
    while True:
        several = rest.groupBy("sum_a", "sum_b").agg(F.min("source_id").alias("kept_source_id"), F.max("source_id").alias("last")).where("kept_source_id <> last").drop("last")
        members = stages.write(rest.join(several, ["sum_a", "sum_b"]))  # only these have their fields read again
        kept = members.where("source_id = kept_source_id").groupBy("sum_a", "sum_b", "kept_source_id").agg(F.first("forms").alias("kept_forms"))
        held = members.where("source_id <> kept_source_id").drop("kept_source_id").join(kept, ["sum_a", "sum_b"])
        one = (F.size("forms") == 1) & (F.size("kept_forms") == 1)
        single = held.where(one).withColumn("equal", F.col("forms")[0] == F.col("kept_forms")[0])
        many = held.where(~one & (F.size("forms") == F.size("kept_forms"))).withColumn("equal", same("forms", "kept_forms"))
        unlike = held.where(F.size("forms") != F.size("kept_forms")).withColumn("equal", F.lit(False))
        wrong = "IF(equal, NULL, forms) AS forms"  # the fields of proven copies aren't needed any more
        checked = stages.write(single.unionByName(many).unionByName(unlike).selectExpr("source_id", "sum_a", "sum_b", "kept_source_id", "equal", wrong))
        found = checked.where("equal").select("kept_source_id", F.col("source_id").alias("copy_source_id")).distinct()
        out = found if out is None else out.union(found)
        rest = checked.where("NOT equal").select("source_id", "sum_a", "sum_b", "forms")
        if rest.isEmpty():
            return out


def copy_counts(df: DataFrame) -> DataFrame:
    """One row for each kept record with the number of its copies, itself included: collapsed rows of the whole table."""
    lost = copies(df)
    ids = records(df).select("source_id").distinct()
    sizes = lost.groupBy("kept_source_id").agg((F.count("*") + 1).alias("n_copies"))
    left = ids.join(lost, ids["source_id"] == lost["copy_source_id"], "left_anti")
    return left.join(sizes, left["source_id"] == sizes["kept_source_id"], "left").select(left["source_id"].alias("kept_source_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))
