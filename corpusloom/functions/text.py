"""Expressions over texts: normalisation, identity, words, shingles and marks of personal information."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as white space inside a line, in the syntax that Java and RE2 share.
BLANK = r"[\t\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000} ]+"
#: The reference's patterns for addresses and mainland mobile numbers.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?<![0-9])(?:\+?86[- ]?)?1[3-9][0-9]{9}(?![0-9])"
WORD = r"[\p{L}\p{N}_]+"


def _compatible(texts: pa.Array) -> pa.Array:
    return pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in texts.to_pylist()], pa.string())


def compatible(column: Column | str) -> Column:
    """NFKC, in Arrow batches: the one step that Spark has no expression for. Null stays null. (pyarrow's own utf8_normalize
    leaves accents apart in its composed forms, so it can't be used.)"""
    return F.arrow_udf(_compatible, T.StringType())(column)


def tidy(column: Column | str) -> Column:
    """One line end, single blanks inside lines, no blank lines; null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, BLANK, " ")
    return F.regexp_replace(F.regexp_replace(c, "[ \n]*\n[ \n]*", "\n"), "^[ \n]+|[ \n]+$", "")


def normalize(column: Column | str) -> Column:
    """The normal form of a document's text: compatibility forms, then tidy()."""
    return tidy(compatible(column))


def digest(column: Column | str) -> Column:
    """SHA-256 in hex."""
    return F.sha2(F.encode(column, "UTF-8") if isinstance(column, Column) else F.encode(F.col(column), "UTF-8"), 256)


def doc_id(sha: Column | str) -> Column:
    return F.concat(F.lit("doc_"), F.substring(sha, 1, 16))


def words(column: Column | str) -> Column:
    """Runs of letters, digits and underscores, case folded. ß, the one letter of our alphabets where folding isn't lowering, is written out."""
    return F.regexp_extract_all(F.replace(F.lower(column), F.lit("ß"), F.lit("ss")), F.lit(f"({WORD})"), 1)


def shingles(column: Column | str, size: int) -> Column:
    """The distinct runs of ``size`` words; all words where there are fewer; none where there is no word."""

    def of(w: Column) -> Column:  # the words are a variable here, so that they are computed once and not for every shingle
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < size, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(runs))

    return F.element_at(F.transform(F.array(words(column)), of), 1)


def shingle_hashes(column: Column | str, size: int) -> Column:
    """The same runs as hashes of 64 bits, sorted: eight bytes each instead of ``size`` words. Two texts are judged wrongly only if two of
    their own runs agree in the hash, for runs of n words together about once in 2^65 / n^2 pairs."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < size, F.array(F.xxhash64(w))).otherwise(F.array_sort(F.array_distinct(runs)))

    return F.element_at(F.transform(F.array(words(column)), of), 1)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared over all members of two arrays of distinct members; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def has_email(column: Column | str) -> Column:
    return F.coalesce(F.rlike(column, F.lit(EMAIL)), F.lit(False))


def has_phone(column: Column | str) -> Column:
    return F.coalesce(F.rlike(column, F.lit(PHONE)), F.lit(False))


def hash_partition(key: Column | str, parts: int) -> Column:
    """The first 64 bits of the key's SHA-256 modulo the number of partitions. A null key is taken as an empty one."""
    head = F.conv(F.substring(digest(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit(""))), 1, 16), 16, 10)
    return F.pmod(head.cast("decimal(20,0)"), F.lit(parts).cast("decimal(20,0)")).cast("int")


def seeded_rank(*parts: Column | str | int) -> Column:
    """A hash-random sort key from a seed and an id."""
    return F.sha2(F.concat_ws(":", *(F.lit(str(p)) if isinstance(p, int) else p for p in parts)), 256)
