"""Texts that look the same but are stored with other characters (problem 1).

``mapped`` replaces look-alike letters, digits, ligatures and spaces. The mapped texts are grouped under Spark's accent-sensitive
UNICODE collation, which decides what is equal: it passes over characters that show nothing and holds accents, letter case,
punctuation and spaces apart. One canonical member per class is chosen and joined back. ``fold`` is the same form for code that
has no collation at hand (problems 3, 5 and 6): mapped, without what shows nothing, accents composed.

Defined results: a null text folds to null and an empty one to an empty text; texts without a letter or digit
form no class; rows of one source_id are one record that has every text of its rows; columns other
than source_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import Stages

#: Letters of other scripts drawn like Latin ones. Coptic, Cherokee, Lisu and Latin are pairs of Unicode's published confusables.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХҮԚԜаеорсухѕіјһԁԛԝӏү", "ABESIJKMHOPCTYXYQWaeopcyxsijhdqwly")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj")
ARMENIAN = ("ԼՍՕոսօցհ", "LUOnuoqh")
COPTIC = ("ⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬ", "HIKMNOoPpCcTYX")
CHEROKEE = ("ᎠᎡᎢᎩᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏚᏞᏟᏢᏦᏴꭵꮃꮓꮩꮪꮯ", "DRTYAJEWMHYGZRWSLCPKBiwzvsc")
LISU = ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU")
LATIN = ("ɑɡ", "ag")
#: Radicals without a decomposition and the ideographs that look the same.
RADICALS = ("⺁⺋⺌⺎⺟⺠⺮⺼⻁⻄⻅⻆⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻧⻨⻩⻬⻮⻰⻳", "厂㔾小兀母民竹月虎西见角贝车长门青韦页风飞食马骨鬼鱼鸟卤麦黄齐齿龙龟")
#: Blocks whose compatibility forms are ligatures, digraphs, Roman numerals or radicals.
COMPAT_BLOCKS = ((0x132, 0x133), (0x1C7, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0x2E80, 0x2FDF), (0xFB00, 0xFB17))
#: Where characters with a mapping can stand; format characters that show something.
SCANNED = ((0x7F, 0x3400), (0xA640, 0xAC00), (0xF900, 0x10000), (0x10780, 0x107C0), (0x13430, 0x13440), (0x1BCA0, 0x1BCA4), (0x1D173, 0x1D17B), (0x1D400, 0x1D800), (0x1EE00, 0x1EF00), (0x1FBF0, 0x1FBFA), (0xE0000, 0xE0200))
SHOWN_FORMAT = frozenset([*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD])
BLANK = frozenset([0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)])
VISIBLE_CONTROL = frozenset("\t\n\x0b\x0c\r\x85")


def _target(cp: int) -> str | None:
    """What a character turns into; None where it stays."""
    ch = chr(cp)
    kind = unicodedata.category(ch)
    if cp in BLANK or kind == "Cf" and cp not in SHOWN_FORMAT or kind == "Cc" and ch not in VISIBLE_CONTROL:
        return ""
    if kind == "Zs":
        return " "
    parts = unicodedata.decomposition(ch).split()
    if not parts or parts[0][0] != "<":
        return None
    compat = parts[0] == "<compat>" and any(a <= cp <= b for a, b in COMPAT_BLOCKS)
    plain = unicodedata.normalize("NFKC", ch)
    if (compat or parts[0] in ("<wide>", "<narrow>", "<font>")) and all(unicodedata.category(c)[0] in "LN" for c in plain):
        return plain
    return None


@lru_cache(1)
def mapping() -> dict[str, str]:
    """Every changed character and its replacement: from Unicode's properties by rule, and the fixed values above."""
    out = {}
    for a, b in ((0, 0x20), *SCANNED):
        for cp in range(a, b):
            if (to := _target(cp)) is not None:
                out[chr(cp)] = to
    for left, right in (CYRILLIC, GREEK, ARMENIAN, COPTIC, CHEROKEE, LISU, LATIN, RADICALS):
        out |= dict(zip(left, right, strict=True))
    # a replacement may itself be a look-alike (a mathematical alpha, say)
    return {k: "".join(out.get(c, c) for c in v) for k, v in out.items() if k != v}


@lru_cache(1)
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """For ASCII texts, for the basic plane and beyond it: a set with characters beyond is searched one by one."""
    group = lambda keep: re.compile("[" + "".join(re.escape(c) for c in sorted(mapping()) if keep(c)) + "]")
    return group(str.isascii), group(lambda c: c <= "\uffff"), group(lambda c: c > "\uffff")


def fold(text: str | None) -> str | None:
    """The text in which everything that looks the same is the same: look-alikes mapped, unseen characters gone, accents composed."""
    if text is None:
        return None
    table, (ascii_only, basic, beyond) = mapping(), _patterns()
    put = lambda m: table[m[0]]
    if text.isascii():
        return ascii_only.sub(put, text)
    out = basic.sub(put, unicodedata.normalize("NFD", text))
    if max(out, default="") > "\uffff":
        out = beyond.sub(put, out)
    return unicodedata.normalize("NFC", out)


_REST = re.compile(r"[\W_]+")


def letters(text: str | None) -> str:
    """Only the letters and digits of the folded text, letter case ignored."""
    return _REST.sub("", fold(text).casefold()) if text else ""


def _fold_all(texts: pd.Series) -> pd.Series:
    return texts.map(fold, na_action="ignore")


def fold_column(column: Column | str) -> Column:
    """fold() over a column, in Arrow batches (Spark has no Unicode normalisation of its own)."""
    return F.pandas_udf(_fold_all, T.StringType())(column)


def records(df: DataFrame) -> DataFrame:
    """source_id and text, whatever other columns there are; rows without an id or text are no records."""
    return df.select(F.col("source_id").cast("string").alias("source_id"), F.col("text").cast("string").alias("text")).where("source_id IS NOT NULL AND text IS NOT NULL")


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: What shows nothing and yet has a weight in the collation, so that the mapping takes it out.
FILLERS = "\u115f\u1160\u3164\uffa0"


@lru_cache(1)
def _replaced() -> tuple[dict[str, str], re.Pattern, re.Pattern]:
    """What mapped() replaces (not what the collation passes over by itself), on the basic plane and beyond it."""
    own = {k: v for k, v in mapping().items() if v or k in FILLERS}
    group = lambda keep: re.compile("[" + "".join(re.escape(c) for c in sorted(own) if keep(c)) + "]")
    return own, group(lambda c: c <= "\uffff"), group(lambda c: c > "\uffff")


def mapped(text: str) -> str:
    """The text with look-alikes mapped, accents apart."""
    if text.isascii():
        return text
    table, basic, beyond = _replaced()
    put = lambda m: table[m[0]]
    out = basic.sub(put, unicodedata.normalize("NFD", text))
    return beyond.sub(put, out) if max(out, default="") > "\uffff" else out


MAPPED = "source_id string, stored binary, bucket long, marks long, mapped string"


def _map_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for source_id, text in zip(pdf["source_id"], pdf["text"], strict=True):
            form = mapped(text)
            if key := _REST.sub("", form):
                accents = "" if form.isascii() else "".join(c for c in form if unicodedata.combining(c) or c > "\u02ff" and unicodedata.category(c)[0] == "M" and mapping().get(c) != "")
                rows.append((source_id, blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), _hash(key), _hash(accents), form))
        yield pd.DataFrame(rows, columns=["source_id", "stored", "bucket", "marks", "mapped"])


VARIED = """
SELECT bucket FROM {rows} GROUP BY bucket HAVING min(stored) <> max(stored)
"""
#: One row for each stored text of a bucket, with its first record: copies cost nothing from here on.
VERSIONS = """
SELECT r.bucket, r.stored, r.marks, r.mapped, min(struct(r.source_id, r.origin)) AS first
FROM {rows} r JOIN {varied} v ON r.bucket = v.bucket GROUP BY r.bucket, r.stored, r.marks, r.mapped
"""
CLASSES = """
SELECT bucket, marks, mapped COLLATE UNICODE AS look, min(struct(first, mapped)) AS canonical
FROM {versions} GROUP BY bucket, marks, mapped COLLATE UNICODE HAVING count(*) > 1
"""
JOINED_BACK = """
SELECT v.bucket, v.stored, c.canonical.first.source_id AS canonical_source_id, c.canonical.first.origin AS canonical_origin, c.canonical.mapped AS canonical_mapped
FROM {versions} v JOIN {classes} c ON v.bucket = c.bucket AND v.marks = c.marks AND v.mapped COLLATE UNICODE = c.look
"""
MEMBERS = """
SELECT DISTINCT j.canonical_source_id, j.canonical_origin, r.origin, r.source_id, r.stored
FROM {rows} r JOIN {joined} j ON r.bucket = j.bucket AND r.stored = j.stored
"""
CONSISTENT = """
SELECT r.source_id, coalesce(j.canonical_mapped, r.mapped) AS mapped
FROM {rows} r LEFT JOIN {joined} j ON r.bucket = j.bucket AND r.stored = j.stored
"""


def _classed(stages: Stages, tables: tuple[DataFrame, ...], collated: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, joined): every record's mapped text, and for every stored text of a class the canonical member.

    Collation is slow on whole texts, so records are first put in buckets by their letters and digits alone, a key that texts equal
    under the collation share. (The one exception: it takes digits of all scripts for equal, which are visible differences.) Buckets
    with one stored text go no further, and copies of one stored text are one row. The collation then decides. ``marks`` is an
    exact check beside it, as the collation gives one weight to several marks of rare scripts.
    """
    spark, every = tables[0].sparkSession, None
    for i, df in enumerate(tables):
        own = records(df).mapInPandas(_map_all, MAPPED).withColumn("origin", F.lit(i))
        every = own if every is None else every.unionByName(own)
    rows = stages.write(every)
    versions = stages.write(spark.sql(VERSIONS, rows=rows, varied=spark.sql(VARIED, rows=rows)))
    under = (lambda q: q) if collated else (lambda q: q.replace(" COLLATE UNICODE", ""))
    classes = spark.sql(under(CLASSES), versions=versions)
    return rows, stages.write(spark.sql(under(JOINED_BACK), versions=versions, classes=classes))


def look_alike_members(*tables: DataFrame, collated: bool = True) -> DataFrame:
    """The members of every class of records that look the same and aren't all stored the same, with the class's canonical member,
    the one with the smallest source_id. A class of any size is joined back with one row for each stored text, so that Spark can
    split it. Without ``collated`` texts are compared as they are, which shows what the collation does."""
    stages = Stages(tables[0].sparkSession)
    rows, joined = _classed(stages, tables, collated)
    return stages.write(tables[0].sparkSession.sql(MEMBERS, rows=rows, joined=joined))


def look_alike_pairs(*tables: DataFrame, collated: bool = True) -> DataFrame:
    """Every pair of records whose stored texts differ although they look the same, smaller source_id first.

    A class of n records gives its n(n-1)/2 pairs only where the stored texts differ, which is the result that is asked for;
    look_alike_members has the same classes with one row a record.
    """
    m = look_alike_members(*tables, collated=collated)
    left, right = m.alias("l"), m.alias("r")
    same = (F.col("l.canonical_source_id") == F.col("r.canonical_source_id")) & (F.col("l.canonical_origin") == F.col("r.canonical_origin"))
    pairs = left.join(right, same & (F.col("l.stored") != F.col("r.stored")) & (F.col("l.source_id") < F.col("r.source_id")))
    return pairs.select(F.col("l.source_id").alias("left_source_id"), F.col("r.source_id").alias("right_source_id")).distinct()


def consistent_texts(*tables: DataFrame) -> DataFrame:
    """(source_id, text) of every row: the canonical member's text, joined back to its class, or the row's own, in the folded form.
    Rows without a letter or digit, which form no class, keep their own; null stays null."""
    stages = Stages(tables[0].sparkSession)
    rows, joined = _classed(stages, tables)
    classed = tables[0].sparkSession.sql(CONSISTENT, rows=rows, joined=joined).select("source_id", fold_column("mapped").alias("text"))
    for df in tables:
        own = df.select(F.col("source_id").cast("string").alias("source_id"), F.col("text").cast("string").alias("text"))
        bare = own.where("source_id IS NULL OR text IS NULL").union(records(df).mapInPandas(_bare, "source_id string, text string"))
        classed = classed.union(bare.select("source_id", fold_column("text")))
    return classed


def _bare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[[not _REST.sub("", mapped(t)) for t in pdf["text"]]]
