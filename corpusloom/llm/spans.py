"""Long exact spans shared between records (problem 9).

Suffix automata of reference shards give the matching statistics of what is streamed past them. A shard that is sent to every task
and met by every document would cost the square of the corpus, so shards are cut by content: every span of ``span`` characters
holds an anchor, the least hash among its windows of ANCHOR characters, that depends on the span alone. Documents that share
a span share its anchors, and the places around one anchor, in all documents that hold it, are a reference shard: an automaton is
built of one place's text and the others are streamed through it for spans of at least ``span`` characters.

An anchor in more places than COLD_PLACES isn't one shard but as many as its places have windows of ``span`` characters in common: each
place gives the hashes (128 bits) of all its windows, and the places that share one are a shard, whose first place's window makes the
automaton. It is joined to the others, one row for a shard, and they are streamed through it, in as many tasks as Spark likes, so that
no task holds a shard and every match is verified on the texts. Nothing is dropped or capped.

Defined results: null and empty texts and those shorter than ``span`` share nothing; a document is never paired with itself; rows
repeated with one doc_id are one document; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import Stages

SPAN = 200
ANCHOR = 100
COLD_PLACES = 64
#: Characters that are hashed at once, which bounds a task's memory; longer documents are hashed in pieces that overlap.
CHUNK, PIECE = 1 << 18, 1 << 22
#: Of hashes that agree but for these low bits the leftmost is the anchor; enough to count the characters hashed at once.
PLACE_BITS = 24
#: Odd multipliers of the rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


class Automaton:
    """The suffix automaton of one text."""

    __slots__ = ("step", "link", "length")

    def __init__(self, text: str):
        step: list[dict] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    clone = len(step)
                    step.append(step[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new
        self.step, self.link, self.length = step, link, length

    def spans(self, text: str, least: int) -> list[tuple[int, int]]:
        """The maximal pieces (start, end) of the text, of at least that many characters, that stand in the automaton's text."""
        step, link, length = self.step, self.link, self.length
        state, now, out = 0, 0, []
        for i, c in enumerate(text):
            while state and c not in step[state]:
                if now >= least and (not out or out[-1][1] != i):
                    out.append((i - now, i))
                state = link[state]
                now = length[state]
            if c in step[state]:
                state = step[state][c]
                now += 1
            else:
                now = 0
        if now >= least:
            out.append((len(text) - now, len(text)))
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(n, b, dtype=np.uint64)
            row[0] = 1
            out.append(np.multiply.accumulate(row))
        _POWERS[base] = tuple(out)
    up, down = _POWERS[base]
    return up[:n], down[:n]


def window_hashes(codes: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """A hash of every window of that width."""
    with np.errstate(over="ignore"):
        up, down = _powers(base, len(codes))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(base)) * up)))
        return _mixed((sums[width:] - sums[:-width]) * down[: len(codes) - width + 1])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _thinned(places: np.ndarray, hashes: np.ndarray, of: np.ndarray, reach: int) -> np.ndarray:
    """Which anchors to keep: in a run of equal ones, as repeated text has them, so many that any ``reach`` places in a row that hold
    one hold one of those kept. The spans around them are the same."""
    keep = np.ones(len(places), dtype=bool)
    tied = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1]) & (places[1:] - places[:-1] <= reach)
    last = None
    for k in np.flatnonzero(tied) + 1:  # k is tied to k - 1
        if last is None or last < k - 1 and not tied[k - 2]:
            last = k - 1
        if k < len(tied) and tied[k] and places[k + 1] - places[last] <= reach:
            keep[k] = False
        else:
            last = k
    return keep


def anchors(texts: list[str], span: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of texts of at least ``span`` characters: number of the text, place in it, hash. They depend on the ``span``
    characters around them alone, not on what else is hashed at once."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = _codes("".join(texts))
    hashes = window_hashes(codes, width)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    reach, done = span - width + 1, 1
    while done < reach:
        by = min(done, reach - done)
        least = np.minimum(least[:-by], least[by:])
        done += by
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    out = np.zeros(len(codes) + 2, dtype=np.int32)
    np.add.at(out, begins, 1)
    np.add.at(out, begins + lengths - span + 1, -1)
    inside = np.cumsum(out)[: len(least)] > 0
    places = np.unique((least[inside] & low).astype(np.int64))
    of = np.searchsorted(begins, places, "right") - 1
    keep = _thinned(places, hashes[places], of, reach)
    places, of = places[keep], of[keep]
    return of, places - begins[of], hashes[places].view(np.int64)


def _chunks(ids: pd.Series, texts: pd.Series, span: int) -> Iterator[tuple[list, list[int], list[str]]]:
    """(ids, first characters, texts) to hash at once."""
    own, begin, held, size = [], [], [], 0
    for i, whole in zip(ids, texts, strict=True):
        if whole is None or len(whole) < span:
            continue
        for at in range(0, max(1, len(whole) - span + 1), PIECE - span + 1):
            t = whole[at : at + PIECE]
            if size and size + len(t) > CHUNK:
                yield own, begin, held
                own, begin, held, size = [], [], [], 0
            own.append(i)
            begin.append(at)
            held.append(t)
            size += len(t)
    if own:
        yield own, begin, held


def shared_places(stages: Stages, documents: DataFrame, span: int, width: int) -> DataFrame:
    """(h, doc_id, at, link, place, before): the places of anchors that stand in two documents at least, with the text around.

    ``link`` is a hash of all text from the document's last such anchor to the end of this one. Only hashes and places of all
    documents are shuffled, and the texts once, to the places that are shared.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, begin, texts in _chunks(pdf["doc_id"], pdf["text"], span):
                of, at, h = anchors(texts, span, width)
                yield pd.DataFrame({"h": h, "doc_id": np.array(ids, dtype=np.int64)[of], "at": (np.array(begin)[of] + at).astype(np.int32)})

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text, held in zip(pdf["doc_id"], pdf["text"], pdf["held"], strict=True):
                last = None
                for at, h in sorted((x["at"], x["h"]) for x in held):
                    lo = max(0, at + width - span)
                    link = None if last is None else hash_text(text[last : at + width])
                    rows.append((h, doc_id, at, link, text[lo : at + span], at - lo))
                    last = at
            yield pd.DataFrame(rows, columns=["h", "doc_id", "at", "link", "place", "before"]).astype({"link": "Int64"})

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    found = stages.write(texts.where(F.length("text") >= span).mapInPandas(find, "h long, doc_id long, at int"))
    several = found.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h")
    held = found.join(several, "h").groupBy("doc_id").agg(F.collect_set(F.struct("at", "h")).alias("held"))
    return stages.write(texts.join(held, "doc_id").mapInPandas(around, "h long, doc_id long, at int, link long, place string, before int"))


def hash_text(text: str) -> int:
    from hashlib import blake2b

    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _matches(rows: list[tuple], span: int, pairs_only: bool) -> Iterator[tuple]:
    """Of the places of one anchor: (doc, doc) pairs, or (doc, start, end) of what other documents hold."""
    kinds: dict[str, list[tuple[int, int]]] = {}
    for doc_id, lo, place in rows:
        kinds.setdefault(place, []).append((doc_id, lo))
    texts = [t for t in kinds if len(t) >= span]
    for t in texts:
        docs = sorted({d for d, _ in kinds[t]})
        if len(docs) > 1:
            if pairs_only:
                yield from combinations(docs, 2)
            else:
                yield from ((d, lo, lo + len(t)) for d, lo in kinds[t])
    for i, reference in enumerate(texts):
        others = texts[i + 1 :] if pairs_only else texts[:i] + texts[i + 1 :]
        automaton = Automaton(reference) if others else None
        left = {d for d, _ in kinds[reference]}
        for other in others:
            if spans := automaton.spans(other, span):
                if pairs_only:
                    yield from {(min(a, b), max(a, b)) for a in left for b, _ in kinds[other] if a != b}
                else:
                    yield from ((d, lo + a, lo + b) for d, lo in kinds[other] if left - {d} for a, b in spans)


def _gathered(places: DataFrame, span: int, pairs_only: bool) -> DataFrame:
    """Cold anchors: the places of each are streamed through automata of one another, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, out = None, [], []
        for pdf in batches:
            for h, doc_id, at, place, before in zip(pdf["h"], pdf["doc_id"], pdf["at"], pdf["place"], pdf["before"], strict=True):
                if h != key:
                    out += _matches(rows, span, pairs_only)
                    key, rows = h, []
                rows.append((doc_id, at - before, place))
            yield pd.DataFrame(out, columns=names)
            out = []
        yield pd.DataFrame(list(_matches(rows, span, pairs_only)), columns=names)

    names = ["left_doc_id", "right_doc_id"] if pairs_only else ["doc_id", "start", "end"]
    return places.select("h", "doc_id", "at", "place", "before").repartition("h").sortWithinPartitions("h").mapInPandas(run, ", ".join(f"`{x}` long" for x in names))


def _windows(places: DataFrame, span: int) -> DataFrame:
    """Hot anchors: (a, b, before_a, h, doc_id, at, start) for every window of ``span`` characters around them; before_a: of the window one character earlier."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for h, doc_id, at, place, before in zip(pdf["h"], pdf["doc_id"], pdf["at"], pdf["place"], pdf["before"], strict=True):
                if len(place) >= span:
                    codes = _codes(place)
                    a, b = (window_hashes(codes, span, x).view(np.int64) for x in BASES)
                    n = len(a)
                    parts.append(pd.DataFrame({"a": a, "b": b, "before_a": pd.array([None, *a[:-1]], dtype="Int64"), "h": np.full(n, h), "doc_id": np.full(n, doc_id), "at": np.full(n, at, np.int32), "start": np.arange(n, dtype=np.int64) + at - before}))
            if parts:
                yield pd.concat(parts)

    return places.mapInPandas(run, "a long, b long, before_a long, h long, doc_id long, at int, start long")


@lru_cache(8)
def _automaton(text: str) -> Automaton:
    return Automaton(text)


def _streamed(span: int) -> Callable:
    def run(place: pd.Series, reference: pd.Series) -> pd.Series:
        return pd.Series([bool(_automaton(r).spans(p, span)) for p, r in zip(place, reference, strict=True)], dtype=bool)

    return F.pandas_udf(run, T.BooleanType())


def _sharded(stages: Stages, hot: DataFrame, span: int, first_only: bool) -> DataFrame:
    """(key, doc_id, start): the windows of hot anchors that stand in several documents, one key for each shard of equal windows, each
    verified by the automaton of its shard's first window. With ``first_only`` not those whose window before is as widely shared."""
    windows = stages.write(_windows(hot, span))
    groups = windows.groupBy("a", "b").agg(F.min("doc_id").alias("d"), F.max("doc_id").alias("e"), F.count("*").alias("n"), F.count("before_a").alias("m"), F.min("before_a").alias("p"), F.max("before_a").alias("q"))
    shards = groups.where("d < e" + " AND NOT (n = m AND p = q)" * first_only).select("a", "b")
    rows = windows.join(shards, ["a", "b"]).select("a", "b", "h", "doc_id", "at", "start")
    if first_only:
        rows = rows.groupBy("a", "b", "doc_id").agg(F.min(F.struct("start", "h", "at")).alias("x")).select("a", "b", "doc_id", "x.*")
    texts = hot.select("h", "doc_id", "at", "place", (F.col("at") - F.col("before")).alias("lo"))
    cut = F.substring(F.col("place"), (F.col("start") - F.col("lo") + 1).cast("int"), F.lit(span))
    members = stages.write(rows.join(texts, ["h", "doc_id", "at"]).select("a", "b", "doc_id", "start", cut.alias("window")))
    firsts = members.groupBy("a", "b").agg(F.min_by("window", F.struct("doc_id", "start")).alias("reference"))
    proven = members.join(firsts, ["a", "b"]).withColumn("equal", _streamed(span)("window", "reference"))
    name = F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string"))  # a window that only its hashes put there is a shard by its text
    return stages.write(proven.select(F.when(F.col("equal"), name).otherwise(F.col("window")).alias("key"), "doc_id", "start"))


def _kept(places: DataFrame, drop_linked: bool) -> tuple[DataFrame, DataFrame]:
    """Cold and hot places. An anchor that has the same text back to the anchor before, in all its places, finds nothing that this one doesn't."""
    groups = places.groupBy("h").agg(F.count("*").alias("n"), F.count("link").alias("linked"), F.min("link").alias("l"), F.max("link").alias("m"), F.min("doc_id").alias("d"), F.max("doc_id").alias("e"))
    wanted = groups.where("d < e" + (" AND NOT (linked = n AND l = m)" if drop_linked else "")).select("h", "n")
    rows = places.join(wanted, "h")
    return rows.where(F.col("n") <= COLD_PLACES), rows.where(F.col("n") > COLD_PLACES)


def shared_pairs(documents: DataFrame, span: int = SPAN, width: int = ANCHOR) -> DataFrame:
    """(left_doc_id, right_doc_id): every pair of documents with a verbatim span of at least ``span`` characters in common."""
    stages = Stages(documents.sparkSession)
    cold, hot = _kept(shared_places(stages, documents, span, width), True)
    firsts = _sharded(stages, hot, span, True).select("key", "doc_id").distinct()
    left, right = firsts.alias("l"), firsts.alias("r")
    joined = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.doc_id") < F.col("r.doc_id"))).select(F.col("l.doc_id").alias("left_doc_id"), F.col("r.doc_id").alias("right_doc_id"))
    return _gathered(cold, span, True).union(joined).distinct()


def shared_amounts(documents: DataFrame, span: int = SPAN, width: int = ANCHOR) -> DataFrame:
    """(doc_id, n_chars, shared_chars) of every document: how many of its characters stand in spans that other documents hold."""
    stages = Stages(documents.sparkSession)
    cold, hot = _kept(shared_places(stages, documents, span, width), False)
    windows = _sharded(stages, hot, span, False)
    several = windows.groupBy("key").agg(F.min("doc_id").alias("d"), F.max("doc_id").alias("e")).where("d < e").select("key")
    spans = _gathered(cold, span, False).union(windows.join(several, "key").select("doc_id", "start", (F.col("start") + span).alias("end"))).distinct()
    merged = spans.selectExpr("doc_id", "start", "end", "max(end) OVER (PARTITION BY doc_id ORDER BY start, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached")
    amounts = merged.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("reached", F.lit(0))))).alias("shared_chars"))
    sizes = documents.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.length("text")).cast("long").alias("n_chars"))
    return sizes.join(amounts, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("shared_chars", F.lit(0)).cast("long").alias("shared_chars"))
