"""Evaluation texts leaking into training text (problem 5).

Windows of items and of the corpus are embedded by random walks that map edit distance to Hamming distance (Chakraborty,
Goldenberg, Koucky 2016), positions of the embeddings are sampled in as many repetitions as the target recall takes, and windows
that agree in one repetition are candidates. Each candidate is then verified exactly by edit distance on the texts.

A leak is a run of ``run`` consecutive letters and digits of an item (all of a shorter item's) that the record holds with at
most ``max_edits`` edits, or proportionally fewer in a shorter run. Windows follow the size of the item's run: they are about half as
long, and stand, in the corpus, so far apart that any run holds one whole, and in the items at every place. Windows of the whole run
would have to stand at every place of the corpus, which costs some twenty times as much. Items are put in classes by the length of
their run, each with windows of its size.

Defined results: items or records without a letter or digit, null or empty ones among them, give no row; rows of one source_id
are one item or record that has every text of its rows; other columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.lookalike import letters, records
from corpusloom.session import Stages, spread

RUN = 40
RECALL = 0.95
#: Signatures of items that are looked up at once: what is sent to every executor. More items are searched in several passes.
BLOCK_SIGNATURES = 2_000_000
#: Letters of an item that are one segment; longer items are several, which overlap by a run.
SEGMENT = 20_000
#: Sampled places of a walk, of which a third or so lie behind the window: with fewer, chance agreements outnumber leaks by far.
SAMPLED, SAMPLED_EDITS = 12, 14
#: Shortest runs of the classes below ``run``; a run with edits is in a class of its own edits.
CLASSES = (20, 12, 6, 1)
MOST_REPEATS = 1000
LOW_BITS = 20


@dataclass(frozen=True)
class Plan:
    """Windows and repetitions for the items whose run has at least ``least`` letters."""

    least: int
    width: int
    stride: int
    repeats: int
    sampled: int
    edits: int


def edits_for(length: int, run: int, max_edits: int) -> int:
    """The edits that a run of that length may have: in proportion to the whole run's."""
    return max_edits * min(length, run) // run


def plan_for(length: int, max_edits: int = 0, recall: float = RECALL, run: int = RUN) -> Plan:
    """The class of a run's length. Two windows that differ by k edits differ, in expectation, in at most 4k places of the 3w that
    the walk visits, so that a sample of m places agrees with probability (1 - 4k/3w)^m at least, and repetitions follow from it.
    Where that takes more than MOST_REPEATS, the parameters are refused, not the recall lowered."""
    edits = edits_for(length, run, max_edits)
    floor = 1 if not edits else next(n for n in range(1, run + 1) if edits_for(n, run, max_edits) == edits)
    least = run if length >= run else max(floor, next(x for x in CLASSES if length >= x))
    width = max(1, (least - edits) // 2)
    sampled = SAMPLED_EDITS if edits else SAMPLED
    alike = max(0.0, 1 - 4 * edits / (3 * width)) ** min(sampled, 3 * width)
    repeats = 1 if not edits else math.ceil(math.log(1 - recall) / math.log(1 - alike)) if 0 < alike < 1 else MOST_REPEATS + 1
    if repeats > MOST_REPEATS:
        raise ValueError(f"runs of {least} letters with {edits} edits take more than {MOST_REPEATS} repetitions for a recall of {recall}")
    return Plan(least, width, max(1, least - width - edits + 1), repeats, sampled, edits)


def _words(codes: np.ndarray, seed: int) -> np.ndarray:
    """A random word of 64 bits for each character: bit j says whether the walk moves on at step j."""
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xBF58476D1CE4E5B9) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Windows:
    """The windows at the given starts of one text or several joined ones, ready to be embedded again and again.

    Characters are numbers of a small alphabet, and each window is a row of its own that ends in a sign on which no walk moves on.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray, plan: Plan):
        self.plan, self.n = plan, len(starts)
        seen = np.zeros(int(codes.max(initial=0)) + 1, dtype=bool)
        seen[codes] = True
        self.alphabet = np.flatnonzero(seen)
        number = np.cumsum(seen, dtype=np.int32) - 1
        cells = np.full((self.n, plan.width + 1), len(self.alphabet), dtype=np.int32)
        for k in range(plan.width):
            cells[:, k] = number[codes[starts + k]]
        self.cells = cells.ravel()

    def signatures(self, repeat: int) -> np.ndarray:
        """For each window a hash of the sampled places of its walk."""
        plan = self.plan
        steps, seed = 3 * plan.width, repeat * 1000 + plan.least
        sampled = min(plan.sampled, steps)
        places = set(np.random.default_rng(seed).choice(steps, sampled, replace=False).tolist())
        words = [_words(self.alphabet, seed * 8 + i) for i in range(-(-steps // 64))]
        moves = np.zeros((steps, len(self.alphabet) + 1), dtype=np.int64)
        for j in range(steps):
            moves[j, :-1] = (words[j // 64] >> np.uint64(j % 64)) & np.uint64(1)
        value = np.append(_words(self.alphabet, seed + 77), np.uint64(0))
        out = np.full(self.n, plan.least * 131 + repeat, dtype=np.uint64)
        row, some = plan.width + 1, 1 << 14  # so many at once that they stay in the cache
        with np.errstate(over="ignore"):
            for lo in range(0, self.n, some):
                own = out[lo : lo + some]
                at = np.arange(lo, lo + len(own), dtype=np.int64) * row
                for j in range(max(places) + 1):
                    here = self.cells.take(at)
                    if j in places:
                        own *= np.uint64(0x9FB21C651E98DF25)
                        own += value.take(here)
                    at += moves[j].take(here)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)


def signatures(codes: np.ndarray, starts: np.ndarray, plan: Plan, repeat: int) -> np.ndarray:
    return Windows(codes, starts, plan).signatures(repeat)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _starts(length: int, plan: Plan, stride: int) -> np.ndarray:
    return np.arange(0, length - plan.width + 1, stride, dtype=np.int64) if length >= plan.width else np.zeros(0, np.int64)


def longest_run(item: str, text: str, i: int, j: int, width: int) -> int:
    """How long the two agree around item[i:i+width] and text[j:j+width]; 0 if they differ there."""
    if item[i : i + width] != text[j : j + width]:
        return 0
    a, b, c, d = i, j, i + width, j + width
    while a > 0 and b > 0 and item[a - 1] == text[b - 1]:
        a, b = a - 1, b - 1
    while c < len(item) and d < len(text) and item[c] == text[d]:
        c, d = c + 1, d + 1
    return c - a


def least_edits(part: str, text: str, most: int) -> int:
    """The smallest edit distance between the part and any substring of the text; most + 1 where it is larger. The columns of the
    distance table are bit vectors (Myers 1999), of any length here."""
    if not part:
        return 0
    held: dict[str, int] = {}
    for k, c in enumerate(part):
        held[c] = held.get(c, 0) | 1 << k
    full, top = (1 << len(part)) - 1, 1 << len(part) - 1
    up, down, now = full, 0, len(part)
    best = now
    for c in text:
        same = held.get(c, 0)
        zero = ((same & up) + up ^ up) | same | down
        grow = down | ~(zero | up) & full
        fall = up & zero
        now += (grow & top > 0) - (fall & top > 0)
        grow, fall = grow << 1, fall << 1
        up = (fall | ~(zero | grow)) & full
        down = grow & zero & full
        if now < best:
            best = now
    return min(best, most + 1)


def within(part: str, text: str, at: int, most: int, slack: int) -> int:
    """The smallest edit distance between the part and a substring of the text that begins at most ``slack`` from its place ``at``; most + 1 where
    it is larger. Of most + 1 pieces of the part one at least must stand unchanged near its own place, which few chance candidates have."""
    cuts = [len(part) * k // (most + 1) for k in range(most + 2)]
    part_of = lambda a, b: text[max(0, at + a - slack) : max(0, at + b + slack)]
    if not any(part[a:b] in part_of(a, b) for a, b in zip(cuts, cuts[1:], strict=False)):
        return most + 1
    return least_edits(part, part_of(0, len(part)), most)


def verified(item: str, text: str, i: int, j: int, plan: Plan, run: int) -> int | None:
    """The edits of the leak around a candidate's windows, or None where there is none."""
    need = min(run, len(item))
    if longest_run(item, text, i, j, plan.width) >= need:
        return 0
    most = plan.edits
    if not most or within(item[i : i + plan.width], text, j, most, most) > most:
        return None
    best = None
    for a in range(max(0, i + plan.width - need), min(i, len(item) - need) + 1):
        edits = within(item[a : a + need], text, j - (i - a), most, 2 * plan.edits)
        if edits <= most and (best is None or edits < best):
            best = edits
            most = max(0, edits - 1)
    return best


LEAK = "eval_source_id string, source_id string, edits int"


def _segments(item: str, run: int) -> Iterator[str]:
    """The item, or pieces of a long one that hold each of its runs whole."""
    for at in range(0, max(1, len(item) - run + 1), SEGMENT - run + 1):
        yield item[at : at + SEGMENT]


def item_segments(evaluation: DataFrame, run: int, max_edits: int, recall: float) -> DataFrame:
    """(eval_source_id, segment, least): the items' letters and digits, cut into segments, with the class of their run."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for source_id, text in zip(pdf["source_id"], pdf["text"], strict=True):
                if own := letters(text):
                    least = plan_for(min(run, len(own)), max_edits, recall, run).least
                    out += [(source_id, x, least) for x in _segments(own, run)]
            yield pd.DataFrame(out, columns=["eval_source_id", "segment", "least"])

    return records(evaluation).mapInPandas(rows, "eval_source_id string, segment string, least int").distinct()


Lookup = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def item_signatures(segments: list[str], least: list[int], plans: dict[int, Plan]) -> dict[tuple[int, int], Lookup]:
    """By class and repetition: (signature, number of the segment, place in it) of every window of every segment, in order of signature, and
    which low bits any of the signatures has, which most windows of a corpus fail."""
    out = {}
    for kind in sorted(set(least)):
        plan, own = plans[kind], [k for k, x in enumerate(least) if x == kind]
        starts = [_starts(len(segments[k]), plan, 1) for k in own]
        begins = np.cumsum([0, *(len(segments[k]) for k in own)])[:-1]
        who, at = np.repeat(np.array(own, dtype=np.int32), [len(s) for s in starts]), np.concatenate(starts).astype(np.int32)
        windows = Windows(_codes("".join(segments[k] for k in own)), np.concatenate([s + o for s, o in zip(starts, begins, strict=True)]), plan)
        for repeat in range(plan.repeats):
            sign = windows.signatures(repeat)
            order = np.argsort(sign, kind="stable")
            low = np.zeros(1 << LOW_BITS, dtype=bool)
            low[sign & ((1 << LOW_BITS) - 1)] = True
            out[kind, repeat] = (sign[order], who[order], at[order], low)
    return out


def leaks(corpus: DataFrame, evaluation: DataFrame, run: int = RUN, max_edits: int = 0, recall: float = RECALL, block_signatures: int = BLOCK_SIGNATURES) -> DataFrame:
    """(eval_source_id, source_id, edits): every item and record such that the record holds a run of the item, with the fewest edits found.

    Items' segments are sent to the executors in blocks of bounded size, for each of which their windows are embedded once a worker and
    records are embedded, looked up and verified in one pass without a shuffle: every block goes the same way and every text of every row
    is read whole. A held-out set is small beside its corpus; one of more than a block costs a pass for each further block.
    """
    stages = Stages(corpus.sparkSession)
    lengths = range(1, run + 1) if max_edits else (*CLASSES, run)
    plans = {p.least: p for p in (plan_for(n, max_edits, recall, run) for n in lengths)}
    segments = stages.write(item_segments(evaluation, run, max_edits, recall).withColumn("segment_id", F.xxhash64("eval_source_id", "segment")))
    repeats = F.create_map(*(F.lit(x) for p in plans.values() for x in (p.least, p.repeats)))
    made = segments.agg(F.coalesce(F.sum(F.length("segment") * repeats[F.col("least")]), F.lit(0))).first()[0]
    blocks = max(1, -(-made // block_signatures))
    texts, out = spread(records(corpus)), None
    for block in range(blocks):  # segments are dealt by hash, with all their signatures
        found = _in_one_pass(texts, segments.where(F.pmod(F.col("segment_id"), F.lit(blocks)) == block), plans, run)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("eval_source_id", "source_id").agg(F.min("edits").alias("edits"))


_HELD: dict[str, tuple] = {}


def _held(sent: object, plans: dict[int, Plan]) -> tuple:
    """A block's names, segments and signatures: made once by each worker, which keeps the last block only."""
    key, names, segments, least = sent.value
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = (names, segments, item_signatures(segments, least, plans))
    return _HELD[key]


def _in_one_pass(texts: DataFrame, segments: DataFrame, plans: dict[int, Plan], run: int) -> DataFrame:
    known = segments.orderBy("segment_id").collect()  # a block at most
    used = [plans[x] for x in sorted({r["least"] for r in known})]
    sent = texts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [r["eval_source_id"] for r in known], [r["segment"] for r in known], [r["least"] for r in known]))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, segments, lookups = _held(sent, plans)
        for pdf in batches:
            found: dict[tuple[int, int], int] = {}
            own = [letters(t) for t in pdf["text"]]
            offsets = np.cumsum([0, *map(len, own)])
            codes = _codes("".join(own))
            for plan in used:
                starts = [_starts(len(t), plan, plan.stride) for t in own]
                flat = np.concatenate([s + o for s, o in zip(starts, offsets, strict=False)] or [np.zeros(0, np.int64)])
                if not len(flat):
                    continue
                row, tried, windows = np.repeat(np.arange(len(own)), [len(s) for s in starts]), set(), Windows(codes, flat, plan)
                for repeat in range(plan.repeats):
                    sign = windows.signatures(repeat)
                    keys, who, where, low = lookups[plan.least, repeat]
                    hit = np.flatnonzero(low[sign & ((1 << LOW_BITS) - 1)])
                    for h, first, last in zip(hit, np.searchsorted(keys, sign[hit], "left"), np.searchsorted(keys, sign[hit], "right"), strict=True):
                        if first == last:
                            continue
                        r = int(row[h])
                        j = int(flat[h] - offsets[r])
                        for k in range(first, last):
                            item, i = int(who[k]), int(where[k])
                            if found.get((item, r)) == 0 or (item, r, i, j) in tried:
                                continue
                            tried.add((item, r, i, j))
                            edits = verified(segments[item], own[r], i, j, plan, run)
                            if edits is not None and edits < found.get((item, r), 1 << 30):
                                found[item, r] = edits
            yield pd.DataFrame([(names[a], pdf["source_id"].iloc[r], e) for (a, r), e in found.items()], columns=["eval_source_id", "source_id", "edits"])

    return texts.mapInPandas(scan, LEAK)
