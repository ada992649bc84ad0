"""Filling fixed-capacity containers with items (problem 4).

Linear grouping: the large lengths are sorted, cut in groups of equal cardinality and rounded up to each group's longest;
the few sizes that remain make configurations, whose best mix is found by column generation; the actual documents take the
places of the rounded ones, and small ones are put, longest first, where they fit best.

Lengths are in code points. A text longer than a container is cut into full pieces and a remainder; no other text is split.

Defined results: null and empty texts have length 0 and go into a container that is there anyway; rows of one source_id are one
record (of differing texts the longest counts); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
GROUPS = 32
#: Lengths above this part of a container are large.
LARGE_PART = 3
SHARD_ITEMS = 20_000


def _best_patterns(sizes: np.ndarray, need: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Configurations and how often to use each (a fractional optimum of min sum x, A x >= need), by column generation.

    Pricing is an unbounded knapsack over the capacity; a simplex basis of one column per size is kept and exchanged.
    """
    k = len(sizes)
    basis = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    amount = need / np.diag(basis)
    for _ in range(20 * k):
        inverse = np.linalg.inv(basis)
        price = np.ones(k) @ inverse
        best, choice = np.zeros(capacity + 1), []
        for _ in range(int(capacity // sizes.min())):
            gain = np.full((k, capacity + 1), -1.0)
            for i, s in enumerate(sizes):
                gain[i, s:] = best[: capacity + 1 - s] + price[i]
            pick = gain.argmax(0)
            top = gain[pick, np.arange(capacity + 1)]
            better = top > best + 1e-12
            choice.append(np.where(better, pick, -1))
            best = np.where(better, top, best)
            if not better.any():
                break
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for layer in reversed(choice):
            if layer[room] >= 0:
                column[layer[room]] += 1
                room -= sizes[layer[room]]
        step = inverse @ column
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        amount = amount - ratio[out] * step
        amount[out] = ratio[out]
        basis[:, out] = column
    return basis.T.astype(int), np.maximum(amount, 0)


def fill(lengths: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, large_part: int = LARGE_PART) -> np.ndarray:
    """The container of each item; lengths are at most the capacity."""
    lengths = np.asarray(lengths, dtype=np.int64)
    place = np.full(len(lengths), -1, dtype=np.int64)
    room: list[int] = []
    order = np.argsort(-lengths, kind="stable")
    large = order[lengths[order] > capacity // large_part]
    if len(large):
        parts = np.array_split(large, min(groups, len(large)))
        stacks = [list(p[::-1]) for p in parts]
        sizes = np.array([lengths[p[0]] for p in parts])
        merged: dict[int, list] = {}
        for s, stack in zip(sizes, stacks, strict=True):  # groups that round to one length are one size
            merged.setdefault(int(s), []).extend(stack)
        sizes, stacks = np.array(list(merged)), list(merged.values())
        for pattern, times in zip(*_best_patterns(sizes, np.array([len(s) for s in stacks], dtype=float), capacity), strict=True):
            for _ in range(int(times + 1e-9)):
                if any(len(stack) < n for stack, n in zip(stacks, pattern, strict=True)):
                    break
                left = capacity
                for stack, n in zip(stacks, pattern, strict=True):
                    for _ in range(n):
                        item = stack.pop()
                        place[item], left = len(room), left - lengths[item]
                room.append(int(left))
    free = sorted((r, b) for b, r in enumerate(room))
    for item in order:
        if place[item] >= 0:
            continue
        need = int(lengths[item])
        at = bisect_left(free, (need, -1))
        if at < len(free):
            left, container = free.pop(at)
        else:
            left, container = capacity, len(room)
            room.append(capacity)
        place[item] = container
        room[container] = left - need
        insort(free, (left - need, container))
    return place


SHARE = "source_id string, n long, first long, n_full long, sequence_id long, unused int"


def pack(df: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row for every record, or piece of a record longer than a container: its container and that container's unused room.

    Items are dealt by a hash of their ids into shards of about ``shard_items`` records, as many as the table needs, and each
    shard is packed whole by one task from ids and lengths alone. A shard wastes at most a container or so beyond the best, a
    share that stays the same at any size. Full pieces are containers of their own; they are numbered by arithmetic and made after
    the packing, so that one giant text is one row in its shard.
    """
    sized = df.where("source_id IS NOT NULL").select(F.col("source_id").cast("string").alias("source_id"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n")).groupBy("source_id").agg(F.max("n").alias("n"))
    shards = max(1, -(-df.count() // shard_items))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source_id", ignore_index=True)
        n = pdf["n"].to_numpy()
        full = np.maximum(0, -(-n // capacity) - 1)
        rest = n - full * capacity
        place = fill(rest, capacity)
        used = np.bincount(place, weights=rest).astype(np.int64)
        base = int(key[0]) << 40
        first = base + int(place.max()) + 1 + np.cumsum(full) - full
        return pd.DataFrame({"source_id": pdf["source_id"], "n": n, "first": first, "n_full": full, "sequence_id": base + place, "unused": (capacity - used[place]).astype(np.int32)})

    placed = sized.withColumn("shard", F.pmod(F.xxhash64("source_id"), F.lit(shards))).groupBy("shard").applyInPandas(one, SHARE)
    piece = placed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_full"))))
    last = F.col("piece") == F.col("n_full")
    return piece.select(
        "source_id",
        F.col("piece").cast("int").alias("piece"),
        F.when(last, F.col("n") - F.col("n_full") * capacity).otherwise(capacity).cast("int").alias("n_chars"),
        F.when(last, F.col("sequence_id")).otherwise(F.col("first") + F.col("piece")).alias("sequence_id"),
        F.when(last, F.col("unused")).otherwise(0).cast("int").alias("unused"),
    )
