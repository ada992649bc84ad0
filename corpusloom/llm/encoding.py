"""Encoding of the whole corpus with a public tokenizer (problem 7).

Encodings form a monoid: the text's halves are encoded, recursively down to short leaves, and neighbours are joined by encoding
a window around the seam again, which grows until the tokens outside provably stay: it ends at places that are a cut of the
tokenizer's pattern in any context (after the last letter of a run of letters, or the last digit of a run of digits).
Decoding concatenates up the same tree.

Defined results: an empty or null text gives an empty list; texts of special tokens are ordinary text; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

LEAF = 4096
FIRST_WINDOW = 32


class TreeEncoder:
    """Encoder and decoder of one byte-level vocabulary of ranks (tiktoken's format)."""

    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF, window: int = FIRST_WINDOW):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.leaf, self.window = leaf, window

    @staticmethod
    def _cut(text: str, i: int) -> bool:
        """Whether the pattern parts text[:i] from text[i:] whatever stands around: a letter ends a run of letters, a digit one of digits."""
        a = unicodedata.category(text[i - 1])[0]
        return a in "LN" and unicodedata.category(text[i])[0] != a

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text)) if text else []

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.own.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The encoding of text[lo:hi] from those of its parts; without a safe cut the window grows to the whole of a part."""
        a, span = mid, self.window
        while a > lo:
            reach = max(lo, mid - span)
            a = next((i for i in range(a - 1, reach, -1) if self._cut(text, i)), 0) or (lo if reach == lo else -1)
            if a >= 0:
                break
            a, span = reach + 1, span * 2
        b, span = mid, self.window
        while b < hi:
            reach = min(hi, mid + span)
            b = next((i for i in range(b + 1, reach) if self._cut(text, i)), 0) or (hi if reach == hi else -1)
            if b >= 0:
                break
            b, span = reach - 1, span * 2
        keep, drop = len(left), len(text[a:mid].encode("utf-8"))
        while drop > 0:
            keep -= 1
            drop -= len(self.bytes_of[left[keep]])
        skip, drop_right = 0, len(text[mid:b].encode("utf-8"))
        while drop_right > 0:
            drop_right -= len(self.bytes_of[right[skip]])
            skip += 1
        assert drop == 0 == drop_right, "a window's end isn't between two tokens"
        return left[:keep] + self.own.encode_ordinary(text[a:b]) + right[skip:]

    def decode(self, ids: list[int]) -> str:
        return self._bytes(ids, 0, len(ids)).decode("utf-8")

    def _bytes(self, ids: list[int], lo: int, hi: int) -> bytes:
        if hi - lo <= self.leaf:
            return b"".join(self.bytes_of[int(i)] for i in ids[lo:hi])
        mid = (lo + hi) // 2
        return self._bytes(ids, lo, mid) + self._bytes(ids, mid, hi)


def public_ranks(name: str = "byte_bpe_50k") -> str:
    """The path of a public vocabulary's ranks."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


@lru_cache(4)
def encoder(ranks_path: str, leaf: int = LEAF) -> TreeEncoder:
    """One encoder for each Python worker."""
    import public_tokenizers

    return TreeEncoder(ranks_path, public_tokenizers.PATTERN, leaf)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(key, ids) of every row. One pass without a shuffle; a task holds one Arrow batch at a time."""
    path = ranks_path or public_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, leaf)
        for batch in batches:
            ids = [own.encode(x or "") for x in batch.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.fromiter((t for x in ids for t in x), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    return df.selectExpr(f"`{key}` AS `{key}`", f"CAST(`{text}` AS string) AS `{text}_`").mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, ids array<int>")


def token_counts(df: DataFrame, keys: list[str], text: str = "text", ranks_path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """The keys and n_tokens of every row, by the same encoder; texts and ids stay in the task."""
    path, kinds = ranks_path or public_ranks(), dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path, leaf)
        for pdf in batches:
            n = [len(own.encode(x or "")) for x in pdf.pop("__text")]
            yield pdf.assign(n_tokens=np.array(n, dtype=np.int64))

    return df.selectExpr(*(f"`{k}`" for k in keys), f"CAST(`{text}` AS string) AS __text").mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n_tokens long")
