"""Personal information inside free text (problem 6).

A character-level bidirectional LSTM with CRF transitions, trained in numpy (see personal_train), marks spans of five types.
A text of any length is cut in overlapping windows, each is read by the LSTM in both directions, where windows overlap their
scores are averaged with more weight on the window in whose middle a character stands, and one Viterbi pass over the whole
text decodes them globally. Spans are then widened to whole words and held against what their type must contain.

Characters are read in their look-alike form (problem 1) and spans refer to the stored text, of which all else is kept.

Defined results: a null text stays null and holds nothing, an empty one stays empty; rows of one source_id are one record in
``found_types`` (each row by itself in ``redacted``); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import io
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.lookalike import mapping, records
from corpusloom.session import spread

TYPES = ("email", "phone", "identity_number", "street_address", "person_name")
#: Outside, and for each type its first and its further characters.
TAGS = ["O", *(f"{x}-{t}" for t in TYPES for x in "BI")]
WEIGHTS = Path(__file__).with_name("personal_weights.npz")
WINDOW, STRIDE = 512, 448
BATCH = 512

#: Taken off the score of O: chosen on check_s, where it finds more and marks little more wrongly.
LEAN = 0.1

#: Ids of characters: 0 padding, 1 to 95 printable ASCII, then named signs, classes, and BUCKETS for ideographs.
SIGNS = "，。：；、（）！？“”‘’《》【】「」—–…·"
BUCKETS = 1024
CLASSES = ("Lu", "Ll", "L", "N", "P", "S", "Z", "C", "M")
FIRST_CLASS = 96 + len(SIGNS)
FIRST_BUCKET = FIRST_CLASS + len(CLASSES)
VOCABULARY = FIRST_BUCKET + BUCKETS


def _id(ch: str) -> int:
    cp = ord(ch)
    if 32 <= cp < 127:
        return cp - 31
    if ch in SIGNS:
        return 96 + SIGNS.index(ch)
    if 0x3400 <= cp < 0xA000 or 0x20000 <= cp < 0x33480:
        return FIRST_BUCKET + cp % BUCKETS
    base = unicodedata.normalize("NFD", ch)[0]
    if base != ch and 32 <= ord(base) < 127:
        return ord(base) - 31
    kind = unicodedata.category(ch)
    return FIRST_CLASS + next(i for i, k in enumerate(CLASSES) if kind.startswith(k))


@lru_cache(1)
def _basic() -> np.ndarray:
    """The id of each character of the basic plane, -1 for those that show nothing."""
    out = np.full(0x10000, FIRST_CLASS + CLASSES.index("L"), dtype=np.int16)
    for cp in (*range(0x3000), *range(0x3000, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000)):
        out[cp] = _id(chr(cp))
    out[0x3400:0xA000] = FIRST_BUCKET + np.arange(0x3400, 0xA000) % BUCKETS
    for a, b in mapping().items():
        if len(a) == 1 and ord(a) < 0x10000:
            out[ord(a)] = _id(b[0]) if b else -1
    return out


def read(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a text's visible characters and their places in it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ids = _basic()[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF):
        seen = mapping().get(chr(codes[i]), chr(codes[i]))
        ids[i] = _id(seen[0]) if seen else -1
    places = np.flatnonzero(ids >= 0)
    return ids[places].astype(np.int64), places


class Model:
    """The trained network, for decoding: float32, with the first layer's products looked up by character."""

    def __init__(self, weights: dict[str, np.ndarray]):
        w = {k: v.astype(np.float32) for k, v in weights.items()}
        self.hidden = w["f_wh"].shape[0]
        half = np.full(4 * self.hidden, 0.5, np.float32)  # a sigmoid is a tanh of half its input
        half[3 * self.hidden :] = 1
        self.half = half
        self.first = [(w["e"] @ w[f"{d}_wx"] + w[f"{d}_b"]) * half for d in "fb"]
        self.next = np.stack([w[f"{d}_wh"] * half for d in "fb"])
        w["bo"][0] -= LEAN
        self.out, self.bias, self.moves, self.begin = w["wo"], w["bo"], w["a"], w["s"]

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """(steps, windows, tags) for ids (steps, windows). Both directions take a step together, the other one from the end."""
        steps, n, h = len(ids), ids.shape[1], self.hidden
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        z, out = np.empty((2, n, 4 * h), np.float32), np.empty((2, steps, n, h), np.float32)
        for t in range(steps):
            np.matmul(state, self.next, out=z)
            z[0] += self.first[0].take(ids[t], 0)
            z[1] += self.first[1].take(ids[steps - 1 - t], 0)
            np.tanh(z, out=z)
            gates = z[:, :, : 3 * h]
            gates *= 0.5
            gates += 0.5
            cell *= gates[:, :, h : 2 * h]
            cell += gates[:, :, :h] * z[:, :, 3 * h :]
            np.tanh(cell, out=state)
            state *= gates[:, :, 2 * h :]
            out[0, t], out[1, steps - 1 - t] = state[0], state[1]
        return out[0] @ self.out[:h] + out[1] @ self.out[h:] + self.bias

    def bounds(self) -> tuple[float, int]:
        """(margin, depth): where, for more than ``depth`` characters to either side, O scores higher than any other tag by that margin, no
        best path has another tag. A tagged piece that reaches into such a stretch gains at most ``enter`` and ``leave`` at its ends
        and ``stay`` for each further character over the path that has O there, and loses the margin for each."""
        a = self.moves
        stay = float(a[1:, 1:].max() - a[0, 0])
        enter = max(float((a[:, 1:] - a[:, :1]).max()), float((self.begin[1:] - self.begin[0]).max()))
        leave = max(float((a[1:] - a[:1]).max()), 0.0)
        margin = max(stay, 0.0) + 1.5
        return margin, int(np.ceil(max(0.0, enter + leave - stay) / (margin - stay))) + 1

    def _paths(self, scores: list[np.ndarray], opens: list[bool], closes: list[bool]) -> list[np.ndarray]:
        """The best tags of each piece, those of like length together. A piece that doesn't open or close its text has O beside it."""
        out: list = [None] * len(scores)
        order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
        at = 0
        while at < len(order):
            longest = len(scores[order[min(at + 511, len(order) - 1)]])
            some = order[at : at + max(1, min(512, 400_000 // longest))]
            at += len(some)
            size = np.array([len(scores[i]) for i in some])
            top, n = int(size.max()), len(some)
            padded = np.zeros((top, len(TAGS), n), np.float32)
            for k, i in enumerate(some):
                padded[: size[k], :, k] = scores[i]
            start = np.where(np.array([opens[i] for i in some]), self.begin[:, None], self.moves[0][:, None])
            end = np.where(np.array([closes[i] for i in some]), 0, self.moves[:, :1]).astype(np.float32)
            best = np.empty((top, len(TAGS), n), np.float32)
            best[0] = padded[0] + start
            final = best[0] + end
            for t in range(1, top):
                np.add((best[t - 1][:, None] + self.moves[:, :, None]).max(0), padded[t], out=best[t])
                final = np.where(t == size - 1, best[t] + end, final)
            tag, rows = final.argmax(0), np.arange(n)
            tags = np.zeros((n, top), np.int64)
            for t in range(top - 1, -1, -1):
                live = t < size
                tags[rows[live], t] = tag[live]
                if t:
                    tag = np.where(live, (best[t - 1] + self.moves[:, tag]).argmax(0), tag)
            for k, i in enumerate(some):
                out[i] = tags[k, : size[k]]
        return out

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each text, by Viterbi over the whole of it. What must be O on every best path is found first (see bounds);
        the pieces between don't depend on one another."""
        margin, depth = self.bounds()
        tags = [np.zeros(len(x), np.int64) for x in scores]
        pieces, opens, closes, where = [], [], [], []
        for i, x in enumerate(scores):
            if not len(x):
                continue
            unsure = np.flatnonzero(x[:, 0] - x[:, 1:].max(1) <= margin)
            if not len(unsure):
                continue
            gaps = np.flatnonzero(np.diff(unsure) > 2 * depth + 1)
            for first, last in zip(unsure[np.concatenate(([0], gaps + 1))], unsure[np.concatenate((gaps, [len(unsure) - 1]))], strict=True):
                lo, hi = max(0, first - depth), min(len(x), last + depth + 1)
                pieces.append(x[lo:hi])
                opens.append(lo == 0)
                closes.append(hi == len(x))
                where.append((i, lo, hi))
        for (i, lo, hi), own in zip(where, self._paths(pieces, opens, closes), strict=True):
            tags[i][lo:hi] = own
        return tags

    def tags(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The tags of texts given as ids."""
        of, start = [], []
        for i, ids in enumerate(texts):
            for s in range(0, max(1, len(ids) - (WINDOW - STRIDE)), STRIDE) if len(ids) else ():
                of.append(i)
                start.append(s)
        total = [np.zeros((len(x), len(TAGS)), np.float32) for x in texts]
        weight = [np.zeros((len(x), 1), np.float32) for x in texts]
        trust = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None] ** 2
        size = np.array([min(WINDOW, len(texts[i]) - s) for i, s in zip(of, start, strict=True)], dtype=np.int64)
        order = np.argsort(size, kind="stable")  # windows of like length go together, so that little padding is computed
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            ids = np.zeros((int(size[part[-1]]), len(part)), np.int64)
            for k, w in enumerate(part):
                ids[: size[w], k] = texts[of[w]][start[w] : start[w] + size[w]]
            found = self.scores(ids)
            for k, w in enumerate(part):
                i, s, n = of[w], start[w], size[w]
                if n == len(texts[i]):
                    total[i], weight[i] = found[:n, k], np.ones((n, 1), np.float32)
                else:
                    total[i][s : s + n] += found[:n, k] * trust[:n]
                    weight[i][s : s + n] += trust[:n]
        return self.decode([a / b if len(a) else a for a, b in zip(total, weight, strict=True)])


#: Fixed checks: what a span of each type must contain.
_MUST = {
    "email": lambda s: re.search(r"[^\s@]@[^\s@]+\.|[\[(]?\bat\b[\])]?|＠", s, re.I) is not None,
    "phone": lambda s: sum(c.isdigit() for c in s) >= 7,
    "identity_number": lambda s: sum(c.isdigit() for c in s) >= 6,
    "street_address": lambda s: re.search(r"\d[A-Za-z]?,?\s+[A-Z]|[\u3400-\u9fff]\s*\d+\s*[\u3400-\u9fff]", s) is not None,
    "person_name": lambda s: re.search(r"[A-ZÀ-Þ]|[\u3400-\u9fff]", s) is not None and sum(c.isalpha() for c in s) >= 2 and not any(c.isdigit() for c in s),
}


def _word(a: str, b: str) -> bool:
    """Whether two neighbouring characters are of one word (of a script with words)."""
    return a.isalnum() and b.isalnum() and ord(a) < 0x2E80 and ord(b) < 0x2E80


def spans(text: str, tags: np.ndarray, places: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, type) in the stored text."""
    out: list[list] = []
    for k in np.flatnonzero(tags):
        tag, at = tags[k], places[k]
        kind = TYPES[(tag - 1) // 2]
        if tag % 2 == 0 and out and out[-1][2] == kind and out[-1][3] == at:
            out[-1][1] = at + 1
        else:
            out.append([at, at + 1, kind, at])
        nexts = np.searchsorted(places, at, "right")
        out[-1][3] = places[nexts] if nexts < len(places) else -1
    done: list[tuple[int, int, str]] = []
    for a, b, kind, _ in out:
        while a > 0 and _word(text[a - 1], text[a]):
            a -= 1
        while b < len(text) and _word(text[b - 1], text[b]):
            b += 1
        if done and a < done[-1][1]:
            a = done[-1][1]
        if a < b and _MUST[kind](unicodedata.normalize("NFKC", text[a:b])):
            done.append((int(a), int(b), kind))
    return done


def load(data: bytes) -> Model:
    with np.load(io.BytesIO(data)) as file:
        return Model(dict(file))


def find_spans(model: Model, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    read_all = [read(t or "") for t in texts]
    return [spans(t or "", tags, places) for t, tags, (_, places) in zip(texts, model.tags([ids for ids, _ in read_all]), read_all, strict=True)]


def _sent(df: DataFrame, weights: Path | str) -> object:
    """The weights as a broadcast: a file of this package, of fixed size (under 1 MB)."""
    return df.sparkSession.sparkContext.broadcast(Path(weights).read_bytes())


_LOADED: dict[int, Model] = {}


def _model(sent: object) -> Model:
    data = sent.value
    key = hash(data)
    if key not in _LOADED:
        _LOADED[key] = load(data)
    return _LOADED[key]


def found_types(df: DataFrame, weights: Path | str = WEIGHTS) -> DataFrame:
    """(source_id, pii_type): every type that a record's text holds at least once. One pass; only types found are shuffled."""
    sent = _sent(df, weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = find_spans(_model(sent), list(pdf["text"]))
            yield pd.DataFrame([(i, k) for i, own in zip(pdf["source_id"], found, strict=True) for k in {x[2] for x in own}], columns=["source_id", "pii_type"])

    return spread(records(df)).mapInPandas(run, "source_id string, pii_type string").distinct()


def redacted(df: DataFrame, weights: Path | str = WEIGHTS) -> DataFrame:
    """(source_id, text) of every row, a typed placeholder such as [EMAIL] in place of every item."""
    sent = _sent(df, weights)

    def put(text: str | None, own: list[tuple[int, int, str]]) -> str | None:
        for a, b, kind in reversed(own):
            text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
        return text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            yield pdf.assign(text=[put(t, own) for t, own in zip(texts, find_spans(_model(sent), texts), strict=True)])

    return spread(df.select(F.col("source_id").cast("string").alias("source_id"), F.col("text").cast("string").alias("text"))).mapInPandas(run, "source_id string, text string")
