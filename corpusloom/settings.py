"""Settings of the pipelines, refused where they make no sense. The defaults marked so are fixed values that the reference has."""

from __future__ import annotations

from dataclasses import dataclass


class Checked:
    """A setting lists what must hold in rules(): (holds, what is wrong otherwise)."""

    def rules(self) -> list[tuple[bool, str]]:
        raise NotImplementedError

    def __post_init__(self) -> None:
        if wrong := [text for holds, text in self.rules() if not holds]:
            raise ValueError(f"{type(self).__name__}: {'; '.join(wrong)}")


def _share(x: float) -> bool:
    return 0 < x <= 1


@dataclass(frozen=True)
class Audit(Checked):
    """Near duplicates, contamination and admission. Five words and 0.8 are this library's own; REFERENCE has the fixed values."""

    words: int = 5
    similarity: float = 0.8
    contamination: float = 0.8
    min_chars: int = 40
    licenses: tuple[str, ...] = ("project-original", "cc-by-4.0")

    def rules(self):
        return [
            (self.words >= 1, "words must be 1 at least"),
            (_share(self.similarity), "similarity must lie above 0 and at 1 at most"),
            (_share(self.contamination), "contamination must lie above 0 and at 1 at most"),
            (self.min_chars >= 1, "min_chars must be 1 at least"),
            (bool(self.licenses), "licenses must not be empty"),
        ]


#: Three words and 0.45.
REFERENCE = Audit(words=3, similarity=0.45, contamination=0.45)


@dataclass(frozen=True)
class Version(Checked):
    """Windows and shards of a data set version. The lengths are this library's own, for tables of its size."""

    length: int = 1024
    shard_sequences: int = 64
    seed: int = 42

    def rules(self):
        return [(self.length >= 2, "length must be 2 at least"), (self.shard_sequences >= 1, "shard_sequences must be 1 at least")]


@dataclass(frozen=True)
class Compute(Checked):
    """Repeated rows, a hot key and partitions: fixed values."""

    repeat: int = 64
    partitions: int = 8
    hot_share: float = 0.75
    failing: int = 3

    def rules(self):
        return [
            (self.repeat >= 1, "repeat must be 1 at least"),
            (self.partitions >= 2, "partitions must be 2 at least"),
            (0 < self.hot_share < 1, "hot_share must lie between 0 and 1"),
            (0 <= self.failing < self.partitions, "failing must be one of the partitions"),
        ]


@dataclass(frozen=True)
class Feed(Checked):
    """Delivery to workers in batches."""

    batch: int = 32
    epochs: int = 3
    workers: int = 2

    def rules(self):
        return [(self.batch >= 1, "batch must be 1 at least"), (self.epochs >= 1, "epochs must be 1 at least"), (self.workers >= 1, "workers must be 1 at least")]


@dataclass(frozen=True)
class Storage(Checked):
    """Read and write workloads; samples and writers are fixed values."""

    scans: int = 2
    samples: int = 256
    writers: int = 4

    def rules(self):
        return [(min(self.scans, self.samples, self.writers) >= 1, "scans, samples and writers must be 1 at least")]


@dataclass(frozen=True)
class Comparison(Checked):
    """Runs of several seeds."""

    seeds: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7)
    validation: float = 0.1

    def rules(self):
        return [(len(self.seeds) >= 2 and len(set(self.seeds)) == len(self.seeds), "seeds must be two at least, all different"), (0 < self.validation < 1, "validation must lie between 0 and 1")]
