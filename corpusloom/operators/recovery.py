"""Work by partitions with markers of what is done, which survives attempts that fail, and work taken up again at a stored cursor."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import Stages
from corpusloom.sources import files

OUTCOME = "part int, done boolean, reused boolean, n_rows long"


def _marker(root: str, part: int) -> str:
    return f"{root}/part-{part:05d}.done.json"


def attempt(parts: DataFrame, root: str, failing: int | None) -> DataFrame:
    """(part, done, reused, n_rows): one attempt at every partition of (part, paths). A partition with a marker is taken from it; the
    others' rows are counted in their files' footers and a marker is written. The first attempt at ``failing`` fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                marker, begun = _marker(root, x["part"]), f"{root}/part-{x['part']:05d}.begun"
                if files.exists(marker):
                    rows.append({"part": x["part"], "done": True, "reused": True, "n_rows": json.loads(files.read_bytes(marker))["row_count"]})
                    continue
                first = not files.exists(begun)
                files.write_bytes(begun, b"")
                if x["part"] == failing and first:
                    rows.append({"part": x["part"], "done": False, "reused": False, "n_rows": 0})
                    continue
                n = sum(files.footer_rows(p) for p in x["paths"] or ())
                files.write_bytes(marker, json.dumps({"partition": x["part"], "row_count": n}).encode())
                rows.append({"part": x["part"], "done": True, "reused": False, "n_rows": n})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("done", pa.bool_()), ("reused", pa.bool_()), ("n_rows", pa.int64())]))

    return parts.select("part", "paths").mapInArrow(run, OUTCOME)


def run_with_retry(spark: SparkSession, parts: DataFrame, root: str, failing: int | None) -> DataFrame:
    """(round, part, done, reused, n_rows) of three rounds: all partitions, those that failed, and a pass over all that finds the markers.
    Each round is staged, so that none is attempted again when the result is read."""
    stages = Stages(spark)
    first = stages.write(attempt(parts, root, failing))
    lost = parts.join(first.where("NOT done").select("part"), "part", "left_semi")
    again = stages.write(attempt(lost, root, failing))
    last = stages.write(attempt(parts, root, failing))
    named = [x.withColumn("round", F.lit(n)) for n, x in ((1, first), (2, again), (3, last))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def store_cursor(path: str, epoch: int, step: int) -> None:
    files.write_bytes(path, json.dumps({"epoch": epoch, "step": step}).encode())


def load_cursor(path: str) -> tuple[int, int]:
    x = json.loads(files.read_bytes(path))
    return x["epoch"], x["step"]


def before(epoch: int, step: int):
    """Whether a row of a schedule stands before the cursor."""
    return (F.col("epoch") < epoch) | ((F.col("epoch") == epoch) & (F.col("step") < step))


def parallelism_contract(spark: SparkSession) -> DataFrame:
    """(mode, partitioned, replicated, risk, lineage): what each way of parallel training splits, and what its data has to keep track of. Fixed values."""
    rows = [
        ("data_parallel", "batches", "model parameters", "samples repeated between ranks or uneven shards", "global_step, rank, sequence_id"),
        ("tensor_parallel", "tensors within a layer", "tokens of one micro-batch", "sequences of differing shape block the collective", "global_step, micro_batch, sequence_shape"),
        ("pipeline_parallel", "layers", "micro-batches across stages", "too few micro-batches leave stages idle", "global_step, micro_batch, stage"),
        ("expert_parallel", "experts", "input of the router", "skewed routes load experts unevenly", "token, route, expert, capacity_drop"),
        ("zero", "optimizer state, gradients, parameters", "the global order of the data", "state shards don't fit another world size", "checkpoint, world_size, shard_owner"),
    ]
    return spark.createDataFrame(rows, "mode string, partitioned string, replicated string, risk string, lineage string")
