"""Session helpers: opening tables and cutting lineage durably."""

from __future__ import annotations

import atexit
import logging
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least, for work that takes much longer than reading: a table of a few files would
    else be a few tasks. A large table has more partitions than that and isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where a local session names none, as in tests, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    known = getattr(spark.sparkContext, "_loom_dir", None)
    if known is None:
        made = tempfile.mkdtemp(prefix="loom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        known = "file://" + made
        spark.sparkContext._loom_dir = known
        spark.sparkContext.setCheckpointDir(known)
    return known


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended; what is left lies in the cluster's own checkpoint folder
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_last(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception as e:  # noqa: BLE001 - nothing can be done any more while the interpreter ends
        logging.getLogger(__name__).warning("%s wasn't removed: %s", path, type(e).__name__)


_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, all tables that were staged within: for callers that know when they are done with their results."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(spark, path)


class Stages:
    """Tables written to the shared folder, so that what is computed once survives the loss of any executor.

    A written table cuts lineage like checkpoint() does, is columnar and compressed, and lets later scans
    prune columns. ``drop`` removes one table early, ``scope`` those of a whole computation; what is left goes when the interpreter ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}"
        self.made = 0
        if _SCOPES:
            _SCOPES[-1].append(self.root)
        else:
            atexit.register(_remove_last, spark, self.root)

    def write(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:04d}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._loom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        _remove(self.spark, df._loom_path)


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context, so that Python tasks can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_loom_shipped", False):
        return
    import zipfile
    from pathlib import Path

    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="loom-code-")  # the driver's own; Spark's file server sends it on
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "corpusloom.zip"
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(here.rglob("*.py")):
            out.write(p, f"{here.name}/{p.relative_to(here)}")
    context.addPyFile(str(target))
    context._loom_shipped = True
