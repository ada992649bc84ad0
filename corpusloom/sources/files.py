"""Scans of JSON lines and files, and sinks: JSON lines, Parquet, shards."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([T.StructField("source_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("metadata", T.VariantType()), T.StructField("_bad", T.StringType())])
BLOCK = 8 << 20


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, violations) of JSON lines: unreadable lines, and missing or empty ids and texts, are violations."""
    rows = spark.read.schema(RAW).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    why = F.when(F.col("_bad").isNotNull(), "unreadable").when(F.coalesce(F.col("source_id"), F.lit("")) == "", "no_source_id").when(F.trim(F.coalesce(F.col("text"), F.lit(""))) == "", "no_text")
    marked = rows.withColumn("violation", why)
    return marked.where("violation IS NULL").drop("_bad", "violation"), marked.where("violation IS NOT NULL").select("source_id", "violation")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, its members sorted by name."""
    df.select(F.to_json(F.struct(*sorted(df.columns)))).write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_shards(df: DataFrame, path: str, shard: str = "shard", order: str = "seq") -> None:
    """One folder for each shard, its rows in order."""
    write_parquet(df.repartition(shard).sortWithinPartitions(shard, order), path, shard)


def write_partitions(rows: DataFrame, path: str, column: str) -> None:
    """One folder for each value of the column. Every task writes its own files there, so that a value with most of the rows is no task's alone."""
    write_parquet(rows, path, column)


def listed(spark: SparkSession, path: str, pattern: str, name: str = "value") -> DataFrame:
    """(name, paths): the data files of a folder by what the pattern's group takes from their path, in sorted order."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return found.groupBy(F.regexp_extract("path", pattern, 1).alias(name)).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def _system(path: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), re.sub("^file:/+", "/", path)) if path.startswith(("file:", "/")) else fs.FileSystem.from_uri(path)


def exists(path: str) -> bool:
    system, inner = _system(path)
    return system.get_file_info(inner).type.name != "NotFound"


def write_bytes(path: str, data: bytes) -> None:
    system, inner = _system(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    with system.open_output_stream(inner) as out:
        out.write(data)


def read_bytes(path: str) -> bytes:
    system, inner = _system(path)
    with system.open_input_stream(inner) as f:
        return f.read()


def footer_rows(path: str) -> int:
    """Rows of a Parquet file, from its footer alone."""
    import pyarrow.parquet as pq

    system, inner = _system(path)
    with system.open_input_file(inner) as f:
        return pq.ParquetFile(f).metadata.num_rows


def _read(path: str, offset: int, length: int) -> bytes:
    system, inner = _system(path)
    with system.open_input_file(inner) as f:
        f.seek(offset)
        got = f.read(length)
    if len(got) != length:
        raise OSError(f"{path}: {len(got)} of {length} bytes at {offset}")
    return got


def sequential_bytes(spark: SparkSession, paths: list[str], block: int = BLOCK) -> DataFrame:
    """(path, block, n_bytes, sha256) of all bytes of all files in the folders or files named. Each file is read in blocks of a
    fixed size, so that no task holds a whole file and a large file is many tasks' work. Blocks are digested as they are read."""
    listed = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"))
    total = listed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // (16 * block)))
    blocks = listed.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / block))).alias("block")).repartition(tasks)

    def scan(batches):
        for batch in batches:
            for x in batch.to_pylist():
                at = x["block"] * block
                got = _read(x["path"], at, min(block, x["size"] - at))
                yield pa.RecordBatch.from_pydict({"path": [x["path"]], "block": [x["block"]], "n_bytes": [len(got)], "sha256": [hashlib.sha256(got).hexdigest()]})

    return blocks.mapInArrow(scan, "path string, block long, n_bytes long, sha256 string")


def write_lines(lines: DataFrame, root: str, path: str = "path", order: str = "order", line: str = "text") -> None:
    """One text file for each path, its lines in order."""
    lines.repartition(path).sortWithinPartitions(path, order).select(path, line).write.partitionBy(path).text(root)


def read_lines(spark: SparkSession, index: DataFrame, root: str) -> DataFrame:
    """index (path, offset, length, ...) with the line that stands there, read from the files of write_lines by seek and read."""
    named = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("file"), F.regexp_extract("path", "/path=([^/]+)/", 1).alias("path"))
    entries = index.join(named, "path", "left")  # Spark doesn't list empty files, and a line without a file must not vanish
    schema = T.StructType([*entries.drop("file").schema, T.StructField("line", T.BinaryType())])

    def seek(batches):
        for batch in batches:
            rows = batch.to_pylist()
            if lost := sorted({x["path"] for x in rows if x["file"] is None}):
                raise FileNotFoundError(f"no lines in {lost[:3]}")
            got = [_read(x["file"], x["offset"], x["length"]) for x in rows]
            yield batch.drop_columns(["file"]).append_column("line", pa.array(got, pa.binary()))

    return entries.mapInArrow(seek, schema)
