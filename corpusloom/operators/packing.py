"""Token stream, fixed-length windows, provenance, shards and lineage.

The byte tokenizer has no merges: a document of b bytes is b + 2 tokens (begin, bytes, end), so that all positions are
arithmetic. Windows of length L start at 0, L, 2L ... below the stream's last token. No operator builds the stream as one array.
Empty tables give no windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.settings import Version

LENGTH = Version.length
SHARD_SEQUENCES = Version.shard_sequences
#: Documents of a bucket of the order, on average at most, and the least number of buckets.
BUCKET_DOCUMENTS, LEAST_BUCKETS = 1_000_000, 4096
#: Windows that one row stands for before it is dealt out.
CHUNK = 1 << 14


def offsets(docs: DataFrame) -> DataFrame:
    """docs (doc, pos, n_tokens, ...) with global_start and global_end in order of pos, doc.

    Two levels: a running sum inside buckets of the order, as many as the table needs, and one over the buckets' totals; a window
    over the whole table would be one task. Positions are taken as spread over their range.
    """
    top = docs.agg((F.coalesce(F.max("pos"), F.lit(0)) + 1).alias("top"), F.greatest(F.lit(LEAST_BUCKETS), F.ceil(F.count("*") / BUCKET_DOCUMENTS)).alias("buckets"))
    bucket = docs.crossJoin(F.broadcast(top)).withColumn("bucket", F.floor(F.col("pos") * F.col("buckets") / F.col("top"))).drop("top", "buckets")
    sums = bucket.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    base = sums.select("bucket", (F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("bucket")) - F.col("n")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("bucket").orderBy("pos", "doc"))
    placed = bucket.withColumn("inside", inside).join(base, "bucket")
    end = F.col("base") + F.col("inside")
    return placed.withColumn("global_end", end).withColumn("global_start", F.col("global_end") - F.col("n_tokens")).drop("bucket", "base", "inside")


def provenance(placed: DataFrame, length: int = LENGTH) -> DataFrame:
    """Which part of which document each window holds: the windows that a document's span meets, by arithmetic, not by a range join."""
    total = placed.agg(F.coalesce(F.max("global_end"), F.lit(0)).alias("total"))
    last = F.floor((F.col("global_end") - 1) / length)
    met = placed.crossJoin(F.broadcast(total)).withColumn("seq", F.explode(F.sequence(F.floor(F.col("global_start") / length), last))).where(F.col("seq") * length < F.col("total") - 1)
    start, end = F.greatest("global_start", F.col("seq") * length), F.least("global_end", (F.col("seq") + 1) * length)
    return met.withColumn("a", start).withColumn("b", end).select("seq", "doc", "source_id", "domain", (F.col("a") - F.col("seq") * length).cast("int").alias("sequence_token_start"), (F.col("b") - F.col("seq") * length).cast("int").alias("sequence_token_end"), (F.col("a") - F.col("global_start")).cast("long").alias("document_token_start"), (F.col("b") - F.col("global_start")).cast("long").alias("document_token_end"))


def sequences(total: DataFrame, length: int = LENGTH) -> DataFrame:
    """(seq, sequence_id, shard, trainable, padded) of the windows of a stream of ``total`` tokens: labels are the next tokens, padding is
    masked. Windows are dealt out in chunks, so that neither a row nor a task holds all of them."""
    n = F.greatest(F.lit(0), F.ceil((F.col("total") - 1) / length)).cast("long")
    chunks = total.select("total", n.alias("n")).where("n > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    dealt = chunks.repartition(int(total.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk")  # a number, else chunks of a few bytes are put together again
    each = dealt.withColumn("seq", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1)))
    left = F.col("total") - 1 - F.col("seq") * length
    return each.withColumn("trainable", F.least(F.lit(length), left).cast("int")).select("seq", F.format_string("seq_%08d", "seq").alias("sequence_id"), F.floor(F.col("seq") / SHARD_SEQUENCES).alias("shard"), "trainable", (F.lit(length) - F.col("trainable")).alias("padded"))


#: Bytes that UTF-8 never has, for begin and end; ids: 0 padding, 1 begin, 2 end, 4 + byte otherwise.
BEGIN, END = 0xFE, 0xFF
_IDS = np.arange(4, 260, dtype=np.int32)
_IDS[BEGIN], _IDS[END] = 1, 2
WINDOW = T.StructType([T.StructField("seq", T.LongType()), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("input_ids", "labels", "loss_mask"))])


def token_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(seq, input_ids, labels, loss_mask): tokens meet their window by position, a window's first token also as the last label of the one before.

    Tokens are shuffled as one byte each, in pieces that lie in one window; ids are made at the end. The pieces of one window have
    length + 1 bytes at most, so no group grows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, ats, parts = [], [], []
            for text, start in zip(batch["text"].to_pylist(), batch["global_start"].to_pylist(), strict=True):
                stream = bytes([BEGIN]) + text.encode("utf-8", "surrogatepass") + bytes([END])
                for seq in range(max(0, start - 1) // length, (start + len(stream) - 1) // length + 1):
                    a, b = max(start, seq * length), min(start + len(stream), (seq + 1) * length + 1)
                    if a < b:
                        seqs.append(seq)
                        ats.append(a)
                        parts.append(stream[a - start : b - start])
            yield pa.RecordBatch.from_pydict({"seq": pa.array(seqs, pa.int64()), "at": pa.array(ats, pa.int64()), "part": pa.array(parts, pa.binary())})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [b"".join(x["part"] for x in sorted(row, key=lambda x: x["at"])) for row in batch["parts"].to_pylist()]
            keep = [k for k, x in enumerate(held) if len(x) > 1]
            ids = np.zeros((len(keep), length + 1), np.int32)
            for row, k in enumerate(keep):
                ids[row, : len(held[k])] = _IDS[np.frombuffer(held[k], np.uint8)]
            labels = ids[:, 1:]
            lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, length, dtype=np.int32), np.ascontiguousarray(x, np.int32).ravel())
            columns = [batch["seq"].take(pa.array(keep, pa.int64())), lists(ids[:, :-1]), lists(labels), lists(labels != 0)]
            yield pa.RecordBatch.from_arrays(columns, names=WINDOW.names)

    pieces = docs.select("text", "global_start").mapInArrow(cut, "seq long, at long, part binary")
    return pieces.groupBy("seq").agg(F.collect_list(F.struct("at", "part")).alias("parts")).mapInArrow(number, WINDOW)
