"""Shared folder, document blocks and block-to-bucket exchanges.

A *block* is a bounded slice of a table (several rows, or one long row), kept as one
compressed Arrow stream. Blocks are written once to the shared folder, bucketed by block
number, so that every later stage reads them in place and only small messages move:

    blocks --emit--> (bucket, block, message) --answer--> (block, bucket, reply) --gather--> rows

Messages of one bucket hold each key of a block once, so a key that fills a third of the
table reaches its bucket at most once per block. Buckets are ranges or hashes of uniform
64-bit keys and therefore even.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lodestone.ship import ship

if TaskContext.get() is not None:
    # In a worker: Arrow's own pool keeps freed memory for as long as the worker lives, the system's gives it back.
    pa.set_memory_pool(pa.system_memory_pool())

BLOCK_BYTES = 6 << 20
ENVELOPE = "bucket int, block long, message binary"
REPLY = "block long, bucket int, reply binary"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; below the local temp folder where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = os.path.join(tempfile.gettempdir(), "lodestone-shared")
    return f"{base.rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables of written() that nothing will read again."""
    for df in tables:
        deleted(df.sparkSession, df._written_to)


def deleted(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of scratch()."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _sliced(batches: Iterable[pa.RecordBatch], target: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start, used = 0, 0
        weights = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
                weights += pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(weights + 16)
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, used + target - size, side="right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - used
            used, start = int(ends[stop - 1]), stop
            if size >= target or stop < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def dump(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def load(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def pack(df: DataFrame, columns: list[str], name: str, target: int = BLOCK_BYTES) -> DataFrame:
    """The named columns as blocks (block long, payload binary), written once and bucketed by block."""
    spark = ship(df.sparkSession)

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  pa.compute is a module of its own

        first = TaskContext.get().partitionId() << 24
        for n, table in enumerate(_sliced(batches, target)):
            yield pa.RecordBatch.from_arrays([pa.array([first + n], pa.int64()), pa.array([dump(table)], pa.binary())], ["block", "payload"])

    table = f"lodestone_{name}_{uuid.uuid4().hex[:12]}"
    blocks = df.select(*columns).mapInArrow(to_blocks, "block long, payload binary")
    (blocks.write.format("parquet").option("path", scratch(spark, name)).option("compression", "none").bucketBy(partitions(spark), "block").saveAsTable(table))
    return spark.table(table)


def exchange(
    messages: DataFrame, answer: Callable[[list[int], list[bytes]], list[bytes]]
) -> DataFrame:
    """Brings the messages of each bucket together; answer gives one reply for each message.

    answer: (blocks, messages) in ascending block order -> replies in the same order.
    """

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        replies = answer(table["block"].to_pylist(), table["message"].to_pylist())
        return pa.table({"block": table["block"], "bucket": table["bucket"], "reply": pa.array(replies, pa.binary())})

    return messages.groupBy("bucket").applyInArrow(group, REPLY)


def emitted(blocks: DataFrame, emit: Callable[[pa.Table], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Messages (bucket, message) that emit makes of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch["block"].to_pylist(), batch["payload"]):
                yield _envelopes(block, emit(load(payload.as_py())))

    return blocks.mapInArrow(run, ENVELOPE)


def _envelopes(block: int, messages: Iterable[tuple[int, bytes]]) -> pa.RecordBatch:
    found = list(messages)
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in found], pa.int32()), pa.array([block] * len(found), pa.int64()), pa.array([m for _, m in found], pa.binary())],
        ["bucket", "block", "message"],
    )


def gathered(blocks: DataFrame, replies: DataFrame, finish: Callable[[pa.Table, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """Each block with its replies {bucket: reply} -> finish -> rows."""
    empty = pa.RecordBatch.from_arrays([], [])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        given = dict(zip(right["bucket"].to_pylist(), right["reply"].to_pylist())) if right.num_rows else {}
        found = [finish(load(p.as_py()), given) for p in left["payload"]]
        return pa.concat_tables(found) if found else pa.table(empty)

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def reemitted(blocks: DataFrame, replies: DataFrame, emit: Callable[[pa.Table, dict[int, bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """A second round: messages made of each block and its replies."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        given = dict(zip(right["bucket"].to_pylist(), right["reply"].to_pylist())) if right.num_rows else {}
        return pa.concat_tables([pa.Table.from_batches([_envelopes(b, emit(load(p.as_py()), given))]) for b, p in zip(left["block"].to_pylist(), left["payload"])])

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, ENVELOPE)


def squeeze(array: np.ndarray) -> bytes:
    """Bytes of an array as compressed byte planes, for sorted or small numbers."""
    raw = np.ascontiguousarray(array)
    planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, "<u8"), dtype=np.uint64)


def join_parts(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def split_parts(data: bytes) -> list[bytes]:
    at, found = 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        found.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return found


def bucket_slices(values: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Non-empty slices of sorted unsigned 64-bit values that fall into equal ranges."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    cuts = [0, *np.searchsorted(values, edges).tolist(), len(values)]
    for bucket, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            yield bucket, slice(a, b)
