"""Tables of vectors as blocks of bounded size, and grids of two sets of blocks.

A stated query set meets all rows block by block: every pair of a row block and a query block is one
group of a cogroup, so no task holds more than two blocks and no side is broadcast. Rows are dealt to
blocks round about, so equal vectors and frequent labels spread evenly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import shared
from lodestone.ship import ship

#: Rows of a block of rows and of a block of queries, and bytes of components that bound both.
ROWS, QUERIES, BYTES = 16_384, 1_024, 16 << 20


def finite(vector: Column) -> Column:
    """Whether a vector is there, has a component, and none that is null, infinite or not a number."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, odd), F.lit(False))


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones get zeros at their ends."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


@dataclass(frozen=True)
class Blocks:
    """Written blocks (block int, payload binary), numbered from 0 to below `count`; a number may have no block."""

    table: DataFrame
    count: int
    dims: int


def blocked(rows: DataFrame, make: Callable[[pa.Table, int], bytes], n_rows: int, dims: int, name: str, per_block: int) -> Blocks:
    """rows dealt evenly to blocks of about per_block rows, fewer where vectors are long, each made into one payload."""
    ship(rows.sparkSession)
    per_block = max(64, min(per_block, BYTES // (4 * max(dims, 1))))
    count = max(1, math.ceil(n_rows / per_block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            number = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([make(pa.Table.from_batches(held), number)], pa.binary())], ["block", "payload"])

    # a block's payload is made once and lies in the shared folder; rows are dealt after a sort of their hashes, alike in each try
    return Blocks(shared.written(rows.repartition(count).mapInArrow(run, "block int, payload binary"), name), count, dims)


def grid(rows: Blocks, queries: Blocks, cell: Callable[[bytes, bytes], pa.Table], schema: str) -> DataFrame:
    """cell of each (row payload, query payload); no cell has more than one of either."""
    empty = pa.schema([pa.field(n, k) for n, k in _kinds(schema)]).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        return cell(left["payload"][0].as_py(), right["payload"][0].as_py())

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.table.select(F.col("block").alias("r"), every(queries.count).alias("q"), "payload")
    right = queries.table.select(every(rows.count).alias("r"), F.col("block").alias("q"), "payload")
    return left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInArrow(run, schema)


def _kinds(schema: str) -> list[tuple[str, pa.DataType]]:
    known = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    return [(n, known[k]) for n, k in (part.split() for part in schema.split(","))]
