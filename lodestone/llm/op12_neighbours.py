"""Approximate nearest neighbours by collision counting.

Largest inner products become least distances: with M the largest length of a row, a row x gets one more
component sqrt(M^2 - |x|^2) and a query q is scaled to length M, so that their squared distance is
2 M^2 - 2 M (q x) / |q|. The index is blocks of rows; each holds, for every one of `projections` single
projections (columns of random rotations), its rows' sorted projected values and their order. A query opens
in each sorted array a window centred on itself; virtual rehashing widens all windows by GROWTH at a time, and
only what a widening adds is counted. A row that lies in a share THRESHOLD of the windows is verified by its
inner product. A query ends in a block once k verified rows lie within the radius that the windows stand for,
or a share BUDGET of the block and k more are verified, or the windows hold the block.

Nothing is fitted but M (over all rows); every row is indexed, nothing is sampled. Windows see a true
neighbour at the radius with a probability over the threshold each, so that counting misses few: recall at 20
is measured against brute force in the tests and stated in the README.

Defined results: rows whose id is null take no part, nor do vectors that are null, empty, all zero or hold a
null or non-finite component; a shorter vector counts as filled up with zeros; rows with the query's own id are not its
candidates; a repeated query row is answered again, a repeated candidate is a candidate again; equal scores
by ascending id; empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import shared, vectors

PROJECTIONS, THRESHOLD, BUDGET = 64, 0.7, 0.25
#: Half the width of the first windows as a share of M, and the factor between widths.
FIRST, GROWTH = 0.2, 1.6
#: The windows' half width over the radius they stand for: at the radius a projection collides with probability 0.73.
WIDTH = 1.1
FOUND = "query long, query_id long, vec_id long, score double"


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): the rows that take part."""
    v = rows[vector_column].cast("array<double>")
    return rows.filter(rows[id_column].isNotNull() & vectors.finite(v) & F.exists(v, lambda x: x != 0)).select(rows[id_column].cast("long").alias("id"), v.alias("v"))


def rotations(dims: int, count: int, seed: int = 11) -> np.ndarray:
    """dims x count: columns of random rotations, scaled so that a projected difference varies by its length."""
    rng = np.random.default_rng(seed)
    parts = [np.linalg.qr(rng.normal(size=(dims, min(dims, count - at))))[0] for at in range(0, count, dims)]
    return np.concatenate(parts, axis=1) * np.sqrt(dims)


def _payload(table: pa.Table, dims: int, longest: float, axes: np.ndarray) -> bytes:
    x = vectors.matrix(table["v"], dims)
    scaled = x / longest
    rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(1)))
    values = (np.column_stack([scaled, rest]) @ axes).T
    order = np.argsort(values, axis=1, kind="stable")
    return shared.join_parts(table["id"].to_numpy().astype("<i8").tobytes(), x.tobytes(), np.take_along_axis(values, order, 1).astype("<f4").tobytes(), order.astype("<i4").tobytes())


def _query_payload(table: pa.Table, dims: int, number: int) -> bytes:
    n = table.num_rows
    return shared.join_parts(((np.int64(number) << 32) + np.arange(n)).astype("<i8").tobytes(), table["id"].to_numpy().astype("<i8").tobytes(), vectors.matrix(table["v"], dims).tobytes())


def neighbours(rows: DataFrame, queries: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", projections: int = PROJECTIONS, per_block: int = vectors.ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each row that the predicate `queries` marks."""
    asked = usable(rows.filter(queries), id_column, vector_column)
    rows = usable(rows, id_column, vector_column)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"), F.max(length).alias("longest")).first()
    dims, longest = size.dims or 1, size.longest or 1.0
    axes = rotations(dims + 1, projections)
    index = vectors.blocked(rows, lambda t, _: _payload(t, dims, longest, axes), size.n, dims, "vectors", per_block)
    wanted = vectors.blocked(asked, lambda t, number: _query_payload(t, dims, number), asked.count(), dims, "queries", vectors.QUERIES)
    found = vectors.grid(index, wanted, lambda a, b: _search(a, b, dims, longest, axes, k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").filter(F.col("rank") <= k)


def _search(block: bytes, queries: bytes, dims: int, longest: float, axes: np.ndarray, k: int) -> pa.Table:
    a, b, c, d = shared.split_parts(block)
    ids, x = np.frombuffer(a, "<i8"), np.frombuffer(b, "<f8").reshape(-1, dims)
    n = len(ids)
    values, order = np.frombuffer(c, "<f4").reshape(-1, n), np.frombuffer(d, "<i4").reshape(-1, n).astype(np.intp)
    a, b, c = shared.split_parts(queries)
    numbers, own, q = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8"), np.frombuffer(c, "<f8").reshape(-1, dims)
    lengths = np.sqrt((q * q).sum(1))
    centres = np.ascontiguousarray(((q / lengths[:, None]) @ axes[:dims]).T)
    m, least = len(values), int(np.ceil(THRESHOLD * len(values)))
    counts = np.zeros((len(q), n), np.uint16)
    verified = np.zeros((len(q), n), bool)
    best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in q]
    low = high = np.stack([np.searchsorted(values[j], centres[j]) for j in range(m)])
    active, half = np.arange(len(q)), FIRST
    while len(active):
        to_low = np.stack([np.searchsorted(values[j], centres[j, active] - half, "left") for j in range(m)])
        to_high = np.stack([np.searchsorted(values[j], centres[j, active] + half, "right") for j in range(m)])
        whole = (to_low == 0).all(0) & (to_high == n).all(0)
        going = np.ones(len(active), bool)
        for at, i in enumerate(active):
            added = [order[j, s:e] for j, (s, e) in enumerate(zip(to_low[:, at].tolist(), low[:, at].tolist())) if e > s]
            added += [order[j, s:e] for j, (s, e) in enumerate(zip(high[:, at].tolist(), to_high[:, at].tolist())) if e > s]
            if added:
                counts[i] += np.bincount(np.concatenate(added), minlength=n).astype(np.uint16)
            new = np.flatnonzero((counts[i] >= least) & ~verified[i])
            verified[i, new] = True
            new = new[ids[new] != own[i]]
            score, near = np.concatenate([best[i][0], (x[new] * q[i]).sum(1)]), np.concatenate([best[i][1], ids[new]])
            top = np.lexsort((near, -score))[:k]
            best[i] = score[top], near[top]
            within = len(top) == k and 2 - 2 * score[top[-1]] / (lengths[i] * longest) <= (half / WIDTH) ** 2
            going[at] = not (whole[at] or within or len(top) == k and np.count_nonzero(verified[i]) >= BUDGET * n + k)
        low, high, active, half = to_low[:, going], to_high[:, going], active[going], half * GROWTH
    sizes = [len(s) for s, _ in best]
    return pa.table({"query": np.repeat(numbers, sizes), "query_id": np.repeat(own, sizes), "vec_id": np.concatenate([i for _, i in best]), "score": np.concatenate([s for s, _ in best])})


def brute_force(rows: list[tuple[int | None, list | None]], asked, k: int = 20) -> dict[int, list[tuple[int, float]]]:
    """The k nearest of each row whose id asked() accepts; ids must differ."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    dims = max((len(v) for _, v in good), default=1)
    good = [(i, np.pad(v, (0, dims - len(v)))) for i, v in good]
    return {i: sorted(((j, float((w * v).sum())) for j, w in good if j != i), key=lambda p: (-p[1], p[0]))[:k] for i, v in good if asked(i)}
