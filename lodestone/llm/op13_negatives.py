"""Hard negatives by a vector-approximation file.

Components become integers, floor(`scale` x). Rows lie in blocks, within a block by label and id. A block
keeps for each dimension up to CELLS cells of about equal numbers of rows with the least and largest integer in
each, and every row's cells, two dimensions to one number; cells come from the block's own rows, so they fit
whatever its values. For an anchor, tables of products with the cells' ends give by look-up a lower and an
upper bound of its inner product with every row, and only rows whose bounds may enter a result are scored exactly:

* positives: an upper bound of at least the k-th largest lower bound among the rows of the anchor's label;
* negatives of a positive: bounds that meet the window of scores, and an upper bound of at least the k-th
  largest lower bound among the rows whose bounds both lie in the window.

Each block gives its best rows for each anchor (and positive); a window ranks those of all blocks.
Anchors meet all rows block by block (`vectors.grid`), once for positives and once for negatives. Labels
don't deal rows out, so a frequent label fills no task.

Sums are 64-bit integers. Where a block's bounds could pass 2^62 or its products 2^53, that block's rows are all
scored with Python's integers, and a score outside 64 bits ends the query with an error.

Defined results: rows with a null id or label take no part, nor vectors that are null, empty or hold a null or
non-finite component (zero vectors do); a shorter vector counts as filled up with zeros; rows with an anchor's
own id are not its candidates; a repeated row is an anchor or candidate again; equal scores by ascending id;
a positive score of zero or less leaves at most negatives of score zero; empty tables give an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import shared, vectors

CELLS = 32
#: Shares of a positive's score between which a negative's lies, in hundredths.
LOW, HIGH = 50, 95
_MAX = (1 << 63) - 1


def usable(rows: DataFrame, id_column: str, vector_column: str, label: Column) -> DataFrame:
    """(id, label, v): the rows that take part."""
    v = rows[vector_column].cast("array<double>")
    return rows.filter(rows[id_column].isNotNull() & label.isNotNull() & vectors.finite(v)).select(rows[id_column].cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))


def _cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: each row's cell in each dimension (dims x rows), and the ends of the cells (dims x CELLS)."""
    n, dims = x.shape
    codes, least, most = np.zeros((dims, n), np.uint16), np.zeros((dims, CELLS)), np.zeros((dims, CELLS))
    for d in range(dims):
        ordered = np.sort(x[:, d])
        edges = np.unique(ordered[np.arange(1, CELLS) * n // CELLS])
        codes[d] = np.searchsorted(edges, x[:, d], "right")
        cuts = np.searchsorted(ordered, edges, "left")
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [n]])
        full = ends > starts
        where = np.flatnonzero(full)
        least[d, where], most[d, where] = ordered[starts[full]], ordered[ends[full] - 1]
    return codes, least, most


def _payload(table: pa.Table, dims: int, scale: float) -> bytes:
    table = table.sort_by([("label", "ascending"), ("id", "ascending")])
    x = np.floor(scale * vectors.matrix(table["v"], dims))
    codes, least, most = _cells(x)
    if dims % 2:
        codes = np.concatenate([codes, np.zeros((1, len(x)), np.uint16)])
    pairs = codes[0::2] * np.uint16(CELLS) + codes[1::2]
    ids, labels = (table[c].to_numpy().astype("<i8").tobytes() for c in ("id", "label"))
    return shared.join_parts(ids, labels, x.astype("<f8").tobytes(), pairs.astype("<u2").tobytes(), least.astype("<f8").tobytes(), most.astype("<f8").tobytes())


def _anchors(table: pa.Table, dims: int, scale: float, number: int) -> bytes:
    x = np.floor(scale * vectors.matrix(table["v"], dims))
    numbers = (np.int64(number) << 32) + np.arange(len(x))
    return shared.join_parts(numbers.astype("<i8").tobytes(), *(table[c].to_numpy().astype("<i8").tobytes() for c in ("id", "label")), x.astype("<f8").tobytes())


class _Block:
    """A block of rows as its payload holds it."""

    def __init__(self, payload: bytes, dims: int) -> None:
        a, b, c, d, e, f = shared.split_parts(payload)
        self.ids, self.labels = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")
        self.x = np.frombuffer(c, "<f8").reshape(-1, dims)
        self.pairs = np.frombuffer(d, "<u2").reshape(-1, len(self.ids)).astype(np.intp)
        self.ends = np.stack([np.frombuffer(y, "<f8").reshape(dims, CELLS) for y in (e, f)])
        self.largest = np.abs(self.ends).max(2, initial=0).max(0)

    def plain(self, anchor: np.ndarray) -> bool:
        """Whether products and sums are exact in doubles."""
        return float(np.abs(anchor) @ self.largest) < 2.0**53

    def bounds(self, anchor: np.ndarray, slices: list[slice]) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the anchor's scores with the rows of the slices."""
        ends = self.ends * anchor[:, None]
        tables = np.stack([ends.min(0), ends.max(0)]).astype(np.int64)
        if tables.shape[1] % 2:
            tables = np.concatenate([tables, np.zeros((2, 1, CELLS), np.int64)], axis=1)
        tables = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(2, -1, CELLS * CELLS)
        sums = [np.zeros(sum(s.stop - s.start for s in slices), np.int64) for _ in range(2)]
        if np.abs(tables).max(2, initial=0).sum(1).max(initial=0) < 1 << 30:  # both bounds in one number, one look-up for both
            tables, sums = ((tables[0] << 32) + tables[1])[None], sums[:1]
        for table, total in zip(tables, sums):
            at = 0
            for s in slices:
                part = total[at : at + s.stop - s.start]
                for j, row in enumerate(self.pairs):
                    part += table[j].take(row[s])
                at += s.stop - s.start
        if len(sums) == 2:
            return sums[0], sums[1]
        upper = (sums[0] & 0xFFFFFFFF).astype(np.uint32).view(np.int32).astype(np.int64)
        return (sums[0] - upper) >> 32, upper

    def exact(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.plain(anchor):
            return (self.x[rows] * anchor).sum(1).astype(np.int64)
        whole = [int(c) for c in anchor]
        return np.array([sum(c * int(y) for c, y in zip(whole, row)) for row in self.x[rows]], object)

    def label_at(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]).tolist())


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> list[int]:
    if score.dtype == object:
        return sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:k]
    return np.lexsort((ids, -score))[:k].tolist()


def _positives(block: bytes, anchors: bytes, dims: int, k: int) -> pa.Table:
    rows = _Block(block, dims)
    a, b, c, d = shared.split_parts(anchors)
    out: list[tuple[int, int, int]] = []
    for number, own, label, x in zip(np.frombuffer(a, "<i8").tolist(), np.frombuffer(b, "<i8").tolist(), np.frombuffer(c, "<i8").tolist(), np.frombuffer(d, "<f8").reshape(-1, dims)):
        s = rows.label_at(label)
        at = np.arange(s.start, s.stop)
        other = rows.ids[s] != own
        if rows.plain(x) and len(at):
            lower, upper = rows.bounds(x, [s])
            known = lower[other]
            other &= upper >= (np.partition(known, len(known) - k)[len(known) - k] if len(known) > k else -_MAX)
        at = at[other]
        score, ids = rows.exact(x, at), rows.ids[at]
        out += [(number, int(ids[i]), int(score[i])) for i in _top(score, ids, k)]
    return _table(("anchor", "positive_id", "score"), out)


def _negatives(block: bytes, anchors: bytes, dims: int, k: int) -> pa.Table:
    rows = _Block(block, dims)
    a, b, c, d, e, f, g = shared.split_parts(anchors)
    n = len(rows.ids)
    bound = np.frombuffer(e, "<i8").tolist()
    positives, scores = np.frombuffer(f, "<i8"), np.frombuffer(g, "<i8").tolist()
    out: list[tuple[int, ...]] = []
    for i, (own, label, x) in enumerate(zip(np.frombuffer(b, "<i8").tolist(), np.frombuffer(c, "<i8").tolist(), np.frombuffer(d, "<f8").reshape(-1, dims))):
        if bound[i] == bound[i + 1]:
            continue
        s = rows.label_at(label)
        slices = [y for y in (slice(0, s.start), slice(s.stop, n)) if y.stop > y.start]
        if not slices:
            continue
        at = np.concatenate([np.arange(y.start, y.stop) for y in slices])
        plain = rows.plain(x)
        lower, upper = rows.bounds(x, slices) if plain else (None, None)
        other = rows.ids[at] != own
        done: dict[int, list[tuple[int, int]]] = {}
        for p in range(bound[i], bound[i + 1]):
            score = scores[p]
            if score not in done:
                low, high = -(-LOW * score // 100), HIGH * score // 100
                maybe = other
                if plain:
                    maybe = other & (upper >= low) & (lower <= high)
                    sure = lower[maybe & (lower >= low) & (upper <= high)]
                    if len(sure) > k:
                        maybe &= upper >= np.partition(sure, len(sure) - k)[len(sure) - k]
                found = at[maybe]
                exact = rows.exact(x, found)
                inside = (exact >= low) & (exact <= high)
                exact, ids = exact[inside], rows.ids[found[inside]]
                done[score] = [(int(ids[j]), int(exact[j])) for j in _top(exact, ids, k)]
            out += [(i, p, negative, value) for negative, value in done[score]]
    numbers, owns = np.frombuffer(a, "<i8").tolist(), np.frombuffer(b, "<i8").tolist()
    names = ("anchor", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
    return _table(names, [(numbers[i], p - bound[i], owns[i], int(positives[p]), scores[p], negative, value) for i, p, negative, value in out])


def _table(names: tuple[str, ...], rows: list[tuple]) -> pa.Table:
    return pa.table({name: pa.array([r[j] for r in rows], pa.int64()) for j, name in enumerate(names)})


def mine(rows: DataFrame, anchors: Column, label: Column, id_column: str = "vec_id", vector_column: str = "embedding", positives: int = 5, negatives: int = 3, scale: float = 256.0, per_block: int = vectors.ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that the predicate `anchors` marks; label: a column of rows."""
    asked = usable(rows.filter(anchors), id_column, vector_column, label)
    rows = usable(rows, id_column, vector_column, label)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    dims = size.dims or 1
    index = vectors.blocked(rows, lambda t, _: _payload(t, dims, scale), size.n, dims, "cells", per_block)
    wanted = vectors.blocked(asked, lambda t, number: _anchors(t, dims, scale, number), asked.count(), dims, "anchors", vectors.QUERIES)
    near = vectors.grid(index, wanted, lambda a, b: _positives(a, b, dims, positives), "anchor long, positive_id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
        a, b, c, d = shared.split_parts(left["payload"][0].as_py())
        right = right.sort_by([("anchor", "ascending"), ("place", "ascending")]) if right.num_rows else right
        of, ids, scores = (right[n].to_numpy().astype("<i8") if right.num_rows else np.zeros(0, "<i8") for n in ("anchor", "positive_id", "score"))
        numbers = np.frombuffer(a, "<i8")
        bound = np.append(np.searchsorted(of, numbers), len(of)).astype("<i8")
        return pa.table({"block": left["block"], "payload": pa.array([shared.join_parts(a, b, c, d, bound.tobytes(), ids.tobytes(), scores.tobytes())], pa.binary())})

    # a block of anchors with its positives, at most `positives` an anchor
    near = near.withColumn("block", F.shiftright("anchor", 32).cast("int"))
    with_positives = wanted.table.groupBy("block").cogroup(near.groupBy("block")).applyInArrow(joined, "block int, payload binary")
    with_positives = vectors.Blocks(shared.written(with_positives, "positives"), wanted.count, dims)
    schema = "anchor long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = vectors.grid(index, with_positives, lambda a, b: _negatives(a, b, dims, negatives), schema)
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")).alias("rank")
    return found.select("anchor_id", "positive_id", rank, "negative_id", "positive_score", "negative_score").filter(F.col("rank") <= negatives)


def brute_force(rows: list[tuple[int | None, list | None, int | None]], asked, positives: int = 5, negatives: int = 3, scale: int = 256) -> list[tuple[int, int, int, int, int, int]]:
    """All results, row by row; ids must differ."""
    good = [(i, [int(np.floor(scale * float(x))) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and None not in v and np.isfinite(v).all()]
    out = []
    for i, v, y in good:
        if not asked(i):
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in good if j != i), key=lambda s: (-s[0], s[1]))
        for score, j, _ in [s for s in scored if s[2] == y][:positives]:
            fit = [s for s in scored if s[2] != y and LOW * score <= 100 * s[0] <= HIGH * score][:negatives]
            out += [(i, j, r, n, score, s) for r, (s, n, _) in enumerate(fit, 1)]
    return out
