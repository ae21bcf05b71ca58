"""An inverted index of vectors: k-means cells with product-quantised residuals, one folder of files for each cell.

`build` writes every row with its cell, the codes of its residual (its unit vector less the cell's centre) and
the length of what the codes leave out. Centres and codes are fitted on a bounded sample of rows, those with the
least hashes of their ids; every row is indexed. A search opens few cells for each query, estimates distances from tables of
codes, and scores the best estimates exactly. Since an estimate is off by at most the row's stored error, the exact
searches (`probes=None`, and `within`) lose nothing: they drop only rows whose lower bound is out of reach.

A cell is cut into parts of at most about PART rows by hashes of ids when it is searched, so a cell of many alike
vectors is several groups; queries meet a cell's parts in blocks. What the driver holds is bounded by the number of
cells: their centres, sizes and radii.

Distances are 1 - cosine in doubles; a zero vector is at distance 1 from everything. Rows whose vector is null, of
another length than the index's, or with a component that is null or not finite are not indexed (for queries: not answered).
Equal distances rank by ascending id. An empty table gives an index that finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.cut import folder
from lodestone.ship import ship

#: Rows of a part of a cell, queries of a block, rows that centres and codes are fitted on.
PART, QUERIES, SAMPLE = 16_384, 2_048, 20_000
CODES = 256
#: What sums of rounded doubles may be off, for bounds that must not lose a row.
SLACK = 1e-6


def usable(vector: Column) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, odd), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(length > 0, length, 1.0)


def _means(x: np.ndarray, count: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of at most count clusters: Lloyd's rounds from distinct rows; a centre without rows stays."""
    seeds = np.unique(x, axis=0)
    centres = seeds[rng.permutation(len(seeds))[:count]]
    for _ in range(rounds):
        of = _closest(x, centres)
        size = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(1)
    return np.concatenate([np.zeros(0, np.intp), *[(half - x[a : a + 4096] @ centres.T).argmin(1) for a in range(0, len(x), 4096)]])


@dataclass(frozen=True)
class Codebook:
    """Centres of cells, and for each slice of the components the centres of residuals there."""

    centres: np.ndarray
    slices: list[slice]
    books: list[np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, error) of unit vectors."""
        cell = _closest(x, self.centres)
        rest = x - self.centres[cell]
        codes = np.stack([_closest(rest[:, s], b) for s, b in zip(self.slices, self.books)], axis=1)
        off = rest - np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)
        return cell, codes.astype(np.uint8), np.sqrt((off * off).sum(1))

    def estimates(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances (of points) between a unit query and the decoded rows of a cell."""
        rest = q - self.centres[cell]
        total = np.zeros(len(codes))
        for j, (s, b) in enumerate(zip(self.slices, self.books)):
            off = b - rest[s]
            total += (off * off).sum(1)[codes[:, j]]
        return np.sqrt(total)


def fit(vectors: np.ndarray, cells: int, slices: int, rounds: int = 8, seed: int = 7) -> Codebook:
    rng = np.random.default_rng(seed)
    x = _unit(vectors)
    centres = _means(x, cells, rounds, rng)
    rest = x - centres[_closest(x, centres)]
    cuts = [slice(int(p[0]), int(p[-1]) + 1) for p in np.array_split(np.arange(x.shape[1]), min(slices, x.shape[1]))]
    return Codebook(centres, cuts, [_means(rest[:, s], CODES, rounds, rng) for s in cuts])


@dataclass(frozen=True)
class VectorIndex:
    """id, further columns, cell, codes, error and vector of every row, below `path` in a folder a cell."""

    table: DataFrame
    path: str
    id_column: str
    book: Codebook | None
    sizes: dict[int, int] = field(default_factory=dict)
    #: The largest distance of a cell's rows from its centre.
    radii: dict[int, float] = field(default_factory=dict)

    def parts(self, cell: int) -> int:
        return max(1, math.ceil(self.sizes.get(cell, 0) / PART))


def build(rows: DataFrame, id_column: str, vector_column: str, path: str | None = None, cells: int = 64, slices: int = 16, sample: int = SAMPLE) -> VectorIndex:
    """Indexes rows; columns other than the vector are carried for predicates. cells: about the square root of the rows, at most some thousands."""
    spark = ship(rows.sparkSession)
    path = path or folder(spark, "vectors")
    rest = [c for c in rows.columns if c not in (id_column, vector_column)]
    kept = rows.filter(F.col(id_column).isNotNull() & usable(F.col(vector_column))).select(id_column, *rest, F.col(vector_column).cast("array<double>").alias("__v"))
    dims = kept.groupBy(F.size("__v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if dims is None:
        empty = kept.select(id_column, *rest, F.lit(0).alias("cell"), F.lit(b"").alias("codes"), F.lit(0.0).alias("error"), "__v")
        return VectorIndex(empty, path, id_column, None)
    kept = kept.filter(F.size("__v") == dims.n)
    # the least hashes: the same rows whatever the partitions
    chosen = kept.select(F.xxhash64(F.col(id_column).cast("string")).alias("h"), "__v").orderBy("h", "__v").limit(sample).toPandas()
    book = fit(np.array(chosen["__v"].tolist()), cells, slices)

    @F.pandas_udf("struct<cell int, codes binary, error double, away double>")
    def placed(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"cell": [], "codes": [], "error": [], "away": []})
        x = _unit(np.array(vectors.tolist()))
        cell, codes, error = book.encode(x)
        off = x - book.centres[cell]
        return pd.DataFrame({"cell": cell.astype(np.int32), "codes": [c.tobytes() for c in codes], "error": error, "away": np.sqrt((off * off).sum(1))})

    found = kept.withColumn("__p", placed("__v")).select(id_column, *rest, F.col("__p.cell").alias("cell"), F.col("__p.codes").alias("codes"), F.col("__p.error").alias("error"), F.col("__p.away").alias("away"), "__v")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # by ranges of cell and hash: a large cell is written by several tasks
    found.repartitionByRange(n, "cell", F.xxhash64(F.col(id_column).cast("string"))).write.mode("overwrite").partitionBy("cell").parquet(path)
    # the cell is the folder's name; its type is stated, not inferred
    table = spark.read.schema(found.schema).parquet(path)
    stats = table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect()  # a row a cell
    return VectorIndex(table.select(id_column, *rest, "cell", "codes", "error", "__v"), path, id_column, book, {r.cell: r.n for r in stats}, {r.cell: r.away for r in stats})


def _grouped(index: VectorIndex, queries: DataFrame, open_cells: Callable[[np.ndarray], list[list[int]]], answer: Callable, where: Column | None) -> DataFrame:
    """answer(cell, ids, codes, error, vectors, query ids, query vectors) -> (query place, row place, distance), for each block of queries at each part of a cell."""
    spark = index.table.sparkSession
    ship(spark)
    ids, qids = index.table.schema[index.id_column].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    n_parts = {c: index.parts(c) for c in index.sizes}
    dims = index.book.centres.shape[1]
    asked = queries.filter(F.col("query_id").isNotNull() & usable(F.col("vector"))).filter(F.size("vector") == dims).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    blocks = max(1, math.ceil(asked.count() / QUERIES))

    @F.pandas_udf("array<struct<cell int, part int>>")
    def opened(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        found = open_cells(np.array(vectors.tolist()))
        return pd.Series([[(c, p) for c in cells for p in range(n_parts[c])] for cells in found])

    right = asked.withColumn("block", F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(blocks)).cast("int")).select("query_id", "vector", "block", F.inline(opened("vector")))
    rows = index.table if where is None else index.table.filter(where)
    sizes = F.create_map(*[F.lit(x) for c, p in n_parts.items() for x in (c, p)])
    part = F.pmod(F.xxhash64(F.col(index.id_column).cast("string")), sizes[F.col("cell")]).cast("int")
    left = rows.select(F.col(index.id_column).alias("id"), F.col("cell").alias("c"), "codes", "error", F.col("__v").alias("v"), part.alias("p"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    kinds = {"id": left.schema["id"].dataType, "q": right.schema["query_id"].dataType}
    from pyspark.sql.pandas.types import to_arrow_type

    empty = pa.schema([("query_id", to_arrow_type(kinds["q"])), ("id", to_arrow_type(kinds["id"])), ("distance", pa.float64())]).empty_table()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return empty
        v, q = (_matrix(t, dims) for t in (a["v"], b["vector"]))
        codes = np.frombuffer(b"".join(a["codes"].to_pylist()), np.uint8).reshape(a.num_rows, -1)
        order = np.asarray(pa.compute.rank(a["id"].combine_chunks(), tiebreaker="first")).astype(np.int64)
        query, row, distance = answer(a["c"][0].as_py(), order, codes, a["error"].to_numpy(), v, q)
        return pa.table({"query_id": b["query_id"].take(pa.array(query)), "id": a["id"].take(pa.array(row)), "distance": pa.array(distance, pa.float64())})

    import pyarrow.compute  # noqa: F401  pa.compute is a module of its own

    return left.groupBy("c", "p", "b").cogroup(right.groupBy("cell", "part", "block")).applyInArrow(run, f"query_id {qids}, id {ids}, distance double")


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(-1, dims)


def _exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    norms = np.sqrt((v * v).sum(1)) * np.sqrt((q * q).sum())
    return np.where(norms > 0, 1 - (v * q).sum(1) / np.where(norms > 0, norms, 1.0), 1.0)


def _collected(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = list(found)
    query = np.repeat(np.arange(len(parts)), [len(r) for r, _ in parts])
    return query, np.concatenate([np.zeros(0, np.int64), *[r for r, _ in parts]]).astype(np.int64), np.concatenate([np.zeros(0), *[d for _, d in parts]])


def search(index: VectorIndex, queries: DataFrame, k: int = 15, probes: int | None = 8, where: Column | None = None, refine: int = 8) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of each query (query_id, vector) that meet `where`.

    probes: how many cells a query opens, nearest first; None opens all and is exact. refine: in each part, so many
    times k of the best estimates are scored exactly.
    """
    if index.book is None:
        return queries.select("query_id", F.lit(1).alias("rank"), F.lit(None).cast(index.table.schema[index.id_column].dataType).alias("id"), F.lit(0.0).alias("distance")).limit(0)
    book, known = index.book, np.array(sorted(index.sizes))

    def open_cells(q: np.ndarray) -> list[list[int]]:
        if probes is None:
            return [known.tolist()] * len(q)
        away = ((_unit(q)[:, None, :] - book.centres[known]) ** 2).sum(2)
        return known[np.argsort(away, axis=1, kind="stable")[:, :probes]].tolist()

    def answer(cell, order, codes, error, v, q):
        unit = _unit(q)
        zero = ~(v != 0).any(1)

        def one(i: int) -> tuple[np.ndarray, np.ndarray]:
            guess = book.estimates(unit[i], cell, codes)
            if probes is None:
                # a zero row or query has its distance by rule, not by place
                guess = np.where(zero | ~(q[i] != 0).any(), math.sqrt(2), guess)
                off = np.where(zero, 0.0, error) + SLACK
                upper = guess + off
                reach = np.partition(upper, k - 1)[k - 1] if len(upper) > k else np.inf
                at = np.flatnonzero(guess - off <= reach)
            else:
                n = k * refine
                at = np.argpartition(guess, n - 1)[:n] if len(guess) > n else np.arange(len(guess))
            d = _exact(v[at], q[i])
            best = np.lexsort((order[at], d))[:k]
            return at[best], d[best]

        return _collected(one(i) for i in range(len(q)))

    found = _grouped(index, queries, open_cells, answer, where)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")).alias("rank")
    return found.select("query_id", rank, "id", "distance").filter(F.col("rank") <= k)


def within(index: VectorIndex, queries: DataFrame, cutoff: float, where: Column | None = None) -> DataFrame:
    """(query_id, id, distance): every row at a distance of at most cutoff from each query, none lost.

    A query opens the cells whose rows may lie so near: those whose centre is no further than the reach of the cutoff plus the cell's radius.
    """
    if index.book is None:
        return queries.select("query_id", F.lit(None).cast(index.table.schema[index.id_column].dataType).alias("id"), F.lit(0.0).alias("distance")).limit(0)
    book, known = index.book, np.array(sorted(index.sizes))
    radius, reach = np.array([index.radii[c] for c in known.tolist()]), math.sqrt(max(0.0, 2 * cutoff)) + SLACK

    def open_cells(q: np.ndarray) -> list[list[int]]:
        if cutoff >= 1:  # zero vectors, at distance 1, may be anywhere
            return [known.tolist()] * len(q)
        away = np.sqrt(((_unit(q)[:, None, :] - book.centres[known]) ** 2).sum(2))
        return [known[row].tolist() for row in away <= radius + reach]

    def answer(cell, order, codes, error, v, q):
        unit = _unit(q)

        def one(i: int) -> tuple[np.ndarray, np.ndarray]:
            at = np.arange(len(v)) if cutoff >= 1 else np.flatnonzero(book.estimates(unit[i], cell, codes) - error <= reach + SLACK)
            d = _exact(v[at], q[i])
            return at[d <= cutoff + 1e-12], d[d <= cutoff + 1e-12]

        return _collected(one(i) for i in range(len(q)))

    return _grouped(index, queries, open_cells, answer, where)


def upserted(index: VectorIndex, rows: DataFrame, vector_column: str, path: str) -> VectorIndex:
    """The index with rows replaced or added by id, under another path with the same centres; rows (id, further columns, vector)."""
    rest = [c for c in index.table.columns if c not in (index.id_column, "cell", "codes", "error", "__v")]
    old = index.table.join(rows.select(index.id_column), index.id_column, "left_anti").select(index.id_column, *rest, F.col("__v").alias(vector_column))
    return build(old.unionByName(rows.select(index.id_column, *rest, vector_column)), index.id_column, vector_column, path, len(index.book.centres) if index.book else 64, len(index.book.slices) if index.book else 16)


def embedded(rows: DataFrame, text_column: str, embed: Callable[[list[str]], list[list[float]]], name: str = "vector") -> DataFrame:
    """rows with the model's vector of a text, batch by batch; a null text counts as empty."""
    ship(rows.sparkSession)

    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(c) for c in v] for v in embed(texts.fillna("").tolist())], index=texts.index, dtype=object)

    return rows.withColumn(name, vector(text_column))


def fresh(chunks: DataFrame, skip: DataFrame | None = None, prefix: int = 100) -> DataFrame:
    """Chunks (chunk_id, video_id, chunk_index, cleaned_text) to embed: without those of `skip` (chunk_id), and of a video's chunks that begin with the same `prefix` characters the first."""
    left = chunks if skip is None else chunks.join(skip.select("chunk_id"), "chunk_id", "left_anti")
    w = Window.partitionBy("video_id", F.substring("cleaned_text", 1, prefix)).orderBy("chunk_index", "chunk_id")
    return left.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")

