"""Operators 11 to 13 against brute force, with odd rows."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import op11_search, op12_neighbours, op13_negatives, queries, vectors

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture
def blocks_of(spark):
    """Sets how many rows a batch of Arrow holds, that is how many documents a block of postings has."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, before)


@pytest.mark.parametrize("rows", [2, 1000])
def test_search(spark, blocks_of, rows):
    blocks_of(rows)
    rng = random.Random(rows)
    words = [f"w{i}" for i in range(30)] + ["É", "straße", "W1", "the", "\U0001f600"]
    texts = [None, "", "?!", "the", "THE the", "the " * 5000, "x\x00y \x7f é", "É é"] + [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(60)]
    docs = [(i * 7 % 101, t) for i, t in enumerate(texts)] + [(None, "the w1 w2"), (3, texts[20]), (3, texts[20])]
    items = [" ".join(rng.choices(words, k=8)) for _ in range(6)] + [None, "", "unknown", "the", "THE É x", "the"]
    frame = spark.createDataFrame([(t, i, "a", 1, 2) for i, t in docs], "text string, doc_id long, term string, block int, id int").repartition(3)
    asked = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, item int")
    index = op11_search.build(frame)
    for per_block in (3, 256):
        got: dict[int, list] = {}
        for r in op11_search.search(index, asked, k=10, per_block=per_block).orderBy("item_id", "rank").collect():
            got.setdefault(r.item_id, []).append((r.doc_id, r.score))
            assert r.rank == len(got[r.item_id])
        for i, want in enumerate(op11_search.brute_force(docs, items, k=10)):
            assert got.get(i, []) == want, items[i]
    assert op11_search.search(index, asked.limit(0)).count() == 0
    table = index.table
    index.drop()
    assert not spark.catalog.tableExists(table)
    empty = op11_search.build(frame.limit(0))
    assert empty.n_docs == 0 and op11_search.search(empty, asked).count() == 0


def test_search_repeated_items(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a b"), ("x", "a b"), (None, "c")], "item_id string, text string")
    got = sorted(op11_search.search(op11_search.build(docs), items).select("item_id", "rank", "doc_id").collect(), key=repr)
    assert [tuple(r) for r in got] == [("x", 1, 1), ("x", 1, 1), ("x", 2, 2), ("x", 2, 2), (None, 1, 3), (None, 2, 2)]


ODD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 16, 1), (9004, [1.0] * 15 + [float("nan")], 1), (9005, [float("inf")] * 16, 1), (9006, [1.0, None] * 8, 1), (None, [1.0] * 16, 1), (9020, [1.0, 2.0], 1), (9040, [0.5] * 16, None)]


def sample(n, dims=16, seed=5):
    """Random unit vectors with groups of near and exact copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x[n // 3 : n // 2] = x[0] + 0.01 * rng.normal(size=(n // 2 - n // 3, dims))
    x[n // 2 : n // 2 + 40] = x[1]
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, [float(c) for c in v], int(i % 3 * (i % 5 > 0))) for i, v in enumerate(x.astype(np.float32))]


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 0) for i, v, y in rows], "vec_id long, embedding array<double>, label int, block string, v int")


@pytest.mark.parametrize("per_block", [64, 5000])
def test_neighbours(spark, per_block):
    rows = sample(1500) + ODD
    got: dict[int, list] = {}
    for r in op12_neighbours.neighbours(frame_of(spark, rows), F.col("vec_id") % 20 == 0, k=20, per_block=per_block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = op12_neighbours.brute_force([(i, v) for i, v, _ in rows], lambda i: i % 20 == 0)
    assert set(got) == set(want)
    exact = {(i, j): s for i, found in op12_neighbours.brute_force([(i, v) for i, v, _ in rows], lambda i: i % 20 == 0, k=10**6).items() for j, s in found}
    assert all(abs(s - exact[i, j]) < 1e-12 for i, found in got.items() for j, s in found)
    assert all(found == sorted(found, key=lambda p: (-p[1], p[0])) and len(found) == 20 for found in got.values())
    # equal vectors tie, so a hit is a score as good as the true one of its rank
    assert sum(a[1] >= b[1] - 1e-12 for i in want for a, b in zip(got[i], want[i])) >= 0.9 * sum(map(len, want.values()))


def test_neighbours_of_few(spark):
    rows = [(i, [float(i + 1), 1.0], 0) for i in range(5)] + [(0, [3.0, 3.0], 0)]
    got = [tuple(r) for r in op12_neighbours.neighbours(frame_of(spark, rows), F.col("vec_id") == 0).orderBy("query_id", "score").collect()]
    assert len(got) == 8 and {r[0] for r in got} == {0} and {r[2] for r in got} == {1, 2, 3, 4}
    empty = op12_neighbours.neighbours(frame_of(spark, rows).limit(0), F.col("vec_id") == 0)
    assert empty.columns == ["query_id", "rank", "vec_id", "score"] and empty.count() == 0
    assert op12_neighbours.neighbours(frame_of(spark, rows), F.col("vec_id") == 77).count() == 0


@needs_tables
def test_recall(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in queries.table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    want = op12_neighbours.brute_force(rows, lambda i: i % 20 == 0)
    found = {(r.query_id, r.vec_id) for r in queries.op12_neighbours(spark, "/root/testdata/sf0.1").collect()}
    assert sum((i, j) in found for i, near in want.items() for j, _ in near) >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("per_block", [64, 5000])
@pytest.mark.parametrize("dims,scale", [(16, 256), (5, 256), (16, 1 << 22), (3, 1 << 29)])
def test_negatives(spark, monkeypatch, per_block, dims, scale):
    monkeypatch.setattr(vectors, "QUERIES", 64)
    rows = sample(700, dims) + [(i, v and v[:dims], y) for i, v, y in ODD]
    rows = [(i, v, (y + 1) % 10 if i and i % 7 == 0 and y is not None else y) for i, v, y in rows]
    got = op13_negatives.mine(frame_of(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"), scale=float(scale), per_block=per_block)
    assert sorted(tuple(r) for r in got.collect()) == sorted(op13_negatives.brute_force(rows, lambda i: i % 10 == 0, scale=scale))


def test_negatives_of_few(spark):
    rows = [(0, [1.0], 1), (1, [0.0], 1), (2, [0.0], 2), (3, [-1.0], 1), (4, [0.9], 1), (5, [0.5], 2), (6, [0.5], 2)]
    got = op13_negatives.mine(frame_of(spark, rows), F.col("vec_id") == 0, F.col("label"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(op13_negatives.brute_force(rows, lambda i: i == 0))
    assert op13_negatives.mine(frame_of(spark, rows).limit(0), F.col("vec_id") == 0, F.col("label")).count() == 0


@needs_tables
@pytest.mark.parametrize("name", ["op11_search", "op13_negatives"])
def test_sql(spark, name):
    from compare import connection, same

    same(queries.QUERIES[name](spark, SF), connection(SF), queries.SQL[name])
