"""The vector index against exact distances, and corroboration against the claim-by-claim loop."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import bag_embedder
from lodestone.operators import corroboration as C
from lodestone.plans import vector_index as V

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, lang string, embedding array<double>")


def vectors(n, dims=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x[n // 4 : n // 2] = x[0] + 0.05 * rng.normal(size=(n // 2 - n // 4, dims))
    x[n // 2 : n // 2 + 30] = x[1] * 3
    x[7] = 0
    return [(f"c{i}", "en" if i % 3 else "fr", v.tolist()) for i, v in enumerate(x)]


def exact(rows, q, keep=lambda r: True):
    def distance(v):
        norm = np.linalg.norm(v) * np.linalg.norm(q)
        return round(1 - float(np.dot(v, q)) / norm, 9) if norm else 1.0

    return sorted((distance(r[2]), r[0]) for r in rows if keep(r))


@pytest.mark.parametrize("part", [20, 16_384])
def test_exact(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(V, "PART", part)
    monkeypatch.setattr(V, "QUERIES", 10)
    rows = vectors(400)
    odd = [("x", "en", None), ("y", "en", []), ("z", "en", [1.0, 2.0]), (None, "en", [1.0] * 12), ("n", "en", [float("nan")] * 12)]
    index = V.build(frame(spark, rows + odd), "chunk_id", "embedding", str(tmp_path / "i"), cells=9, slices=5)
    assert index.table.count() == len(rows) == sum(index.sizes.values())
    asked = [(r[0], r[2]) for r in rows[::23] + rows[7:8]]
    queries = spark.createDataFrame(asked + [("bad", [1.0]), ("none", None)], "query_id string, vector array<double>")
    got: dict = {}
    for r in V.search(index, queries, k=6, probes=None).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(r.distance, 9), r.id))
    near = {}
    for r in V.within(index, queries, 0.3).collect():
        near.setdefault(r.query_id, set()).add(r.id)
    for name, v in asked:
        want = exact(rows, np.array(v))
        # copies tie up to rounding; the rest is in order
        assert [d for d, _ in got[name]] == pytest.approx([d for d, _ in want[:6]], abs=1e-8)
        assert {i for d, i in want if d < want[5][0] - 1e-7} <= {i for _, i in got[name]}
        assert near.get(name, set()) == {i for d, i in want if d <= 0.3}
    french = V.search(index, queries, k=500, probes=None, where=F.col("lang") == "fr").groupBy("query_id").count().collect()
    assert {r["count"] for r in french} == {sum(r[1] == "fr" for r in rows)}


def test_probes_and_upsert(spark, tmp_path):
    rows = vectors(600)
    index = V.build(frame(spark, rows), "chunk_id", "embedding", str(tmp_path / "i"), cells=16, slices=6)
    queries = spark.createDataFrame([(r[0], r[2]) for r in rows[:200:5]], "query_id string, vector array<double>")
    found = {(r.query_id, r.id) for r in V.search(index, queries, k=5, probes=6).collect()}
    true = {(r.query_id, r.id) for r in V.search(index, queries, k=5, probes=None).collect()}
    assert len(found & true) >= 0.9 * len(true)
    new = frame(spark, [("c5", "de", rows[9][2]), ("new", "de", rows[9][2])])
    after = V.upserted(index, new, "embedding", str(tmp_path / "j"))
    assert after.table.count() == 601
    hit = V.search(after, spark.createDataFrame([("q", rows[9][2])], "query_id string, vector array<double>"), k=3, probes=None).collect()
    assert {r.id for r in hit} == {"c5", "c9", "new"}
    assert {r.chunk_id for r in after.table.filter("lang = 'de'").collect()} == {"c5", "new"}


def test_empty(spark, tmp_path):
    index = V.build(frame(spark, []), "chunk_id", "embedding", str(tmp_path / "i"))
    queries = spark.createDataFrame([("q", [1.0])], "query_id string, vector array<double>")
    assert V.search(index, queries).count() == 0 and V.within(index, queries, 0.5).count() == 0


def test_fresh(spark):
    rows = [("a", "v", 0, "x" * 120), ("b", "v", 1, "x" * 110), ("c", "v", 2, "y"), ("d", "w", 0, "x" * 120)]
    chunks = spark.createDataFrame(rows, "chunk_id string, video_id string, chunk_index int, cleaned_text string")
    assert {r.chunk_id for r in V.fresh(chunks).collect()} == {"a", "c", "d"}
    skip = spark.createDataFrame([("a",)], "chunk_id string")
    assert {r.chunk_id for r in V.fresh(chunks, skip).collect()} == {"b", "c", "d"}


@pytest.mark.parametrize("seed", range(3))
def test_corroboration(spark, seed):
    rng = random.Random(seed)
    words = "red blue green small large ring".split()
    rows = [(i, rng.choice([None, *(f"v{k}" for k in range(6 if seed else 2))]), rng.choice([None, "", *(" ".join(rng.choices(words, k=4)) for _ in range(6))]), f"old{i % 3}" if seed == 2 and i % 7 == 0 else None) for i in rng.sample(range(1000), 120)]
    claims = spark.createDataFrame(rows, "claim_id long, video_id string, claim_text string, cluster_id string")
    got = {r.claim_id: r.cluster_id for r in C.clusters(claims, bag_embedder, cells=4).collect()}
    assert got == C.sequential(rows, bag_embedder)


def test_roots(spark):
    links = [(i, i - 1 if i % 50 else None) for i in range(200)] + [(1000, 999), (999, 199)]
    got = {r.claim_id: r.root for r in C.roots(spark.createDataFrame(links, "claim_id long, parent long")).collect()}
    assert got == {i: i // 50 * 50 for i in range(200)} | {1000: 150, 999: 150}


def test_counts(spark):
    claims = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "zz", "q")], "claim_id long, video_id string, claim_text string")
    videos = spark.createDataFrame([("a", "k1"), ("b", "k2"), ("c", "k1")], "video_id string, channel_id string")
    out = C.corroborated(claims, C.clusters(claims, bag_embedder), videos).collect()
    assert {r.claim_id: (r.cluster_id, r.corroboration_count) for r in out} == {1: ("c1", 2), 2: ("c1", 2), 3: ("c3", 1), 4: ("c4", 0)}


@needs_tables
def test_recall(spark):
    from lodestone import fixtures, registry_index

    v = fixtures.vault(spark, SF)
    index, asked = registry_index._embeddings(v), registry_index._asked(v)
    true = {(r.query_id, r.id) for r in V.search(index, asked, 15, None).collect()}
    assert len({(r.query_id, r.id) for r in V.search(index, asked, 15, registry_index.PROBES).collect()} & true) >= 0.9 * len(true)


@needs_tables
def test_texts_searched(spark):
    """claim_search and summary_search against every distance."""
    from lodestone import fixtures, registry_index

    v = fixtures.vault(spark, SF)
    claims = v.tables["claims"].select("claim_id", "confidence", "claim_text").limit(300)
    texts = [(r.p_partkey, r.p_name) for r in registry_index.table(v, "part").limit(5).collect()]
    got: dict = {}
    for r in registry_index.search_texts(claims, "claim_id", "claim_text", spark.createDataFrame(texts, "query_id long, query string"), 10, F.col("confidence") >= 0.5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.distance)
    rows = [("x", "en", bag_embedder([r.claim_text])[0]) for r in claims.collect() if r.confidence >= 0.5]
    for i, text in texts:
        assert got[i] == pytest.approx([d for d, _ in exact(rows, np.array(bag_embedder([text])[0]))[:10]], abs=2e-6)
