"""What large tables showed: nothing is cut, and copies of a text cost one comparison."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F


def test_neighbourhood_without_limit(spark, monkeypatch):
    """The query has no limit, as its SQL has none."""
    from lodestone import registry
    from lodestone.operators import graph as G

    edges = spark.createDataFrame([("video:1", "topic:small", "DISCUSSES", 1.0), ("topic:small", "topic:warm", "RELATED_TO", 2.0), ("topic:a", "topic:b", "RELATED_TO", 3.0)], "src string, dst string, type string, weight double")
    assert {r.dst for r in G.neighbourhood(edges, "topic:small", None).collect()} == {"video:1", "topic:warm"}
    assert [r.dst for r in G.neighbourhood(edges, "topic:small", 1).collect()] == ["topic:warm"]
    asked = []
    monkeypatch.setattr(G, "edges_of", lambda v: edges)
    whole = G.neighbourhood
    monkeypatch.setattr(G, "neighbourhood", lambda e, node, limit=50: asked.append(limit) or whole(e, node, limit))
    registry.QUERIES["neighbourhood"](spark, "/none")
    assert asked == [None]


def test_guest_network_by_classes(spark):
    """Classes of equal topics, and every pair of guests follows from them."""
    from lodestone.operators import graph as G
    from lodestone.vault import Vault

    topics = {1: "ab", 2: "ab", 3: "bc", 4: "d", 5: "ab", 6: "", 7: "bc"}
    said = [(f"v{g}", f"c{g}", n, 1.0) for g, t in topics.items() for n in [*t, None]]
    v = Vault(spark, {"chunk_topics": spark.createDataFrame(said, "video_id string, chunk_id string, name string, relevance double"), "guest_appearances": spark.createDataFrame([(g, f"v{g}") for g in topics], "guest_id long, video_id string")})
    got = G.guest_network(v).collect()
    of = {r.guest_b: r.guest_a for r in got if r.same}
    assert of == {1: 1, 2: 1, 5: 1, 3: 3, 7: 3, 4: 4}
    between = {(r.guest_a, r.guest_b): r.topics for r in got if not r.same}
    assert between == {(1, 3): "b"}
    assert all(r.topics == ",".join(topics[r.guest_b]) and r.shared == len(topics[r.guest_b]) for r in got if r.same)
    pairs = {(x, y): ",".join(topics[x]) if of[x] == of[y] else between.get((min(of[x], of[y]), max(of[x], of[y]))) for x in of for y in of if x < y}
    assert {p: t for p, t in pairs.items() if t} == {(x, y): ",".join(sorted(set(topics[x]) & set(topics[y]))) for x in topics for y in topics if x < y and set(topics[x]) & set(topics[y])}


def test_guest_network_has_every_pair(spark, monkeypatch):
    """The query gives each pair of guests, over classes of several rows, with nulls; a class stands in as many rows as its ids fill."""
    from lodestone import fixtures, registry
    from lodestone.operators import graph as G
    from lodestone.vault import Vault

    topics = {g: ("ab", "bc", "d", "", "abz")[g * g % 7 % 5] for g in range(1, 40)} | {40: "q"}
    said = [(f"v{g}", f"c{g}", n, 1.0) for g, t in topics.items() for n in [*t, None]] + [("v0", "c0", "a", 1.0)]
    seen = [(g, f"v{g}") for g in topics] + [(None, "v0"), (1, "v1")]
    v = Vault(spark, {"chunk_topics": spark.createDataFrame(said, "video_id string, chunk_id string, name string, relevance double"), "guest_appearances": spark.createDataFrame(seen, "guest_id long, video_id string")})
    monkeypatch.setattr(fixtures, "vault", lambda *a: v)
    common = {(x, y): sorted(set(topics[x]) & set(topics[y])) for x in topics for y in topics if x < y}
    want = sorted((x, y, ",".join(t), len(t)) for (x, y), t in common.items() if t)
    for least in (1_000, 3):
        monkeypatch.setattr(G, "MEMBERS", least)
        got = registry.QUERIES["guest_network"](spark, "/none")
        assert got.columns == ["guest_a", "guest_b", "topics", "shared"]
        assert sorted(tuple(r) for r in got.collect()) == want


def test_search_copies_equals_search_of_rows(spark, monkeypatch):
    """Copies of texts, nulls and ties: the same rows as without classes, with one vector for each distinct text."""
    from lodestone import registry_index as I

    texts = ["small ring", "ring small", "big bolt", "", None, "red"]
    rows = spark.createDataFrame([(i, i % 4 / 4, texts[i * 7 % 6]) for i in range(120)] + [(None, 1.0, "red")], "id long, confidence double, text string")
    asked = spark.createDataFrame([(1, "ring"), (2, "ring"), (3, None), (4, "big small"), (5, "nothing like it")], "query_id long, query string")
    where = F.col("confidence") >= 0.5
    want = {tuple(r) for r in I.search_texts(rows, "id", "text", asked, 7, where).collect()}
    assert len(want) == 35 and {tuple(r) for r in I.search_copies(rows, "id", "text", asked, 7, where).collect()} == want
    sizes = []
    build = I.V.build
    monkeypatch.setattr(I.V, "build", lambda r, *a, **k: sizes.append(r.count()) or build(r, *a, **k))
    I.search_copies(rows, "id", "text", asked, 7, where).collect()
    assert sizes and sizes[0] <= 5


def test_claim_search_indexes_texts_once(spark, monkeypatch):
    from lodestone import registry, registry_index as I

    called = []
    monkeypatch.setattr(I, "search_copies", lambda *a, **k: called.append(1))
    registry.QUERIES["claim_search"](spark, "/root/testdata/sf0.001")
    assert called


def test_fuzzy_links_count_the_pairs(spark, monkeypatch):
    """Links and classes are those of fuzzy_pairs, over several blocks, with copies, nulls, flipped and odd names."""
    import random

    from lodestone.operators import entities as E

    monkeypatch.setattr(E, "BLOCK", 20)
    rng = random.Random(3)
    names = ["Smith, Ann", "Ann Smith", "ann smith", None, "", " ", "é" * 9, "é" * 8 + "e", "Customer#000000001", "Customer#000000010", "Customer#000001234"]
    for _ in range(12):
        name = "".join(rng.choices("abcd 01", k=rng.randrange(3, 22)))
        for _ in range(5):
            at = rng.randrange(len(name))
            names.append(name[:at] + rng.choice(["", "x", "a", "yz"]) + name[at + 1 :])
    clean = [None if n is None else {"Smith, Ann": "ann smith"}.get(n, n.strip(" ").lower()) for n in names]
    # copies are compared in the place of the first of them
    place = {}
    for i, n in enumerate(clean):
        place.setdefault(n, i)
    links, low = {i: 0 for i, n in enumerate(clean) if n is not None}, {i: i for i, n in enumerate(clean) if n is not None}
    want = []
    for i in links:
        for j in links:
            x, y = sorted((clean[i], clean[j]), key=place.get)
            if i < j and E.similarity(x, y) >= 0.85:
                want.append((i, j))
                links[i], links[j] = links[i] + 1, links[j] + 1
    while any(low[a] != low[b] for a, b in want):
        for a, b in want:
            low[a] = low[b] = min(low[a], low[b])
    guests = spark.createDataFrame([(i, n, 1) for i, n in enumerate(names)], "guest_id long, canonical_name string, mention_count long")
    got = {(r.guest_id, r.class_id, r.links) for r in E.fuzzy_links(guests).collect()}
    assert got == {(i, low[i], links[i]) for i in links}


def test_machine_asks_for_its_state_once():
    """A call of a video's machine reads its state once, lists no timers, and works on rows."""
    import datetime as dt

    from pyspark.sql import Row

    from lodestone.streaming import machine as M

    calls, kept = [], {}

    class Value:
        def get(self):
            calls.append("get")
            return kept.get("v")

        def update(self, value):
            kept["v"] = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

        def registerTimer(self, at):
            calls.append(("register", at))

        def deleteTimer(self, at):
            calls.append(("delete", at))

    machine = M._Machine(10_000_000, 3)
    machine.init(Handle())
    event = lambda i, s, kind: Row(event_id=i, at=dt.datetime(1970, 1, 1, 0, 0, s), video_id="a", scan_id="s", kind=kind, passed=True)
    out = list(machine.handleInputRows(("a",), iter([event(2, 2, "done"), event(1, 1, "claim")]), None))
    assert [(r.event_id, r.result) for r in out] == [(1, "CLAIMED"), (2, "ADVANCED")]
    assert calls == ["get", ("register", 12_000)]
    list(machine.handleInputRows(("a",), iter([event(3, 4, "release")]), None))
    assert calls[2:] == ["get", ("delete", 12_000)]


@pytest.mark.parametrize("name", ["hybrid_citations", "bm25_indexed", "bm25_indexed_phrase", "bm25_search"])
def test_chunks_are_made_once(spark, name):
    """The view of chunks, a window over all line items, is written once; what a query then reads is no longer that view."""
    from lodestone import registry, registry_index, registry_text  # noqa: F401

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_linenumber" not in plan


def test_graph_is_written_once_in_one_direction(spark, monkeypatch):
    """Links may repeat and are written as they are; a search for one node ends with the step that reaches it; topics of equal sets are paired once."""
    from lodestone.operators import graph as G
    from lodestone.vault import Vault

    written = []
    store = G.stored
    monkeypatch.setattr(G, "stored", lambda df, name: written.append(name) or store(df, name))
    links = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "b"), ("c", "d"), ("e", "d")], "src string, dst string")
    assert {tuple(r) for r in G.distances(links, "a", 3).collect()} == {("a", 0, None), ("b", 1, "a"), ("c", 2, "b"), ("d", 3, "c")}
    written.clear()
    assert G.shortest_path(links, "a", "b", 3).first().path == ["a", "b"]
    assert written == ["links", "frontier"]
    said = [(v, n) for v, t in (("1", "abb"), ("2", "ab"), ("3", "abc"), ("4", "c")) for n in t]
    vault = Vault(spark, {"chunk_topics": spark.createDataFrame(said, "video_id string, name string")})
    assert {tuple(r) for r in G.topic_cooccurrence(vault).collect()} == {("a", "b", 3), ("a", "c", 1), ("b", "c", 1)}


def test_snippet_compares_tokens_in_place(spark, monkeypatch):
    """No slice is made for each start; hits at the ends and in texts shorter than the phrase are as in plain Python."""
    from lodestone.plans import search as S

    phrases = [["the"], ["of", "the", "sea"]]
    texts = ["the", "of", "of the", "x of the sea", "of the sea the", "", None, "Of THE, sea of the sky"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    shown = rows.select("i", S.best_snippet(F.col("text"), phrases).alias("s"))
    assert {r.i: r.s for r in shown.collect()} == {i: S.plain_snippet(t, phrases) for i, t in enumerate(texts)}
    sizes, cut = [], F.slice
    monkeypatch.setattr(S.F, "slice", lambda x, start, size: sizes.append(size) or cut(x, start, size))
    S.best_snippet(F.col("text"), phrases)
    assert set(sizes) == {30 * len(phrases)}


def test_claims_are_joined_once(spark, monkeypatch):
    """Only claims that others can take from meet in rounds; keys whose first claims are all of few videos are read to their end."""
    import random

    from lodestone.functions.text import bag_embedder
    from lodestone.operators import corroboration as C

    rng = random.Random(5)
    texts = ["red ring", "ring red", "blue bolt", None, "small red ring of steel"]
    # the first text's first 40 claims are of one video, those of the second of two
    rows = [(i, "v0", texts[0], None) for i in range(40)] + [(i, f"v{i % 2}", texts[1], None) for i in range(40, 90)]
    rows += [(i, rng.choice([None, *(f"v{k}" for k in range(9))]), rng.choice(texts), f"old{i % 3}" if i % 41 == 0 else None) for i in range(100, 400)]
    claims = spark.createDataFrame(rows, "claim_id long, video_id string, claim_text string, cluster_id string")
    sizes, longer, roots, foremost = [], [], C.roots, C._foremost
    monkeypatch.setattr(C, "roots", lambda links: sizes.append(links.count()) or roots(links))
    monkeypatch.setattr(C, "_foremost", lambda *a: longer.append(1) or foremost(*a))
    want = C.sequential(rows, bag_embedder)
    assert {r.claim_id: r.cluster_id for r in C.clusters(claims, bag_embedder, cells=4).collect()} == want
    assert longer and sizes[0] <= 30 * len(texts)
    videos = spark.createDataFrame([(f"v{k}", f"c{k % 4}") for k in range(9)], "video_id string, channel_id string")
    channels: dict = {}
    for i, video, _, _ in rows:
        channels.setdefault(want[i], set()).update([int(video[1:]) % 4] if video else [])
    got = {r.claim_id: (r.cluster_id, r.corroboration_count) for r in C.corroboration(claims, bag_embedder, videos, cells=4).collect()}
    assert got == {i: (c, len(channels[c])) for i, c in want.items()}


@pytest.mark.parametrize("name", ["claim_corroboration", "claim_clusters"])
def test_claims_are_made_once(spark, name):
    """The view of claims, a window over all line items, is written once; what a query then reads is no longer that view."""
    from lodestone import registry, registry_index, registry_text  # noqa: F401

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_linenumber" not in plan


def test_topics_of_videos_are_made_once(spark):
    """A dossier's numbers come from one grouping of topics by video, its leaders from the first few of each topic."""
    from lodestone import registry, registry_text  # noqa: F401
    from lodestone.plans import dossier
    from lodestone.vault import Vault

    plan = registry.QUERIES["dossier_markdown"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(p_name" not in plan
    said = [(f"{v}-{c}", v, n, 1.0) for v, c, n in (("a", 0, "x"), ("a", 0, "x"), ("a", 1, "x"), ("a", 1, "y"), ("b", 0, "x"), ("unknown", 0, "x"), ("unknown", 0, "y"), ("b", 1, None))]
    tables = {
        "chunk_topics": spark.createDataFrame(said, "chunk_id string, video_id string, name string, relevance double"),
        "videos": spark.sql("SELECT id AS video_id, k AS channel_id, date'2024-01-01' AS upload_date, 60 AS duration_seconds FROM VALUES ('a', 'k1'), ('b', 'k2') AS t(id, k)"),
        "guest_appearances": spark.createDataFrame([(g, v) for g in range(8) for v in ("a", "b", "unknown")[: g % 3 + 1]], "guest_id long, video_id string"),
        "claims": spark.createDataFrame([(1, "x", "c1"), (2, "x", "c1")], "claim_id long, topic string, cluster_id string"),
    }
    got = {r.name: r for r in dossier.dossiers(Vault(spark, tables)).collect()}
    assert {n: (r.videos, r.channels, r.mentions, r.claims, r.clusters) for n, r in got.items()} == {"x": (2, 2, 3, 2, 1), "y": (1, 1, 1, 0, 0), None: (1, 1, 0, 0, 0)}
    assert [(r.n, r.id) for r in got["x"].leading_guests] == [(3, "5"), (3, "2"), (2, "7"), (2, "4"), (2, "1")]
    assert [(r.n, r.id) for r in got["x"].leading_channels] == [(1, "k2"), (1, "k1")]


def test_graph_is_counted_in_its_tables(spark):
    """Topics are grouped by video once; the counts are those of the edges, nulls and repeats included."""
    from lodestone import registry
    from lodestone.operators import graph as G
    from lodestone.vault import Vault

    for name in ("graph_stats", "degrees"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "split(p_name" not in plan
    said = [("a", "x", 0.1), ("a", "x", 0.9), ("a", "y", 0.2), ("b", "x", 0.3), ("b", "y", 0.3), ("b", None, 0.3), ("e", None, None), (None, "z", 0.4)]
    tables = {
        "videos": spark.createDataFrame([("a", "k1"), ("b", "k1"), ("b", "k1"), ("c", None), (None, "k2")], "video_id string, channel_id string"),
        "guest_appearances": spark.createDataFrame([(1, "a"), (1, "a"), (None, "d"), (3, None)], "guest_id long, video_id string"),
        "chunk_topics": spark.createDataFrame(said, "video_id string, name string, relevance double"),
    }
    v = Vault(spark, tables)
    want = {"channel": 2, "guest": 2, "topic": 3, "video": 5, None: 1, "PUBLISHED": 5, "APPEARED_IN": 3, "DISCUSSES": 7, "RELATED_TO": 1}
    assert {r.label: r.n for r in G.vault_stats(v).collect()} == want
    assert {r.label: r.n for r in G.graph_stats(G.edges_of(v)).collect()} == want
    assert {(r.src, r.dst, r.weight) for r in G.edges_of(v).collect() if r.type in ("DISCUSSES", "RELATED_TO") and r.src and r.dst} == {("video:a", "topic:x", 0.9), ("video:a", "topic:y", 0.2), ("video:b", "topic:x", 0.3), ("video:b", "topic:y", 0.3), ("topic:x", "topic:y", 2.0)}
    none = Vault(spark, {n: df.limit(0) for n, df in tables.items()})
    assert G.vault_stats(none).collect() == []


def test_divergence_makes_no_pairs_of_topics(spark):
    """Videos of the graph are counted in the tables that link them, without edges."""
    from lodestone import registry, registry_stages  # noqa: F401
    from lodestone.operators import graph as G
    from lodestone.operators import review as V
    from lodestone.vault import Vault

    plan = registry.QUERIES["store_divergence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(" not in plan and "flatten(" not in plan
    tables = {
        "videos": spark.createDataFrame([("a", False), ("b", None), ("c", True), (None, False)], "video_id string, is_deleted boolean"),
        "guest_appearances": spark.createDataFrame([(1, "a"), (2, "d"), (3, None)], "guest_id long, video_id string"),
        "chunk_topics": spark.createDataFrame([("e", "x"), ("a", None), ("a", "x")], "video_id string, name string"),
    }
    v = Vault(spark, tables)
    assert tuple(V.store_divergence(v, spark.createDataFrame([("a",), ("a",), ("z",)], "video_id string"), G.videos_of(v)).first()) == (3, 2, 5)


def test_upsert_of_edges_by_their_number(spark, monkeypatch):
    """Edges are written once, and no task of the upsert sorts more than a fixed number of them; the rows are the same whatever the tasks."""
    import re

    from lodestone import registry, registry_writes  # noqa: F401
    from lodestone import vault as V
    from lodestone.operators import lifecycle as L

    whole = {tuple(r) for r in registry.QUERIES["write_graph"](spark, "/root/testdata/sf0.001").collect()}
    monkeypatch.setattr(V, "TASK_ROWS", 100)
    df = registry.QUERIES["write_graph"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "split(p_name" not in plan and {tuple(r) for r in df.collect()} == whole
    parts = {int(n) for n in re.findall(r"RepartitionByExpression \[.*?\], (\d+)", plan)}
    assert len(parts) == 1 and parts.pop() > len(whole) // 100
    assert V.tasks(spark, 0) == 4 and V.tasks(spark, 1001) == 11
    old = spark.createDataFrame([("a", "b", "t", 1.0, "x"), ("a", "c", "t", 1.0, "x")], "src string, dst string, type string, weight double, relationship string")
    new = spark.createDataFrame([("a", "b", "t", 2.0, ""), ("a", "b", "t", 4.0, ""), ("d", "e", "t", 1.0, "y")], old.schema)
    want = {("a", "b", "t", 7.0, "x"), ("a", "c", "t", 1.0, "x"), ("d", "e", "t", 1.0, "y")}
    for parts in (None, 7):
        assert {tuple(r) for r in L.save(V.Vault(spark, {"edges": old}), "edges", new, parts).edges.collect()} == want


def test_fuzzy_links_move_a_name_a_bounded_number_of_times(spark, monkeypatch):
    """More blocks than BLOCKS are not made, however many names there are; links and classes are those of all pairs."""
    from lodestone.operators import entities as E

    monkeypatch.setattr(E, "BLOCK", 4)
    monkeypatch.setattr(E, "BLOCKS", 6, raising=False)
    written, keep = {}, E.stored

    def stored(df, name):
        written[name] = keep(df, name)
        return written[name]

    monkeypatch.setattr(E, "stored", stored)
    names = [f"Customer#{i * 37 % 1000:09d}" for i in range(160)]
    guests = spark.createDataFrame([(i, n, 1) for i, n in enumerate(names)], "guest_id long, canonical_name string, mention_count long")
    got = E.fuzzy_links(guests).collect()
    assert written["name_links"].groupBy("id").count().agg(F.max("count")).first()[0] <= 6
    links = {i: sum(E.similarity(*(n.lower() for n in (names[min(i, j)], names[max(i, j)]))) >= 0.85 for j in range(160) if j != i) for i in range(160)}
    assert {r.guest_id: r.links for r in got} == links and {r.class_id for r in got} == {0}


def test_linked_by_groups_equals_all_pairs(monkeypatch):
    """Groups of common beginnings, names one by one, and difflib pair by pair agree: endings short and missing, places in and out of order, several weights."""
    import random

    import numpy as np

    from lodestone.operators import names as N

    rng = random.Random(5)
    grouped = 0
    for turn in range(16):
        letters = rng.choice(["ab", "abc01", "0123456789", "abcdefgh é"])
        heads = ["".join(rng.choices(letters, k=rng.randrange(9))) for _ in range(6)] + ["x" * 210] * (turn == 3)
        names = sorted({rng.choice(heads) + "".join(rng.choices(letters, k=rng.randrange(4))) for _ in range(60)})
        cutoff = rng.choice([0.5, 0.7, 0.85, 0.97])
        half = len(names) // 2
        if turn % 2:
            rng.shuffle(names)
        weight = np.array([rng.randrange(1, 4) for _ in names])
        order = np.argsort(names, kind="stable")
        every = np.arange(len(names))
        for left, right in ((every, every), (np.sort(order[:half]), np.sort(order[half:]))):
            sums, low = np.zeros(len(names)), {int(i): int(i) for i in every}
            pairs = {(min(x, y), max(x, y)) for x in left.tolist() for y in right.tolist() if x != y}
            alike = [(x, y) for x, y in pairs if N.similarity(names[x], names[y]) >= cutoff]
            for x, y in alike:
                sums[x], sums[y] = sums[x] + weight[y], sums[y] + weight[x]
            while any(low[x] != low[y] for x, y in alike):
                for x, y in alike:
                    low[x] = low[y] = min(low[x], low[y])
            if left is every:
                right = left
            for dense in (0, 1 << 40):
                monkeypatch.setattr(N, "DENSE", dense)
                found = N.linked(names, left, right, weight, cutoff)
                assert found[0].tolist() == sums.tolist() and found[1].tolist() == list(low.values())
            grouped += len(alike)
    assert grouped > 100 and N._TABLES
