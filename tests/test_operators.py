"""Order-dependent and writing operators on small tables by hand."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import text as X
from lodestone.functions.triage import finish_triage, rule_triage
from lodestone.operators import entities as E
from lodestone.operators import graph as G
from lodestone.operators import lifecycle as L
from lodestone.operators import relational as R
from lodestone.plans import index
from lodestone.plans import search as S
from lodestone.plans.query_parser import parse_query
from lodestone.sources import export, metadata
from lodestone.streaming import stages
from lodestone.vault import Vault, upsert


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture
def vault(spark):
    v = Vault(spark)
    videos = spark.createDataFrame([("v1", "c1", "Intro", "REJECTED", "DONE", False, None), ("v2", "c1", "Neural nets", "ACCEPTED", "CHUNKED", False, "s9"), ("v3", "c2", "Cells", "DISCOVERED", "METADATA_HARVESTED", None, None)], "video_id string, channel_id string, title string, triage_status string, checkpoint_stage string, is_deleted boolean, locked_by_scan_id string")
    v = v.append("videos", videos)
    v = v.append("guests", spark.createDataFrame([(1, "Naval Ravikant", ["Naval"], 5), (2, "Ravikant, Naval", [], 2), (3, "the speaker", None, 9), (4, "Jane Doe", None, 1)], "guest_id long, canonical_name string, aliases array<string>, mention_count long"))
    return v.append("guest_appearances", spark.createDataFrame([(1, "v1", 0.0), (2, "v1", 0.0), (2, "v2", 1.0), (4, "v2", 3.0)], "guest_id long, video_id string, start_timestamp double"))


@pytest.mark.parametrize(("url", "want"), [("https://www.youtube.com/watch?v=dQw4w9WgXcQ&list=PL1", ("video", "dQw4w9WgXcQ")), ("https://youtu.be/dQw4w9WgXcQ", ("video", "dQw4w9WgXcQ")), ("https://www.youtube.com/playlist?list=PLabc", ("playlist", "PLabc")), ("https://youtube.com/@someone", ("channel", "someone")), (" @some.one ", ("channel", "some.one")), ("https://www.youtube.com/channel/XY-1", ("channel", "XY-1")), ("https://www.youtube.com/c/Name", ("channel", "Name")), ("a@b.c", (None, None)), ("https://www.youtube.com/channel/UC123", ("channel", "UC123")), ("https://example.com/?v=dQw4w9WgXcQ", (None, None)), ("", (None, None)), (None, (None, None))])
def test_urls(spark, url, want):
    assert tuple(one(spark, X.parse_url(F.lit(url).cast("string")))) == want


def test_text_functions(spark):
    assert one(spark, X.iso_date(F.lit("20240115"))) == "2024-01-15" and one(spark, X.iso_date(F.lit("2024"))) == "2024"
    assert one(spark, X.minutes_seconds(F.lit(125.7))) == "02:05"
    assert one(spark, X.quick_normalize(F.lit("Um, I mean  it is, you know, basically like a fine one, right? Sort of"))) == ", it is, , a fine one,"
    assert one(spark, X.sentences(F.lit("It is approx. 3 m. See e.g. this."))) == ["It is approx. 3 m.", "See e.g.", "this."]
    assert one(spark, X.sentences(F.lit("Dr. Who came. It was 3. 14 or so! Really? Yes"))) == ["Dr. Who came.", "It was 3. 14 or so!", "Really?", "Yes"]
    assert one(spark, X.json_list(F.lit('```json\n[{"name": "a"}]\n```'), "struct<name:string>"))[0]["name"] == "a"
    assert one(spark, X.json_list(F.lit('{"name": "a"}'), "struct<name:string>")) == []
    assert one(spark, X.triage_reply(F.lit("no json")))["category"] == "AMBIGUOUS"
    assert X.repair_json('[{"a": 1,} {"b": "x') == [{"a": 1}, {"b": "x"}] and X.repair_json("nope") is None
    assert one(spark, X.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 1.0
    assert one(spark, X.merge_windows(F.array(F.lit("a b c d"), F.lit("c d e f"), F.lit("f")), 2)) == "a b c d e f f"
    assert one(spark, X.pack_sentences(F.array(*[F.lit(s) for s in ("aa", "bb", "cccccccc", "d")]), 5)) == ["aa bb", "cccccccc", "d"]
    segments = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(float(s)).alias("start"), F.lit(5.0).alias("duration")) for t, s in (("one two", 0), ("three four five", 5))])
    assert [one(spark, X.word_time(segments, F.lit(i))) for i in (0, 1, 2, 5, 99)] == [0.0, 2.5, 5.0, 10.0, 10.0]
    assert one(spark, X.reslice(F.lit("a b c d e f"), segments)) == ["a b", "c d e f"]
    assert one(spark, X.segments_text(segments)).startswith("[00:00] one two [00:05]")
    payload = json.dumps({"events": [{"tStartMs": 1500, "dDurationMs": 500, "segs": [{"utf8": "hi "}, {"utf8": "you"}]}, {"tStartMs": 3}]})
    assert [tuple(x) for x in one(spark, X.subtitle_events(F.lit(payload)))] == [("hi you", 1.5, 0.5)]


@pytest.mark.parametrize(("n", "counts"), [(0, []), (49, []), (50, [50]), (320, [320]), (370, [370, 50]), (400, [400, 80]), (1000, [400, 400, 360]), (1009, [400, 400, 369])])
def test_sliding_windows(spark, n, counts):
    got = one(spark, X.sliding_windows(F.lit(" ".join(["w"] * n))))
    assert [len(c.split()) for c in got] == counts


def test_semantic_chunks(spark):
    text = " ".join(["alpha beta gamma."] * 6 + ["delta epsilon zeta."] * 6)
    rows = X.semantic_chunks(spark.createDataFrame([("v", text), ("short", "One. Two.")], "video_id string, text string"), least=5, group=3).collect()
    assert [(r.video_id, r.first_sentence, r.end_sentence) for r in rows] == [("v", 0, 6), ("v", 6, 12)]


def test_query_parser():
    plan = parse_query('what is channel:"My Chan" topic:ai after:2024-01-01 before:2024-02-01 guest:Bob language:en   a ratio 1:10 topic:second')
    assert plan.text == "what is a ratio 1:10 topic:second"
    assert plan.filters == {"channel": "My Chan", "topic": "ai", "after": "2024-01-01", "before": "2024-02-01", "guest": "Bob", "language": "en"}
    assert parse_query("lang:fr x").filters == {"language": "fr"} and parse_query("slang:fr x").filters == {}
    assert parse_query("plain").predicate() is None and plan.predicate() is not None


def test_triage(spark):
    df = spark.createDataFrame([("a", "c1", "Deep AI talk", 30), ("b", "good", "x", 90), ("c", "c1", "An AI and ML and bio and DNA talk", 90), ("d", "c1", "AIming high", 90), ("e", "shorts", "x", 10)], "video_id string, channel_id string, title string, duration_seconds int")
    got = {r.video_id: (r.triage_status, r.triage_reason) for r in rule_triage(df, ["bio", "AI", "ML", "DNA"], ["good"], ["shorts"]).collect()}
    assert got == {"a": ("REJECTED", "duration_under_60s"), "b": ("ACCEPTED", "verified_channel"), "c": ("ACCEPTED", "keyword_match: bio, AI, ML"), "d": ("NEEDS_LLM", "ambiguous_metadata"), "e": ("NEEDS_LLM", "ambiguous_metadata")}
    assert one(spark, finish_triage(F.lit("NOISE"), F.lit(0.6))) == "PENDING_REVIEW"


def test_fusion_and_neighbours(spark):
    v = spark.createDataFrame([("a", 0, 0.1), ("b", 1, 0.2)], "chunk_id string, rank int, distance double")
    t = spark.createDataFrame([("c", 0), ("b", 1)], "chunk_id string, rank int")
    got = S.fuse(v, t).orderBy("position").collect()
    assert [(r.chunk_id, r.distance) for r in got] == [("b", 0.2), ("a", 0.1), ("c", 0.5)]
    hits = spark.createDataFrame([("v", 1, 0.5, 0), ("v", 2, 0.4, 1), ("v", 3, 0.9, 2), ("v", 9, 0.9, 3), ("w", 2, 0.7, 4)], "video_id string, chunk_index int, distance double, position int")
    assert {(r.video_id, r.chunk_index) for r in S.drop_neighbours(hits).collect()} == {("v", 2), ("v", 9), ("w", 2)}


def test_bm25_matches_formula(spark):
    import math

    chunks = spark.createDataFrame([("v1__chunk_0001", "v1", "Ünïcode neural nets are neural"), ("v1__chunk_0002", "v1", "cells and nets"), ("v2__chunk_0000", "v2", "nothing here")], "chunk_id string, video_id string, text string")
    got = {r.chunk_id: r.score for r in S.bm25(chunks, "neural").collect()}
    d, mean = 5 + 3 + 1, ((5 + 4) + (3 + 4) + (2 + 4)) / 3
    assert list(got) == ["v1__chunk_0001"]
    assert got["v1__chunk_0001"] == pytest.approx(-math.log(2.5 / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * d / mean)))
    assert [r.chunk_id for r in S.bm25(chunks, '"NEURAL nets"').collect()] == ["v1__chunk_0001"]
    assert S.bm25(chunks, "unicode").count() == 1 and S.bm25(chunks, "unicorn").count() == S.bm25(chunks, "").count() == 0


def test_islands_and_intervals(spark):
    heat = spark.createDataFrame([("v", i, float(i), float(i + 1), s) for i, s in enumerate((0.1, 0.8, 0.9, 0.2, 0.7))], "video_id string, pos int, start double, end double, score double")
    assert [(r.start, r.end, r.score) for r in R.islands(heat).orderBy("start").collect()] == [(1.0, 3.0, 0.9), (4.0, 5.0, 0.7)]
    seg = spark.createDataFrame([("v", 0.0, 2.0), ("v", 2.0, 2.0), ("w", 0.0, 2.0)], "video_id string, start double, duration double")
    skips = spark.createDataFrame([("v", 1.0, 2.5)], "video_id string, start double, end double")
    assert sorted((r.video_id, r.start) for r in R.strip_intervals(seg, skips).collect()) == [("v", 2.0), ("w", 0.0)]


def test_upsert_policies(spark):
    old = spark.createDataFrame([(1, "a", 5, ["x"], "k"), (2, "b", 1, None, "k")], "id int, name string, n int, tags array<string>, other string")
    new = spark.createDataFrame([(1, "", 2, ["y"]), (3, "c", 7, None)], "id int, name string, n int, tags array<string>")
    policy = {"name": "fill", "n": "add", "tags": "union"}
    got = {r.id: tuple(r)[1:] for r in upsert(old, new, ["id"], policy).collect()}
    assert got == {1: ("a", 7, ["x", "y"], "k"), 2: ("b", 1, None, "k"), 3: ("c", 7, None, None)}
    again = upsert(upsert(old, new, ["id"], {"n": "keep"}), new, ["id"], {"n": "keep"})
    assert sorted(map(str, again.collect())) == sorted(map(str, upsert(old, new, ["id"], {"n": "keep"}).collect()))


def test_lifecycle(spark, vault):
    v = L.override_rejected(L.override_rejected(vault, "v1", "fine"), "v2")
    assert {r.video_id: (r.triage_status, r.checkpoint_stage) for r in v.videos.collect()} == {"v1": ("ACCEPTED", "METADATA_HARVESTED"), "v2": ("ACCEPTED", "CHUNKED"), "v3": ("DISCOVERED", "METADATA_HARVESTED")}
    held = L.claim(vault, spark.createDataFrame([("v1", "s2"), ("v1", "s1"), ("v2", "s1")], "video_id string, scan_id string"))
    assert {r.video_id: r.locked_by_scan_id for r in held.videos.collect()} == {"v1": "s1", "v2": "s9", "v3": None}
    assert L.release(held, "s9").videos.filter("locked_by_scan_id = 's9'").count() == 0
    gone = L.soft_delete(vault, F.col("channel_id") == "c1", "old")
    assert gone.videos.filter("is_deleted").count() == 2 and gone.deletion_history.count() == 2
    assert L.restore(gone, "v1").videos.filter("is_deleted").count() == 1
    purged = L.purge(vault, spark.createDataFrame([("v2",)], "video_id string"), "bad")
    assert {r.guest_id for r in purged.guests.collect()} == {1, 2, 3} and purged.guest_appearances.count() == 2
    assert purged.deletion_history.first().data_deleted == {"guest_appearances": 2}
    box = L.outbox_done(L.outbox_entry(L.outbox_entry(vault, vault.videos), vault.videos.limit(0)), "v1", "vector")
    assert {r.video_id: (r.vector_done, r.retry_count) for r in box.sync_outbox.collect()} == {"v1": (True, 1), "v2": (False, 1), "v3": (False, 1)}
    drained = L.drain_outbox(box, lambda v, ids: L.outbox_done(L.outbox_done(v, "v1", "graph"), "v2", "graph"))
    assert {r.video_id for r in drained.sync_outbox.collect()} == {"v2", "v3"}
    assert [one(spark, L.next_stage(F.lit(s))) for s in ("METADATA_HARVESTED", "DONE", "?")] == ["TRIAGE_COMPLETE", None, "METADATA_HARVESTED"]
    assert one(spark, L.remaining_stages(F.lit("EMBEDDED"))) == schemas.STAGES[10:] and len(one(spark, L.remaining_stages(F.lit("?")))) == 13
    with pytest.raises(ValueError):
        L.advance(vault, "v1", "NOWHERE")


def test_entities(spark, vault):
    clean = E.purge_noise(vault)
    assert {r.guest_id for r in clean.guests.collect()} == {1, 2, 4}
    plan = E.fuzzy_merge_plan(clean.guests)
    assert [tuple(r) for r in plan.collect()] == [(2, 1)]
    merged = E.merge_guests(clean, plan)
    first = merged.guests.filter("guest_id = 1").first()
    assert (first.mention_count, first.aliases) == (7, ["Naval", "Ravikant, Naval"])
    assert {(r.guest_id, r.video_id) for r in merged.guest_appearances.collect()} == {(1, "v1"), (1, "v2"), (4, "v2")}
    named = E.resolve(spark.createDataFrame([("Naval",), (" the speaker ",), ("New One",)], "name string"), clean.guests)
    assert {r.name: r.guest_id for r in named.collect()} == {"Naval": 1, "New One": None}
    claims = spark.createDataFrame([(1, "a", "cats purr loudly", "t"), (2, "b", "cats purr loudly", "t"), (3, "b", "cats purr loudly", "t"), (4, "c", "dogs bark", "t")], "claim_id long, video_id string, claim_text string, topic string")
    assert {r.claim_id: r.cluster_id for r in E.claim_clusters(claims, X.bag_embedder).collect()} == {1: "c1", 2: "c1", 3: "c1", 4: "c4"}


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "R", 1.0), ("b", "c", "R", 1.0), ("c", "d", "R", 1.0), ("d", "e", "R", 1.0), ("a", "x", "R", 1.0), ("x", "c", "R", 1.0)], "src string, dst string, type string, weight double")
    assert G.shortest_path(edges, "a", "d", 3).first().path == ["a", "b", "c", "d"]
    assert G.shortest_path(edges, "a", "e", 3).count() == 0 and G.shortest_path(edges, "a", "a", 3).first().path == ["a"]
    merged = G.merge_vertices(edges, spark.createDataFrame([("x", "b")], "id string, survivor string"))
    assert {(r.src, r.dst): r.weight for r in merged.collect()}[("a", "b")] == 2.0


def test_sources_and_exports(spark, vault, tmp_path):
    raw = spark.createDataFrame([(json.dumps({"id": "a", "channel_id": "c", "channel": "C", "title": "T", "description": "d" * 900, "upload_date": "20240115", "tags": ["x"], "duration": 61.5}),), ("oops",), ("{}",)], "json string")
    videos, channels, rejected = metadata.parse_metadata(raw)
    row = videos.first()
    assert (len(row.description), str(row.upload_date), row.duration_seconds, row.view_count) == (500, "2024-01-15", 61, 0)
    assert channels.count() == 1 and rejected.count() == 2
    path = tmp_path / "list.jsonl"
    path.write_text('{"id": "a", "upload_date": "20240101"}\nbad\n{"id": "b", "upload_date": "20240301"}\n')
    spark.dataSource.register(metadata.ListingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    listing = lambda: spark.read.format("vault_listing").option("paths", str(path)).load()  # noqa: E731  a loaded frame keeps its pushed bound
    assert [r.video_id for r in listing().filter("upload_date >= '2024-02-01'").collect()] == ["b"] and listing().count() == 2
    cites = spark.createDataFrame([("source_1", "v", "T", "C", "02:00", "http://x", "text")], export.CITATION_COLUMNS)
    trust = spark.createDataFrame([(0.5, 0.85, 0.7, 0.72)], "diversity double, relevance double, coverage double, overall double")
    assert "**[source_1]** T (C, 02:00)" in export.answer_markdown("q", "a", cites, trust).first().text
    assert json.loads(export.answer_json("q", "a", cites, trust).first().json)["citations"][0]["at"] == "02:00"
    assert "videos/Intro v1.md" in {r.path for r in export.notes(vault, "videos").collect()}
    export.snapshot(vault, str(tmp_path / "snap"))
    assert Vault.load(spark, str(tmp_path / "snap"), ["videos"]).videos.count() == 3


def test_streams(spark, tmp_path):
    rows = spark.range(300).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    got = []
    stream = stages.stage_metrics(stages.events(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double"))
    stages.run_once(stream, lambda df, k: got.append({(r.window.start, r.event_type): r.n for r in df.collect()}), str(tmp_path / "cp"), "complete")
    want = {(r.window.start, r.event_type): r.n for r in rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got[-1] == want
    videos = spark.createDataFrame([("a", "ACCEPTED", "CHUNKED"), ("b", "REJECTED", "CHUNKED"), ("c", "ACCEPTED", "CHUNK_ANALYZED"), ("d", "ACCEPTED", "DONE")], "video_id string, triage_status string, checkpoint_stage string")
    out = stages.step(videos, {"CHUNK_ANALYZED": lambda d: d.withColumn("ok", F.lit(True)), "SUMMARIZED": lambda d: d.withColumn("ok", F.lit(False))})
    assert {r.video_id: r.checkpoint_stage for r in out.collect()} == {"a": "CHUNK_ANALYZED", "b": "CHUNKED", "c": "CHUNK_ANALYZED", "d": "DONE"}


def test_index(spark, tmp_path):
    chunks = spark.createDataFrame([("v1__chunk_0001", "v1", "neural nets are neural nets"), ("v1__chunk_0002", "v1", "nets neural"), ("v2__chunk_0000", "v2", "")], "chunk_id string, video_id string, text string")
    index.build(chunks, str(tmp_path / "i"))
    built = index.read(spark, str(tmp_path / "i"))
    for query in ("neural", "neural nets", "nets neural", "neural nets are neural", "neural neural", "none", "", "v1"):
        want = {r.chunk_id: (round(r.score, 9), r.f) for r in S.bm25(chunks, query).collect()}
        assert {r.chunk_id: (round(r.score, 9), r.f) for r in index.search(built, query).collect()} == want, query
    new = spark.createDataFrame([("v1__chunk_0002", "v1", "other words"), ("v3__chunk_0000", "v3", "neural")], chunks.schema)
    merged = new.union(chunks.join(new.select("chunk_id"), "chunk_id", "left_anti"))
    assert sorted(map(str, index.search(index.refreshed(built, new), "neural").collect())) == sorted(map(str, S.bm25(merged, "neural").collect()))


def test_claim_clusters_of_repeated_claims(spark):
    rng = random.Random(4)
    rows = [(i, f"v{rng.randrange(9)}", " ".join(rng.choices("red blue green small large ring".split(), k=4)), "t" + str(i % 2)) for i in range(150)]
    vector = {r[2]: X.bag_embedder([r[2]])[0] for r in rows}

    def close(a, b):
        x, y = vector[a], vector[b]
        return round(sum(p * q for p, q in zip(x, y)) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5, 12)

    want = {}
    for i, video, text, topic in rows:
        others = [(-close(text, r[2]), r[0]) for r in rows if r[3] == topic and r[1] != video]
        first = [j for s, j in sorted(others)[:5] if s <= -0.85 and j in want]
        want[i] = want[first[0]] if first else f"c{i}"
    claims = spark.createDataFrame(rows, "claim_id long, video_id string, claim_text string, topic string")
    assert {r.claim_id: r.cluster_id for r in E.claim_clusters(claims, X.bag_embedder).collect()} == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_claim_clusters_query_has_every_claim(spark):
    from lodestone import registry, registry_text  # noqa: F401

    sf = "/root/testdata/sf0.001"
    assert registry.QUERIES["claim_clusters"](spark, sf).count() == claims_in(spark, sf).count()


def claims_in(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey")
    part, supplier = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("part", "supplier"))
    return rows.join(part, rows.l_partkey == part.p_partkey).join(supplier, rows.l_suppkey == supplier.s_suppkey)


@pytest.mark.parametrize("cutoff", [0.6, 0.85, 0.97])
def test_fuzzy_pairs_loses_none(spark, cutoff):
    rng = random.Random(6)
    names = ["Katherine Johnsen", "Catherine Johnson", "a", "A", "ab", "abc", "ba", "", " ", "aaaaaa", "aaaaaaa", "aabaaaa"]
    for _ in range(25):
        name = "".join(rng.choices("abcdé ", k=rng.randrange(3, 22)))
        names.append(name)
        for _ in range(4):
            letters = list(name)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(letters))
                letters[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz", "a"])
            names.append("".join(letters) or "q")
    clean = [n.strip(" ").lower() for n in names]
    want = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if E.similarity(clean[i], clean[j]) >= cutoff}
    guests = spark.createDataFrame([(i, n, 1) for i, n in enumerate(names)], "guest_id long, canonical_name string, mention_count long")
    got = [(r.guest_id, r.other_id) for r in E.fuzzy_pairs(guests, cutoff).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    if cutoff == 0.85:
        assert (0, 1) in want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_fuzzy_pairs_query_compares_every_customer(spark):
    from lodestone import registry, registry_text  # noqa: F401

    sf = "/root/testdata/sf0.001"
    names = sorted((r.c_custkey, r.c_name.lower()) for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name").collect())
    want = {(a, b) for i, (a, x) in enumerate(names) for b, y in names[i + 1 :] if E.similarity(x, y) >= 0.85}
    links, low = {a: 0 for a, _ in names}, {a: a for a, _ in names}
    for a, b in sorted(want):
        links[a], links[b] = links[a] + 1, links[b] + 1
    while any(low[a] != low[b] for a, b in want):
        for a, b in want:
            low[a] = low[b] = min(low[a], low[b])
    assert {(r.guest_id, r.class_id, r.links) for r in registry.QUERIES["fuzzy_pairs"](spark, sf).collect()} == {(a, low[a], links[a]) for a in links}


def test_upsert_folds_repeated_keys_of_a_batch(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 1)], "id long, name string, n long")
    new = spark.createDataFrame([(1, "x", 2), (1, "y", 3), (3, "c", 1), (3, "d", 1)], "id long, name string, n long")
    got = sorted(tuple(r) for r in upsert(old, new, ["id"], {"n": "add", "name": "keep"}).collect())
    assert got == [(1, "a", 10), (2, "b", 1), (3, "d", 2)]


def test_stages_take_nulls_and_empty_tables(spark):
    from lodestone.operators import stages as P

    states = spark.createDataFrame(
        [("a", "fr", "un deux", None, "", [("un", 0.0, 2.0), ("deux", 2.0, 2.0)]), ("b", "en", None, None, None, None), ("c", None, "x", None, None, [])],
        "video_id string, language_iso string, raw_text string, cleaned_text string, translated_text string, segments array<struct<text:string,start:double,duration:double>>",
    )
    skips = spark.createDataFrame([("a", 2.0, 3.0), ("a", 9.0, 10.0)], "video_id string, start double, end double")
    got = {r["video_id"]: r for r in P.sponsor_filter(states, skips).collect()}
    assert (got["a"]["raw_text"], got["b"]["raw_text"], got["c"]["raw_text"]) == ("un", None, "")
    got = {r["video_id"]: (r["translated_text"], r["ok"]) for r in P.translate(states, lambda c: F.when(c != "x", F.upper(c))).collect()}
    assert got == {"a": ("UN DEUX", True), "b": (None, True), "c": (None, False)}
    got = {r["video_id"]: r["cleaned_text"] for r in P.normalize(states, lambda c: F.lit(None).cast("string"), lambda c: F.lit("")).collect()}
    assert got == {"a": "un deux", "b": None, "c": "x"}
    made = P.chunks(states, size=2, overlap=1, least=2)
    assert {r["video_id"]: r["ok"] for r in P.chunked(states, made).collect()} == {"a": True, "b": True, "c": False}
    none = states.limit(0)
    assert P.chunks(none).count() == 0 and P.sponsor_filter(none, skips).count() == 0
    rows = spark.createDataFrame([(f"k{i:03}", "v", i, f"t{i}") for i in range(45)] + [("n", "w", 0, None)], "chunk_id string, video_id string, chunk_index int, text string")
    summaries = {r[0]: r[1] for r in P.summarise(rows, lambda c: F.split(c, " ")[0], lambda c: c).collect()}
    assert summaries == {"v": "\n\n".join(f"t{4 * i}" for i in (0, 1, 10, 11, 2, 3, 4, 5, 6, 7, 8, 9))}
    assert P.completion(F.lit(1), F.lit(1), 0, 3) is not None
