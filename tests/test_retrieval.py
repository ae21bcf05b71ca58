"""Retrieval for many questions at once: parts in order, empty results, models that fail."""

import pytest

from lodestone.plans import retrieval as RT
from lodestone.plans import vector_index as V
from lodestone.plans.query_parser import parse_query
from lodestone.vault import Vault


@pytest.fixture
def found(spark, tmp_path):
    v = Vault(spark).append("videos", spark.createDataFrame([("v1", "c1", "Title")], "video_id string, channel_id string, title string"))
    v = v.append("channels", spark.createDataFrame([("c1", "Chan")], "channel_id string, name string"))
    chunks = spark.createDataFrame([("a", "v1", "x" * 400, 65.0), ("b", "zz", "brown foxes", None)], "chunk_id string, video_id string, text string, start_timestamp double")
    index = V.build(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6])], "chunk_id string, vector array<double>"), "chunk_id", "vector", str(tmp_path / "i"))
    questions = spark.createDataFrame([("q", "brown FOXES in xx", [1.0, 0.0], "user: hi", "numbers"), ("none", None, None, "", None)], "query_id string, question string, vector array<double>, history string, numbers string")
    return RT.retrieve(v, index, chunks, questions, probes=None)


def test_contexts(found):
    _, confidence, contexts = found
    rows = {r.query_id: r for r in contexts.collect()}
    want = 'PREVIOUS CONVERSATION:\nuser: hi\n\n---\n\n\nnumbers\n\n---\n\n\nCONTEXT CHUNKS:\n[source_1] Video: "Title" (Channel: Chan, Timestamp: 01:05)\n' + "x" * 300 + '\n\n---\n[source_2] Video: "Unknown" (Channel: Unknown, Timestamp: 00:00)\nbrown foxes\n\n\n\nRESEARCH QUESTION:\nbrown FOXES in xx'
    assert (rows["q"].citations, rows["q"].context) == (2, want)
    assert (rows["none"].citations, rows["none"].context) == (0, "CONTEXT CHUNKS:\n\n\n\nRESEARCH QUESTION:\n")
    sure = {r.query_id: tuple(round(x, 6) for x in r[1:]) for r in confidence.collect()}
    assert sure == {"q": (1.0, 0.9, 1.0, 0.97), "none": (0.0, 0.0, 0.0, 0.0)}


def test_answers(spark):
    prompts = spark.createDataFrame([(1, 1, "good"), (2, 0, "asked nobody"), (3, 2, "bad"), (4, 1, "fine")], "query_id int, citations int, context string")

    def model(texts):
        if "bad" in texts or "asked nobody" in texts:
            raise RuntimeError
        return [t.upper() for t in texts]

    got = {r.query_id: (r.answer, r.suggestions) for r in RT.answered(prompts.coalesce(1), model, lambda texts: [[t, "?"] for t in texts]).collect()}
    assert got == {1: ("GOOD", ["good", "?"]), 2: (RT.NOTHING, RT.WITHOUT), 3: (None, ["bad", "?"]), 4: ("FINE", ["fine", "?"])}


def test_allowed_videos(spark):
    v = Vault(spark).append("videos", spark.createDataFrame([(x, "c", "en") for x in "abcd"], "video_id string, channel_id string, language_iso string"))
    v = v.append("guests", spark.createDataFrame([(1, "Jane Doe", ["JD"])], "guest_id long, canonical_name string, aliases array<string>"))
    v = v.append("guest_appearances", spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.0), (1, "b", 1.0)], "guest_id long, video_id string, start_timestamp double"))
    v = v.having(chunk_topics=spark.createDataFrame([("b", "AI"), ("c", "ai")], "video_id string, name string"))
    ids = lambda text: sorted(r.video_id for r in RT.allowed_videos(v, parse_query(text)).collect())
    assert ids("x") == ["a", "b", "c", "d"] and ids("guest:jd x") == ["a", "b"] and ids("topic:Ai") == ["b", "c"]
    assert ids('guest:"jane doe" topic:ai') == ["b"] and ids("guest:nobody") == [] and ids("language:fr topic:ai") == []


def test_stances(spark):
    rows = [(i, "v", "t", f"claim {i}", i / 100) for i in range(60)] + [(100, None, "odd", None, None), (101, "v", None, "x", 1.0), (102, "v", "bad", "x", 1.0), (103, "v", "empty", "x", 1.0)]

    def model(prompt):
        if '"bad"' in prompt:
            raise RuntimeError
        if '"empty"' in prompt:
            return "{}"
        if '"t"' in prompt:
            assert prompt.count("\n- ") == 50 and "claim 59" in prompt and "claim 9 " not in prompt
        return '{"stance": "Warning", "consensus_score": 1}'

    got = {r.topic: tuple(r[1:]) for r in RT.stances(spark.createDataFrame(rows, "claim_id long, video_id string, topic string, claim_text string, confidence double"), model).collect()}
    assert got == {"t": (50, "Warning", 1.0, None), "odd": (1, "Warning", 1.0, None), "bad": (1, "Error", 0.0, None), "empty": (1, "Inconclusive", 0.5, None)}
