"""Operators that ask a model for many rows at once, with stand-ins that fail in every way."""

import json

from lodestone.functions.triage import batch_triage
from lodestone.operators import taxonomy as T

KIND = "video_id string, title string, description string, duration_seconds int, tags array<string>, title_ string"


def videos(spark, ids):
    return spark.createDataFrame([(i, f"t{i}", "d" * 500, 70, ["a", "b"] if i and len(i) % 2 else None, "x") for i in ids], KIND)


def test_batches_are_packed(spark, tmp_path):
    """No prompt holds more rows or characters than it may; every id is asked once."""
    log = tmp_path / "log"
    log.mkdir()

    def model(prompt):
        import uuid

        (log / uuid.uuid4().hex).write_text(prompt)
        assert "DESCRIPTION: " + "d" * 300 + "\n" in prompt and "d" * 301 not in prompt
        return json.dumps({line[4:]: {"category": "KNOWLEDGE", "confidence": 0.7} for line in prompt.split("\n") if line.startswith("ID: ")})

    out = batch_triage(videos(spark, [str(i) for i in range(50)] + ["1", None]), model, most=7, characters=2500)
    assert {r.triage_status for r in out.collect() if r.video_id} == {"ACCEPTED"} and out.count() == 52
    log2 = [p.read_text() for p in log.iterdir()]
    assert max(p.count("ID: ") for p in log2) <= 7 and max(map(len, log2)) <= 2500
    open_row = [r for r in out.collect() if r.video_id is None][0]
    assert (open_row.triage_status, open_row.triage_reason, open_row.is_tutorial) == ("PENDING_REVIEW", "llm_batch_missing_id", False)


def test_bad_replies(spark):
    def model(prompt):
        ids = [line[4:] for line in prompt.split("\n") if line.startswith("ID: ")]
        if "boom" in ids:
            raise RuntimeError("x" * 90)
        if "list" in ids:
            return "[]"
        return json.dumps({i: {"n": {"category": "NOISE", "confidence": "0.9", "is_tutorial": 1, "reason": "r"}, "odd": 5, "low": {"category": "KNOWLEDGE", "confidence": 0.69}}[i] for i in ids if i != "gone"})

    got = {r.video_id: (r.triage_status, r.triage_reason, r.triage_confidence, r.is_tutorial) for r in batch_triage(videos(spark, ["n", "boom", "list", "gone", "odd", "low"]), model).collect()}
    assert got["n"] == ("REJECTED", "r", 0.9, True) and got["low"] == ("PENDING_REVIEW", "llm_classification", 0.69, False)
    assert got["gone"] == ("PENDING_REVIEW", "llm_batch_missing_id", 0.0, False)
    assert got["boom"] == ("PENDING_REVIEW", "llm_batch_error: " + "x" * 50, 0.0, False)
    assert got["list"][1] == "llm_batch_error: reply is no object" and got["odd"][1].startswith("llm_batch_error: ")
    assert batch_triage(videos(spark, []), model).count() == 0


def edges(spark, rows):
    return spark.createDataFrame(rows, "child string, parent string")


def pairs(df):
    return {(r.child, r.parent) for r in df.select("child", "parent").collect()}


def test_numbered(spark):
    names = [f"n{i:03}" for i in range(100)]
    frame = spark.createDataFrame([(n,) for n in names + names[:3]] + [(None,)], "name string")
    assert {r.name: r.number for r in T.numbered(frame).collect()} == {n: i for i, n in enumerate(names)}
    got = sorted(T.batches(frame, 30).collect())
    assert [r.names for r in got] == [names[i : i + 30] for i in range(0, 100, 30)]
    assert T.numbered(frame.limit(0)).count() == 0


def test_taxonomy_refuses_cycles(spark):
    """Edges on a cycle go, whether old edges or new ones close it; old edges stay; one of each."""
    old = edges(spark, [("b", "a"), ("b", "a"), ("c", "b")])
    said = [("a", "c"), ("d", "c"), ("e", "f"), ("f", "e"), ("f", "d"), ("g", "g"), ("h", "zz"), ("c", "b"), (" D ", "C")]
    topics = spark.createDataFrame([(c,) for c in "abcdefgh"], "name string")
    got = T.build(topics, old, lambda names: "```json\n" + json.dumps([{"child": c, "parent": p} for c, p in said]) + "\n```")
    assert pairs(got) == {("b", "a"), ("c", "b"), ("d", "c"), ("f", "d")} and got.count() == 4
    few = topics.limit(3)
    assert pairs(T.build(few, old, None)) == {("b", "a"), ("c", "b")}

    def fails(names):
        raise RuntimeError

    assert pairs(T.build(topics, old, fails)) == pairs(T.build(topics, old, lambda names: "{}")) == {("b", "a"), ("c", "b")}


def test_ancestors(spark):
    """The least number of steps, also over a diamond and around a cycle."""
    graph = edges(spark, [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "y"), ("y", "x")])
    up = {(r.topic, r.ancestor): r.depth for r in T.ancestors(graph).collect()}
    assert up == {("d", "b"): 1, ("d", "c"): 1, ("d", "a"): 1, ("b", "a"): 1, ("c", "a"): 1, ("x", "y"): 1, ("y", "x"): 1}
    chain = edges(spark, [(f"n{i}", f"n{i + 1}") for i in range(6)])
    down = {(r.topic, r.descendant): r.depth for r in T.descendants(chain, most=3).collect()}
    assert down == {(f"n{i}", f"n{j}"): i - j for i in range(7) for j in range(i) if i - j <= 3}
