"""Best snippets and interval joins against plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import relational as R
from lodestone.plans import search as S


@pytest.mark.parametrize(("phrases", "width"), [([["a"]], 5), ([["a", "b"], ["c"]], 6), ([["e"], ["a", "a"]], 3), ([["zz"]], 30), ([["c", "d", "e"], ["a"], []], 30)])
def test_best_snippet(spark, phrases, width):
    rng = random.Random(3)
    texts = [None, "", "a", " ..A, b!", "É a-b c", "x " * 40 + "a b", "a b " + "x " * 40, "...", "a a a a"] + ["".join(rng.choice(["a", "b", "C", "d", "é", "xx"]) + rng.choice([" ", " ", ", ", "\n", " - "]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in frame.select("i", S.best_snippet(F.col("t"), phrases, width).alias("s")).collect()}
    assert got == {i: S.plain_snippet(t, phrases, width) for i, t in enumerate(texts)}


def test_snippet_of_long_text(spark):
    text = "the end of it " * 30_000
    began = time.time()
    got = spark.createDataFrame([(text,)], "t string").select(S.best_snippet(F.col("t"), [["the"], ["of", "it"]], 8).alias("s")).first().s
    assert got == "<b>the</b> end <b>of it the</b> end <b>of it</b>..." and time.time() - began < 90


def test_no_phrases(spark):
    assert spark.range(1).select(S.best_snippet(F.lit("a b"), [[]]).alias("s")).first().s is None


@pytest.mark.parametrize("width", [1.0, 7.5, 1000.0])
def test_overlaps(spark, width):
    rng = random.Random(2)
    span = lambda: (lambda a: (a, a + rng.choice([0.0, 0.5, 3.0, 40.0])))(rng.choice([rng.uniform(-20, 100), float(rng.randrange(100))]))
    chunks = [(f"c{i}", rng.choice(["v", "w", None]), *span()) for i in range(80)] + [("n", "v", None, 3.0)]
    heat = [(rng.choice(["v", "w", "x", None]), *span(), i / 80) for i in range(80)] + [("v", 1.0, None, 0.1)]
    got = R.overlaps(spark.createDataFrame(chunks, "chunk_id string, video_id string, start_timestamp double, end_timestamp double"), spark.createDataFrame(heat, "video_id string, start double, end double, score double"), width)
    want = [(c, s) for c, v, a, b in chunks for w, x, y, s in heat if v is not None and v == w and None not in (a, b, x, y) and x <= b and y >= a]
    assert sorted((r.chunk_id, r.score) for r in got.collect()) == sorted(want) and "__bin" not in got.columns


def test_stripped_segments(spark):
    rng = random.Random(5)
    segments = [("v", float(i), 2.0, i) for i in range(100)] + [("w", 5.0, 1.0, 100), (None, 1.0, 1.0, 101), ("v", None, 1.0, 102)]
    skips = [("v", a, a + rng.uniform(0, 9)) for a in (3.0, 40.0, 44.5, 80.0)] + [("v", 10.0, 10.0), ("x", 0.0, 99.0), ("v", None, 5.0)]
    got = R.strip_intervals(spark.createDataFrame(segments, "video_id string, start double, duration double, n int"), spark.createDataFrame(skips, "video_id string, start double, end double"), 5.0)
    want = {n for v, s, d, n in segments if v is None or s is None or not any(v == w and None not in (a, b) and a <= s + d / 2 <= b for w, a, b in skips)}
    assert {r.n for r in got.collect()} == want and got.columns == ["video_id", "start", "duration", "n"]


def test_many_intervals_of_one_video(spark):
    """A video of 100,000 intervals and chunks: pairs are made by bins, not all with all."""
    n = 100_000
    chunks = spark.range(n).select(F.col("id").cast("string").alias("chunk_id"), F.lit("v").alias("video_id"), (F.col("id") * 10.0).alias("start_timestamp"), (F.col("id") * 10.0 + 9).alias("end_timestamp"))
    heat = spark.range(n).select(F.lit("v").alias("video_id"), (F.col("id") * 10.0 + 2).alias("start"), (F.col("id") * 10.0 + 3).alias("end"), F.lit(1.0).alias("score"))
    began = time.time()
    assert R.overlaps(chunks, heat).count() == n and time.time() - began < 60
