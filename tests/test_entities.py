"""Greedy merges and sampled pairs against plain loops."""

import random

import pytest

from lodestone.operators import entities as E


@pytest.mark.parametrize("seed", range(4))
def test_merge_plan_equals_loop(spark, seed):
    rng = random.Random(seed)
    n = 60
    guests = [(i, rng.choice([1, 5, 9]) if seed else n - i) for i in range(n)]
    pairs = [(a, b, rng.choice([0.85, 0.9, 1.0])) for a, b in (rng.sample(range(n), 2) for _ in range(120))]
    if not seed:  # a chain: as many rounds as links
        pairs = [(i, i + 1, 0.9) for i in range(n - 1)]
    for most in (1, 4):
        plan = E.merge_plan(spark.createDataFrame(guests, "guest_id long, mention_count long"), spark.createDataFrame(pairs, "guest_id long, other_id long, ratio double"), most)
        assert {r.id: r.survivor for r in plan.collect()} == E.sequential_plan(guests, pairs, most)


def test_merge_plan_without_pairs(spark):
    guests = spark.createDataFrame([(1, 1)], "guest_id long, mention_count long")
    assert E.merge_plan(guests, spark.createDataFrame([], "guest_id long, other_id long, ratio double")).count() == 0


def test_chain_of_names(spark):
    """A is like B, B like C, C like D, and no others: A takes in B and C takes in D."""
    names = ["abcdefghijkl", "abcdefghijkx", "abcdefghiyzx", "abcdefhiyzxw"]
    guests = spark.createDataFrame([(i, n, 10 - i) for i, n in enumerate(names)], "guest_id long, canonical_name string, mention_count long")
    alike = {(r.guest_id, r.other_id) for r in E.fuzzy_pairs(guests, 0.8).collect()}
    assert alike == {(0, 1), (1, 2), (2, 3)}
    assert {r.id: r.survivor for r in E.fuzzy_merge_plan(guests, 0.8).collect()} == {1: 0, 3: 2}


def test_drawn():
    assert E.drawn(3, 5, 1) == [0, 1, 2] and E.drawn(0, 5, 1) == []
    assert len(set(E.drawn(10, 9, 4))) == 9 and E.drawn(100, 5, 1) == E.drawn(100, 5, 1) != E.drawn(100, 5, 2)


def test_bridge_pairs(spark):
    """Pairs cross categories, none is left out, and over seeds each has its share."""
    topics = [("a", f"a{i}") for i in range(6)] + [("b", "b0"), ("c", "c0"), ("c", "c1"), ("UNCLASSIFIED", "u"), (None, "n"), ("a", None), ("a", "a0"), ("b", "c0")]
    frame = spark.createDataFrame(topics, "category string, name string")
    whole = {frozenset((r.topic_a, r.topic_b)) for r in E.bridge_pairs(frame, limit=1000).collect()}
    known = {(c, n) for c, n in topics if c not in (None, "UNCLASSIFIED") and n}
    assert whole == {frozenset((x, y)) for c, x in known for d, y in known if c < d and x != y}
    first = [E.bridge_pairs(frame, seed=s, limit=3).collect() for s in range(2)]
    assert all(len(r) == 3 for r in first) and first[0] != first[1]
    counts = [0] * 40
    for seed in range(4000):
        for value in E.drawn(40, 3, seed):
            counts[value] += 1
    assert 220 < min(counts) and max(counts) < 380  # 300 each
    assert E.bridge_pairs(frame.filter("category = 'a'")).count() == 0
