"""Operator 3 against dictionaries of whole runs."""

import random

import pytest

from lodestone.llm import op03_lines as op


@pytest.mark.parametrize(("run", "words"), [(2, 50), (3, 6), (2, 3)])
def test_lines_equal_brute_force(spark, run, words):
    rng = random.Random(run * words)
    pool = [" ".join(rng.choices("ab cd ef gh ij".split(), k=rng.choice((1, 2, 4, 8, 60)))) for _ in range(25)]
    texts = [None, "", "\n", " \n ", "x", pool[0], "\n".join(pool), "\n".join(pool)]
    texts += ["\n".join(rng.choice(["", *pool]) for _ in range(rng.randrange(12))) for _ in range(80)]
    texts += ["a\na\na\na", "q\n\n  w \ne", "q\nw\ne", "one\n" + "\n".join(pool[3:9]) + "\ntwo"]
    ids = [i if i < len(texts) - 1 else None for i in range(len(texts))]
    frame = spark.createDataFrame(list(zip(ids, texts, ["k"] * len(ids), range(len(ids)))), "doc_id long, text string, block string, `n lines` long").repartition(5)
    got = sorted(op.dedup_lines(frame, run, words).collect(), key=lambda r: r["n lines"])
    want = op.brute_force(list(zip(ids, texts)), run, words)
    assert [(r.n_lines, r.n_removed, r.text) for r in got] == want
    assert got[-1].doc_id is None and {r.block for r in got} == {"k"}


def test_repeated_rows_and_empty(spark):
    frame = spark.createDataFrame([(1, "a\nb\nc", "x")] * 3, "doc_id long, text string, lang string")
    got = sorted(r.text for r in op.dedup_lines(frame).collect())
    assert got == ["", "", "a\nb\nc"]
    assert op.dedup_lines(frame.limit(0)).count() == 0
