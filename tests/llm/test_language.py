"""Operator 10: costs against a direct computation, held-out accuracy, odd rows."""

import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import op10_language as op


def direct_bits(trained, text, order):
    """PPM code length by dictionaries. trained, text: normalised bytes."""
    counts = Counter()
    for t in trained:
        for i in range(len(t)):
            for o in range(order + 1):
                counts[(t[:i].rjust(order, b" "))[len(t[:i].rjust(order, b" ")) - o :] if o else b"", t[i]] += 1
    total, kinds = Counter(), Counter()
    for (c, _), n in counts.items():
        total[c] += n
        kinds[c] += 1
    bits = 0.0
    for i in range(len(text)):
        past = text[:i].rjust(order, b" ")
        for o in range(order, -2, -1):
            if o < 0:
                bits += 8
                break
            c = past[len(past) - o :] if o else b""
            if counts[c, text[i]]:
                bits -= math.log2(counts[c, text[i]] / (total[c] + kinds[c]))
                break
            if total[c]:
                bits -= math.log2(kinds[c] / (total[c] + kinds[c]))
    return bits


def test_costs_equal_direct_computation(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and the hat", "en"), ("le chat est là", "fr"), ("the dog", "en"), ("la maison", "fr")] * 6)]
    model = op.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 3)
    held = {r.doc_id for r in spark.range(len(rows)).filter(op.held_out(F.col("id"))).select(F.col("id").alias("doc_id")).collect()}
    for text in ("the hat", "là est", "zz", "a", "chat the"):
        got = model.lengths([b"xx", text.encode(), b""])[1]
        for lang, bits in zip(model.languages, got):
            want = direct_bits([t.encode() for i, t, l in rows if l == lang and i not in held], text.encode(), 3)
            assert abs(bits - want) < 1e-3 * max(1, want)


def test_odd_rows_and_languages(spark):
    rows = [(i, ("der und die " if i % 2 else "the and of ") * 5, "de" if i % 2 else "en") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 ...", None), (103, "THE AND", None), (104, "²", "en"), (105, "der und " * 20_000, None), (None, "the and of", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in op.predict(frame, op.learn(frame)).collect()}
    assert len(got) == len(rows)
    assert [got[i].lang_pred for i in (100, 101, 102, 103, 104, 105, None)] == ["und", "und", "und", "en", "und", "de", "en"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[100].score == 0
    carried = op.predict(frame, op.learn(frame), carry=True)
    assert carried.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and carried.count() == len(rows)
    empty = frame.limit(0)
    assert op.learn(empty) is None and op.predict(empty, None).count() == 0
    assert {r.lang_pred for r in op.predict(frame, None).collect()} == {"und"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op.predict(docs, op.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
