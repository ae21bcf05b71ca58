"""Operator 1: files against the tokenizers library, the perfect hash, keyed access."""

import zlib

import numpy as np
import pytest

from lodestone.llm import op01_tokens as op

P = pytest.importorskip("public_tokenizers")


def test_perfect_hash():
    for n in (0, 1, 2, 63, 5000):
        keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.uint64)
        table = op.PerfectHash.build(keys)
        assert sorted(table.slots(keys).tolist()) == list(range(n))
        foreign = np.arange(1 << 41, (1 << 41) + 500, dtype=np.uint64)
        slots = table.slots(foreign)
        assert ((slots >= -1) & (slots < max(n, 1))).all()


@pytest.mark.parametrize("size", [40, 4 << 20])
def test_store(spark, tmp_path, size, monkeypatch):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    own.no_truncation(), own.no_padding()
    texts = [None, "", " ", "\n", "a", "The CAT's hat, isn't 12 hats!! don't.", "é é x ̈y", "x<|endoftext|>y <|startoftext|>", "İstanbul ΣΑΣ ß ﬁ ²", "漢字かな 😀", "a\tb\r\nc d e", "it's_a_test &&& abc&&& 'tis '", "w" * 5000, "\x00 \x1c a\x1cb"] + ["Hello world number %d" % i for i in range(40)]
    rows = [(i * 7 % 53 - 5, t, "x", 3) for i, t in enumerate(texts)]
    rows += [rows[5], (rows[5][0], "another", "x", 1), (None, "no id", "x", 0)]
    path = str(tmp_path / "store")
    monkeypatch.setattr(op, "SHARD_IDS", size)
    frame = spark.createDataFrame(rows, "doc_id long, text string, value string, start long").repartition(5)
    op.write_store(frame, path, P.path("word_bpe_49k.json"))
    got = sorted(op.with_starts(op.read_store(spark, path)).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    want = {}
    for d, t, *_ in rows:
        want.setdefault(d, []).append([*own.encode(t or "", add_special_tokens=False).ids, 1])
    assert [r.doc_id for r in got] == sorted((d for d, *_ in rows), key=lambda d: (d is not None, d))
    start = 0
    for r in got:
        want[r.doc_id].remove(r.ids)
        assert r.start == start and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    keys = [rows[5][0], rows[7][0], 10_000]
    index = op.index_store(spark, path)
    assert sorted(r.doc_id for r in op.lookup(spark, path, keys, index).collect()) == sorted([keys[0]] * 3 + [keys[1]])
    assert op.lookup(spark, path, [10_000], index).count() == 0
    found = op.lookup(spark, path, keys).collect()
    assert sorted(r.doc_id for r in found) == sorted([keys[0]] * 3 + [keys[1]])
    store = op.TokenStore(path)
    for d, t, *_ in rows[:30]:
        assert [*own.encode(t or "", add_special_tokens=False).ids, 1] in [x.tolist() for x in store.get(d)]
    assert len(store.get(keys[0])) == 3 and store.get(10_000) == store.get(-10_000) == []
    assert [r.ids for r in found if r.doc_id == keys[1]] == [[*own.encode(rows[7][1], add_special_tokens=False).ids, 1]]


def test_words():
    """Ids of random texts against the library, with letters that normalisation turns into letters and marks, and small caches."""
    import random

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    own.no_truncation(), own.no_padding()
    rng = random.Random(3)
    bits = [*"aBcdeİıßŞǅéñÇ漢字かΣσςﬁ²½٣", "\u0307", "\u0301", "e\u0301", "'s", "'LL", "'", ".", "!!", "&", "_", "<|endoftext|>", "<|", "|>", "7", "12", "\u00a0", "\t", "\u2003", "\x00", "😀", "\u200d", "-", ",", "?"]
    texts = ["BELEDİYESİ.", "İ.", "İ!! İ", "aİ_b", "k\u0301. ", " lead", "trail ", "a  b", "\n\n"]
    texts += ["".join(rng.choices(bits, k=rng.randrange(1, 9))) for _ in range(20_000)]
    texts += [" ".join("".join(rng.choices(bits, k=rng.randrange(1, 5))) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for slots, kept in ((1 << 20, 1 << 20), (16, 1000), (1, 1)):
        encoder = op.WordEncoder(P.path("word_bpe_49k.json"))
        encoder.SLOTS, encoder.KEPT = slots, kept
        encoder._anew()
        for at in range(0, len(texts), 5000):
            part = texts[at : at + 5000]
            ids, counts = encoder.encode([x.encode() for x in part], [1])
            for text, run in zip(part, np.split(ids, np.cumsum(counts)[:-1])):
                assert run.tolist() == [*own.encode(text, add_special_tokens=False).ids, 1], text
    assert [list(op.pieces(x, 3)) for x in (b"aa bb cc dd", b"", b"x" * 9)] == [[b"aa bb", b"cc dd"], [b""], [b"x" * 9]]


def test_long_text(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    own.no_truncation(), own.no_padding()
    monkeypatch.setattr(op, "LONG", 1000)
    text = "Hello world, it's number 12.\n" * 60_000
    path = str(tmp_path / "store")
    op.write_store(spark.createDataFrame([(2, text), (1, "a")], "doc_id long, text string"), path, P.path("word_bpe_49k.json"))
    store = op.TokenStore(path)
    assert store.get(2)[0].tolist() == [*own.encode(text, add_special_tokens=False).ids, 1]


def test_hot_id(spark, tmp_path, monkeypatch):
    """Rows of one id over several shards and partitions."""
    monkeypatch.setattr(op, "SHARD_IDS", 30)
    rows = [(7, f"text number {i}") for i in range(200)] + [(i, "other") for i in range(5)] + [(9, "z")]
    path = str(tmp_path / "store")
    op.write_store(spark.createDataFrame(rows, "doc_id long, text string"), path, P.path("word_bpe_49k.json"))
    found = op.with_starts(op.read_store(spark, path)).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted(r[0] for r in rows)
    assert [r.start for r in found] == [sum(x.n_tokens for x in found[:i]) for i in range(len(found))]
    store = op.TokenStore(path)
    assert len(store.get(7)) == 200 and len(store.get(9)) == 1 and store.get(8) == []
    assert op.lookup(spark, path, [7], op.index_store(spark, path)).count() == 200


def test_empty(spark, tmp_path):
    path = str(tmp_path / "store")
    op.write_store(spark.createDataFrame([], "doc_id long, text string"), path, P.path("word_bpe_49k.json"))
    assert op.with_starts(op.read_store(spark, path)).count() == 0
