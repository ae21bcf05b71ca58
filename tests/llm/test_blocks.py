"""Operators 2 and 4 against the tokenizers library and a dictionary of windows."""

import hashlib

import pytest

from lodestone.llm import op02_bpe, op04_substrings

P = pytest.importorskip("public_tokenizers")

ODD = ["", None, " ", "\n", "a", "a b", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \n b", "a\t b", "a\xa0b", "a\xa0 \xa0b c", "it's 's we'll", "x<|endoftext|> y", "ünï çödé 漢字 😀", " ", "a\x1cb ,\x1cb", "don't  stop\r\n now", "1234 5,6", "é ̈ x", "\x00 \x00a", "_a _ a_b", "wordword" * 300]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, block string")


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.no_truncation(), own.no_padding()
    texts = ODD + ODD[5:9] + ["The quick brown fox, it's $100!\nNew line"] * 3
    got = {r.doc_id: r for r in op02_bpe.encode_documents(frame(spark, texts), path).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = own.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids), repr(text)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded == own.decode(ids, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest()
    back = op02_bpe.decode_ids(op02_bpe.encode_documents(frame(spark, texts), path), path)
    assert {r.doc_id: r.text for r in back.collect()} == {i: r.decoded for i, r in got.items()}


def test_bpe_of_random_strings(spark):
    """Added tokens after every kind of white space, and random strings, against the library."""
    import random

    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.no_truncation(), own.no_padding()
    rng = random.Random(8)
    space = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " \n", "\n ", "\x0b", "\x0c", "\xa0", "\u3000", "\u2028", "\x1c", "\x85"]
    parts = [*space, "<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", "a", "It's", "we'll", "12", "é", "漢", "\U0001f600", "!?", "\u0301"]
    texts = [f"a{s}{t}{'<|endoftext|>'}{u}b" for s in space for t in ("", " ", "\n") for u in ("", *space)]
    texts += ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(20_000)]
    got = {r.doc_id: r.ids for r in op02_bpe.encode_documents(frame(spark, texts), path).select("doc_id", "ids").collect()}
    wrong = [t for i, (t, e) in enumerate(zip(texts, own.encode_batch(texts, add_special_tokens=False))) if got[i] != e.ids]
    assert not wrong, (len(wrong), wrong[:3])


def test_bpe_empty_table(spark):
    assert op02_bpe.encode_digests(frame(spark, []).limit(0), P.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("size", [1, 3, 35])
def test_substrings_equal_brute_force(spark, size):
    import random

    rng = random.Random(size)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = ODD + [" ".join(rng.choices("abcdefgh", k=rng.randrange(90))) for _ in range(60)]
    texts += [f"x{i} {passage} y{i}" for i in range(5)] + [passage] * 3 + [passage + " " + passage, "z " * 80]
    got = op04_substrings.dedup_substrings(frame(spark, texts), size).collect()
    want = op04_substrings.brute_force(texts, size)
    for r in got:
        assert (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) == want[r.doc_id], texts[r.doc_id]
        assert sum(x.end - x.start for x in r.removed) == r.n_removed
    assert len(got) == len(texts)


def test_substrings_empty_table(spark):
    assert op04_substrings.dedup_substrings(frame(spark, []).limit(0)).count() == 0
