"""Operator 5 against pairwise comparison of fingerprints made by the xxhash library."""

import random

import numpy as np
import pytest

from lodestone.llm import op05_simhash as op


def brute(text, shingle=4):
    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lower.encode().split()
    shingles = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def texts():
    rng = random.Random(5)
    base = [" ".join(rng.choices("alpha beta Gamma délta eps zeta eta theta".split(), k=k)) for k in (3, 40, 400, 900)]
    out = [None, "", " \n", "one", "One", "É ñ 漢字 x y z"] + base
    for text in base[2:]:
        for _ in range(40):
            words = text.split()
            words[rng.randrange(len(words))] = "new" + str(rng.random())
            out.append(" ".join(words))
    return out + base


def test_classes_equal_brute_force(spark):
    docs = texts()
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(docs)], "doc_id long, text string, fingerprint double")
    prints = [brute(t) for t in docs]
    want = classes(prints)
    got = op.near_duplicates(frame).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]
    assert len(set(want)) < len(docs) - 20


@pytest.mark.parametrize("hot", [3, 50_000])
def test_links_of_crowded_keys(spark, hot):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    prints = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(100 if c == centres[0] else 6):
            x = c
            for b in rng.integers(0, 64, rng.integers(1, 7)).tolist():
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = op.near_links(spark.createDataFrame([(x,) for x in signed], "fingerprint long"), 4, hot)
    got = {r.node: r.root for r in op.components(links).collect()}
    want = classes(prints)
    groups = {}
    for x, w in zip(signed, want):
        groups.setdefault(w, set()).add(x)
    for g in groups.values():
        assert {got.get(x, x) for x in g} == {min(g)}


def test_empty(spark):
    assert op.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def similar_classes(docs):
    def cut(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [cut(t) for t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (not sets[i] and not sets[j]) or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {root(i) for i in range(len(docs))}


def test_keep_one_of_similar_texts(spark):
    rng = random.Random(8)
    docs = texts()
    for k in (60, 150, 600):
        base = [rng.choice("abcdefgh") + str(rng.randrange(3000)) for _ in range(k)]
        docs.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(max(1, k // 100)):
                copy[rng.randrange(k)] = "edit" + str(rng.random())
            docs.append(" ".join(copy))
    docs += [docs[9], docs[60].upper()]
    frame = spark.createDataFrame([(i, t, "a") for i, t in enumerate(docs)] + [(9, docs[9], "a"), (None, docs[9], "a")], "doc_id long, text string, head string")
    kept = [r.doc_id for r in op.keep_one(frame).collect()]
    want = similar_classes(docs)
    assert kept.count(None) == 1 and sorted(x for x in kept if x is not None) == sorted(want)
    assert op.keep_one(frame.limit(0)).count() == 0


def test_keep_one_finds_added_and_cut_passages(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(3000))
    docs = []
    for k in (30, 100, 300, 1000):
        for _ in range(15):
            base = [word() for _ in range(k)]
            docs += [" ".join(base), " ".join(base + [word() for _ in range(int(k * 0.2))]), " ".join(base[int(k * 0.15) :])]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in op.keep_one(frame).collect()) == sorted(similar_classes(docs))


@pytest.mark.parametrize("partners", [1, 8])
def test_keep_one_of_a_crowd_of_near_copies(spark, monkeypatch, partners):
    monkeypatch.setattr(op, "PARTNERS", partners)
    monkeypatch.setattr(op, "GROWTH", 2 if partners == 1 else op.GROWTH)
    rng = random.Random(11)
    base = [rng.choice("abcdefgh") + str(rng.randrange(3000)) for _ in range(300)]
    docs = []
    for k in range(300):
        copy = list(base)
        for at in rng.sample(range(300), 1 + k % 7 + 3 * (k % 2)):
            copy[at] = "edit" + str(rng.random())
        docs.append(" ".join(copy))
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert sorted(r.doc_id for r in op.keep_one(frame).collect()) == sorted(similar_classes(docs))


def test_equal_prints_lose_no_pair(spark):
    """Of three texts with one SimHash, two are similar: the third, whichever comes first, doesn't hide it."""
    a = "x " * 1000 + " ".join(f"tail{i}" for i in range(30))
    b = "x " * 1000 + " ".join(f"end{i}" for i in range(30))
    c = b[: b.rindex(" ")] + " changed"
    rows = [(1, a), (2, b), (3, c)]
    sets = [set(x.tolist()) for x in op.shingle_sets([t.encode() for _, t in rows], 5)]
    assert len(sets[1] & sets[2]) >= 0.8 * len(sets[1] | sets[2]) and len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])
    assert sorted(r.doc_id for r in op.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 2]


def test_parities_bound_the_difference(spark):
    """Differing bits never exceed the shingles that one set alone has, whatever the sets' sizes."""
    from pyspark.sql import functions as F

    rng, rows, want = np.random.default_rng(1), [], []
    for n in (0, 1, 63, 64, 65, 200, 1000, 1025, 5000):
        for share in (0.0, 0.05, 0.11):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            cut = int(n * share)
            b = np.unique(np.concatenate((a[cut:], rng.integers(0, 1 << 63, cut // 2, dtype=np.uint64))))
            rows.append((op.wide_parity(np.unique(a)).tolist(), op.wide_parity(b).tolist()))
            want.append(len(np.setxor1d(a, b)))
    got = [r.d for r in spark.createDataFrame(rows, "a array<long>, b array<long>").coalesce(1).select(op.differing(F.col("a"), F.col("b")).alias("d")).collect()]
    assert all(d <= w for d, w in zip(got, want)) and all(2 * d >= w for d, w in zip(got, want))
