"""The pipeline on a small table of planted cases, against plain Python; every query on the smallest tables."""

import os

import pytest

import corpus_pipeline
from lodestone.llm import op03_lines, op07_decontaminate
from lodestone.llm.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture
def planted(spark, tmp_path):
    import random

    rng = random.Random(4)
    vocabulary = {"en": "the of and to in that with for house river".split(), "fr": "le de et la dans que avec pour maison fleuve".split()}
    item = " ".join(f"bench{i}" for i in range(20))

    def text(lang, n=120):
        return "\n".join(" ".join(rng.choices(vocabulary[lang], k=20)) + " x%d." % rng.randrange(10**9) for _ in range(n // 20))

    rows = [(i, text("en" if i % 2 else "fr"), "en" if i % 2 else "fr", "s", 1) for i in range(40)]
    rows += [(100, rows[3][1], "en", "s", 1), (101, "12 34 !!", "en", "s", 1), (102, None, None, "s", 1), (103, text("en") + "\nIntro " + item.upper() + " end", "en", "s", 1)]
    rows += [(104, rows[5][1].split("\n")[0] + "\n" + rows[5][1].split("\n")[1] + "\nthe house of the river that is mine", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows, [(7, item)]


def test_stages(spark, planted):
    sf_dir, rows, items = planted
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.schema == docs.schema
            from lodestone.llm import shared

            docs = shared.written(out, "stage")
        kept[name] = {r.doc_id: r for r in out.collect()}
    assert set(kept["language_id"]) == {r[0] for r in rows} - {101, 102}
    lines = sorted((r[0], r[1]) for r in rows if r[0] in kept["language_id"])
    want = {d: t for (d, _), (n, gone, t) in zip(lines, op03_lines.brute_force(lines, 2, 50)) if not gone or gone < n}
    assert {d: r.text for d, r in kept["line_dedup"].items()} == want
    assert 100 not in want and want[104] == "the house of the river that is mine"
    assert set(kept["near_dedup"]) == set(want)
    hits = op07_decontaminate.brute_force([want[d] for d in sorted(want)], items)
    assert set(kept["decontaminate"]) == {d for d, h in zip(sorted(want), hits) if not h[1]} == set(want) - {103}
    assert set(kept["encode"]) == set(kept["decontaminate"])
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()} == {d: r.ids_sha256 for d, r in kept["encode"].items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    out = QUERIES[name](spark, SF)
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    if name in ("op11_search", "op13_negatives"):  # searches: their whole results are compared with SQL below
        assert out.count() > 0
    elif name == "op12_neighbours":
        assert out.count() == 20 * read("embeddings").filter("vec_id % 20 = 0").count()
    else:
        assert out.count() == read("pages" if name == "op6_html" else "documents").count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SQL)
def test_sql(spark, name):
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__))))
    from compare import connection, same

    same(QUERIES[name](spark, SF), connection(SF), SQL[name])


def test_stages_odd_tables(spark, tmp_path):
    """Clashing names of other columns, null ids and texts, repeated rows, and empty tables go through every stage."""
    sf_dir = str(tmp_path)
    spark.createDataFrame([(7, " ".join(f"bench{i}" for i in range(20)))], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, SCORE double, lang_pred string, n_lines int, n_removed int, __id int, `row` string, `a.b` int, fingerprint string, rid long, block int, n_chars int"
    own = (1.5, "x", 3, 4, 5, "r", 6, "f", 8, 9, 10)
    english = "the house of the river and the garden of the king with a long road to the sea"
    rows = [(i, f"{english} number {i}\nand some line {i * 7}", "en", *own) for i in range(30)]
    rows += [(3, rows[3][1], "en", *own), (None, "no id at all but the words of the house", "en", *own), (None, None, None, *own), (50, "", "en", *own), (51, None, None, *own)]
    frame = spark.createDataFrame(rows, schema)
    for docs in (frame, frame.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
                assert all(tuple(r)[3:-1] == own[:-1] for r in out.collect())
            else:
                assert out.count() <= docs.count()
