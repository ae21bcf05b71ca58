"""The stream of listings: offsets, restarts, duplicates, bad lines."""

import datetime as dt
import json

import pytest

from lodestone.sources import discovery as D


@pytest.fixture
def listings(spark, tmp_path):
    spark.dataSource.register(D.DiscoverySource)
    folder = tmp_path / "listings"

    def add(scan, lines):
        (folder / f"scan={scan}").mkdir(parents=True)
        (folder / f"scan={scan}" / "a.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), encoding="utf-8")

    return str(folder), add


def line(i, date="20240101", channel="c"):
    return {"id": i, "title": f"t {i} é", "channel_id": channel, "upload_date": date}


def run(spark, folder, tmp_path, **kw):
    stream = spark.readStream.format("vault_discovery").option("progress", str(tmp_path / "progress")).option("maxFiles", kw.pop("most", 1000)).load(folder)
    query = D.discovered(stream, **kw).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()


def test_each_id_once_over_restarts(spark, tmp_path, listings):
    folder, add = listings
    known = spark.createDataFrame([("b",)], "video_id string")
    add("001", [line("a"), line("b"), "not json", line("a"), "", json.dumps({"title": "x"}), "[1]", line(" ")])
    run(spark, folder, tmp_path, videos=known)
    add("002", [line("b"), line("c"), "not json"])
    add("003", [line("c"), line("d")])
    run(spark, folder, tmp_path, videos=known)
    run(spark, folder, tmp_path, videos=known)  # nothing new
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.video_id, r.is_new) for r in rows if not r.problem) == [("a", True), ("b", False), ("c", True), ("d", True)]
    assert sorted((r.problem, r.raw) for r in rows if r.problem) == [("no_id", json.dumps(line(" "))), ("no_id", '{"title": "x"}'), ("no_json", "[1]"), ("no_json", "not json"), ("no_json", "not json")]
    assert {r.upload_date for r in rows if r.video_id} == {dt.date(2024, 1, 1)}


def test_admission(spark, tmp_path, listings):
    """A run with a limit takes so many files and the next goes on after them."""
    folder, add = listings
    for n in range(5):
        add(f"{n:03}", [line(f"v{n}")])
    for want in (2, 4, 5, 5):
        run(spark, folder, tmp_path, most=2)
        assert spark.read.parquet(str(tmp_path / "out")).count() == want


def test_slices_and_batch(spark, tmp_path, listings):
    folder, add = listings
    add("001", [line(f"v{i}", f"202401{i % 28 + 1:02}", f"c{i % 2}") for i in range(300)])
    read = spark.read.format("vault_discovery").option("sliceBytes", 777).load(folder)
    assert read.rdd.getNumPartitions() > 10
    assert {r.video_id for r in D.discovered(read).collect()} == {f"v{i}" for i in range(300)} and D.discovered(read).count() == 300
    marks = spark.createDataFrame([("c0", dt.date(2024, 1, 10)), ("c0", dt.date(2024, 1, 15))], "channel_id string, mark date")
    assert {r.video_id for r in D.discovered(read, marks=marks).collect()} == {f"v{i}" for i in range(300) if i % 2 or i % 28 + 1 >= 15}
    assert D._opened("file:///x/y")[1] == "/x/y"


def test_empty_folder(spark, tmp_path, listings):
    assert spark.read.format("vault_discovery").load(str(tmp_path / "none")).count() == 0
