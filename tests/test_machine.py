"""The stream of stages against the event-by-event loop, over restarts."""

import datetime as dt
import random

import pytest

from lodestone.streaming import machine as M

START = dt.datetime(2024, 1, 1)


def moments(seed, n=400):
    """(event_id, seconds, video, scan, kind): claims, work and control in order of time."""
    rng = random.Random(seed)
    at, out = 0, []
    for i in range(n):
        at += rng.choice([0, 60, 600, 3600, 5 * 3600])
        scan = rng.choice(["s1", "s2", "s2"])
        if rng.random() < 0.06:
            out.append((i, at, None, scan, rng.choice(M.CONTROL + ["RUNNING"])))
        else:
            out.append((i, at, f"v{rng.randrange(6)}", scan, rng.choice(["claim", "claim", "done", "done", "done", "fail", "fail", *M.WORK])))
    return out


def write(spark, rows, path):
    spark.createDataFrame([(e, START + dt.timedelta(seconds=s), v, c, k) for e, s, v, c, k in rows], M.EVENTS).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(M.EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_loop(spark, tmp_path, seed):
    rows = moments(seed)
    source, sink, checkpoint = (str(tmp_path / d) for d in ("in", "out", "check"))
    cuts = [0, 90, 170, 260, 400]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        write(spark, rows[a:b], source)
        if n in (1, 3):  # stopped and started again from the checkpoint, with two files each time
            M.run(M.results(stream(spark, source)), sink, checkpoint)
    out = spark.read.parquet(sink).collect()
    got = sorted((r.event_id, r.video_id, r.scan_id, r.kind, r.result, r.stage, r.owner, r.retries, r.freed) for r in out if r.kind != "timer")
    want = sorted(M.sequential([(e, s * 1_000_000, v, c, k) for e, s, v, c, k in rows]))
    assert got == want
    assert {r[4] for r in want} >= {"CLAIMED", "ADVANCED", "REFUSED", "IGNORED", "RETRY", "STOPPED"} and any(r[8] for r in want)


def test_stale_lock_is_freed(spark, tmp_path):
    """No event of the video follows: the timer frees its lock. Events that are no events are left out."""
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, [(1, 0, "a", "s", "claim"), (2, 0, None, "s", "claim"), (3, 0, "a", None, "claim"), (4, 0, "a", "s", "unknown")], source)
    write(spark, [(5, 7 * 3600, "b", "s", "claim")], source)
    write(spark, [(6, 8 * 3600, "b", "s", "done")], source)
    videos = spark.createDataFrame([("b", "CORROBORATED"), ("a", "odd")], "video_id string, checkpoint_stage string")
    M.run(M.results(stream(spark, source), videos=videos), sink, str(tmp_path / "check"))
    got = {(r.event_id, r.video_id, r.result, r.stage, r.owner) for r in spark.read.parquet(sink).collect()}
    assert got == {(1, "a", "CLAIMED", "METADATA_HARVESTED", "s"), (None, "a", "FREED", "METADATA_HARVESTED", None), (5, "b", "CLAIMED", "CORROBORATED", "s"), (6, "b", "FINISHED", "DONE", None)}


def test_late_events(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, [(1, 30, "a", "s", "claim")], source)
    write(spark, [(2, 10, "a", "s", "done"), (3, 40, "a", "s", "done")], source)
    M.run(M.results(stream(spark, source)), sink, str(tmp_path / "check"))
    assert {(r.event_id, r.result) for r in spark.read.parquet(sink).collect() if r.event_id} == {(1, "CLAIMED"), (2, "LATE"), (3, "ADVANCED")}
