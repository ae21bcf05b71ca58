"""The stages of videos as a stream: locks with leases, retries, and scans that are paused or stopped.

Two stateful operators follow one another:

* a gate for each (scan, share of its videos) keeps the scan's control status and, while it is paused, the events that
  wait; they go on, in order, at the moment of the control event that ends the pause. Control events reach all shares, so that a scan
  of many videos is no hot key;
* a machine for each video keeps its stage, the scan that holds its lock, the lease's end and the tries of the
  present stage. A timer frees a lock whose lease has run out, also if no further event comes.

An event is (event_id, at, video_id, scan_id, kind); work kinds are WORK, control kinds CONTROL (their video_id is null).
Events are taken in the order of (at, event_id), also over micro-batches: sources deliver them in order, up to the
watermark's delay; an event before the last one of its video comes out as LATE and changes nothing. A restart goes on
from the checkpoint; no state is held by the driver.

Rows out: every work event that left its gate, with its result (see _Machine._apply), the stage, owner and tries after it, and `freed`:
whether the lock before it ran out; and rows of kind `timer` for locks that a timer freed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.schemas import STAGES
from lodestone.ship import ship

EVENTS = "event_id long, at timestamp, video_id string, scan_id string, kind string"
WORK = ["claim", "done", "fail", "reject", "wait", "release"]
CONTROL = ["RUNNING", "PAUSED", "STOPPING"]
PASSED = "event_id long, at timestamp, video_id string, scan_id string, kind string, passed boolean"
RESULTS = "event_id long, at timestamp, video_id string, scan_id string, kind string, result string, stage string, owner string, retries int, freed boolean"
TRIES = 3
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(rows: Iterator[pd.DataFrame]) -> list[tuple]:
    """Rows of one key in one micro-batch in the order of events, times as microseconds."""
    whole = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
    whole["at"] = whole["at"].astype("datetime64[us]").astype("int64")
    return list(whole.itertuples(index=False))


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    out["at"] = pd.to_datetime(out["at"], unit="us")
    for part in schema.split(", "):
        name, kind = part.split()
        if kind in ("long", "int"):
            out[name] = out[name].astype("Int64" if kind == "long" else "Int32")
    return out


class _Gate(StatefulProcessor):
    """Lets events of a scan pass, holds them while it is paused, and turns claims away once it is stopping."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "kind string")
        self.held = handle.getListState("held", "event_id long, video_id string, scan_id string, kind string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status = self.status.get()[0] if self.status.exists() else "RUNNING"
        before = status
        out: list[tuple] = []
        waiting: list[tuple] = []
        for r in _ordered(rows):
            if r.kind not in CONTROL:
                if status == "PAUSED":
                    waiting.append((r.event_id, r.video_id, r.scan_id, r.kind))
                else:
                    out.append((r.event_id, r.at, r.video_id, r.scan_id, r.kind, status == "RUNNING" or r.kind != "claim"))
                continue
            status = r.kind
            if status != "PAUSED":
                held = [*(tuple(h) for h in self.held.get()), *waiting] if self.held.exists() else waiting
                out += [(e, r.at, v, s, k, status == "RUNNING" or k != "claim") for e, v, s, k in held]
                self.held.clear()
                waiting = []
        if waiting:
            self.held.appendList(waiting)
        if status != before:
            self.status.update((status,))
        if out:
            yield _frame(out, PASSED)

    def close(self) -> None:
        pass


_ZERO = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
_RESULT = Row(*[part.split()[0] for part in RESULTS.split(", ")])


def _micros(at: dt.datetime) -> int:
    return ((at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)) - _ZERO) // dt.timedelta(microseconds=1)


def _result(event_id: int | None, at: int, *rest) -> Row:
    return _RESULT(event_id, _ZERO + dt.timedelta(microseconds=at), *rest)


def _timer(state: list) -> int | None:
    """The millisecond of the timer that a state's lock has."""
    return None if state[1] is None else -(-state[2] // 1000)


class _Machine(StatefulProcessor):
    """A video's stage, lock and tries. There are many videos with few events each, so it works on rows and asks for its state once."""

    def __init__(self, lease: int, tries: int) -> None:
        self.lease, self.tries = lease, tries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # freed: a timer freed the lock since the last event; last: the time of that event
        self.video = handle.getValueState("video", "stage string, owner string, until long, retries int, freed boolean, last long")

    def _state(self) -> list:
        known = self.video.get()
        return [STAGES[0], None, None, 0, False, None] if known is None else list(known)

    def _apply(self, state: list, at: int, scan: str, kind: str) -> str:
        """Changes the state by one event and names what came of it."""
        stage, owner = state[0], state[1]
        if kind == "claim":
            if stage == STAGES[-1]:
                return "ENDED"
            if owner not in (None, scan):
                return "REFUSED"
            state[1], state[2] = scan, at + self.lease
            return "CLAIMED"
        if owner != scan or scan is None:
            return "IGNORED"
        state[2] = at + self.lease
        if kind == "done":
            state[0], state[3] = STAGES[STAGES.index(stage) + 1], 0
            if state[0] != STAGES[-1]:
                return "ADVANCED"
        elif kind == "fail":
            state[3] += 1
            if state[3] < self.tries:
                return "RETRY"
            state[3] = 0
        elif kind == "reject":
            state[0], state[3] = STAGES[-1], 0
        state[1] = state[2] = None
        return {"done": "FINISHED", "fail": "GAVE_UP", "reject": "REJECTED", "wait": "WAITING", "release": "RELEASED"}[kind]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self._state()
        before = _timer(state)
        out: list[Row] = []
        events = [(_micros(r.at), r.event_id, r.video_id, r.scan_id, r.kind, r.passed) for r in rows]
        for at, event_id, video, scan, kind, passed in sorted(events, key=lambda e: (e[0], e[1] is None, e[1] or 0)):
            if state[5] is not None and at < state[5]:
                out.append(_result(event_id, at, video, scan, kind, "LATE", state[0], state[1], state[3], False))
                continue
            freed = state[4]
            if state[1] is not None and state[2] <= at:
                freed, state[1], state[2] = True, None, None
            result = self._apply(state, at, scan, kind) if passed else "STOPPED"
            state[4], state[5] = False, at
            out.append(_result(event_id, at, video, scan, kind, result, state[0], state[1], state[3], freed))
        self.video.update(tuple(state))
        after = _timer(state)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._state()
        if state[1] is None or state[2] > expiredTimerInfo.getExpiryTimeInMs() * 1000:
            return
        owner, until = state[1], state[2]
        state[1], state[2], state[4], state[5] = None, None, True, max(state[5] or until, until)
        self.video.update(tuple(state))
        yield _result(None, until, key[0], owner, "timer", "FREED", state[0], None, state[3], True)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        stage = initialState["stage"]
        self.video.update((stage if stage in STAGES else STAGES[0], None, None, 0, False, None))

    def close(self) -> None:
        pass


def results(events: DataFrame, lease_seconds: int = 6 * 3600, tries: int = TRIES, late: str = "1 minute", shares: int = 8, videos: DataFrame | None = None) -> DataFrame:
    """The stream of results of a stream of events; videos (video_id, checkpoint_stage): stages to start from.

    The session keeps state in RocksDB, which the operators need.
    """
    spark = ship(events.sparkSession)
    spark.conf.set(_PROVIDER, _ROCKS)
    control = F.col("kind").isin(CONTROL)
    share = F.when(control, F.sequence(F.lit(0), F.lit(shares - 1))).otherwise(F.array(F.pmod(F.xxhash64("video_id"), F.lit(shares)).cast("int")))
    known = events.filter(F.col("kind").isin(CONTROL + WORK) & F.col("at").isNotNull() & F.col("scan_id").isNotNull() & (control | F.col("video_id").isNotNull()))
    rows = known.withWatermark("at", late).withColumn("share", F.explode(share))
    passed = rows.groupBy("scan_id", "share").transformWithStateInPandas(_Gate(), PASSED, "Append", "EventTime", eventTimeColumnName="at")
    initial = None if videos is None else videos.select("video_id", F.col("checkpoint_stage").alias("stage")).groupBy("video_id")
    return passed.groupBy("video_id").transformWithState(_Machine(lease_seconds * 1_000_000, tries), RESULTS, "Append", "EventTime", initialState=initial, eventTimeColumnName="at")


def run(found: DataFrame, path: str, checkpoint: str) -> None:
    """Takes what is there in micro-batches, appends results to Parquet files below path exactly once, and stops."""
    found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def sequential(events: list[tuple], lease_seconds: int = 6 * 3600, tries: int = TRIES) -> list[tuple]:
    """Results of (event_id, microseconds, video_id, scan_id, kind) one by one, without timer rows: what the stream must equal."""
    status: dict[str, str] = {}
    held: dict[str, list[tuple]] = {}
    passed: list[tuple] = []
    for e, at, video, scan, kind in sorted(events, key=lambda r: (r[1], r[0])):
        if kind in CONTROL:
            status[scan] = kind
            if kind != "PAUSED":
                passed += [(h[0], at, *h[1:], kind == "RUNNING" or h[3] != "claim") for h in held.pop(scan, [])]
        elif status.get(scan) == "PAUSED":
            held.setdefault(scan, []).append((e, video, scan, kind))
        else:
            passed.append((e, at, video, scan, kind, status.get(scan) != "STOPPING" or kind != "claim"))
    machine, states, out = _Machine(lease_seconds * 1_000_000, tries), {}, []
    for e, at, video, scan, kind, free in sorted(passed, key=lambda r: (r[1], r[0])):
        state = states.setdefault(video, [STAGES[0], None, None, 0, False, None])
        freed = state[1] is not None and state[2] <= at
        if freed:
            state[1] = state[2] = None
        result = machine._apply(state, at, scan, kind) if free else "STOPPED"
        out.append((e, video, scan, kind, result, state[0], state[1], state[3], freed))
    return out
