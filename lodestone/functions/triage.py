"""Triage: rules that decide which videos to take, as one expression; a model decides the rest, many to a prompt."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.ship import ship

#: Fixed defaults.
LEAST_SECONDS, LEAST_CONFIDENCE, KEYWORD_CONFIDENCE = 60, 0.7, 0.85


def rule_triage(videos: DataFrame, keywords: list[str], verified: list[str] = (), short_allowed: list[str] = ()) -> DataFrame:
    """videos with triage_status, triage_reason and triage_confidence by rules; NEEDS_LLM where none holds.

    Length comes first, then verified channels, then whole-word keywords in the title (three at most are named, in list order).
    """
    title = F.lower(F.coalesce("title", F.lit("")))
    hits = F.array_compact(F.array(*[F.when(title.rlike(rf"\b\Q{k.lower()}\E\b"), F.lit(k)) for k in keywords])) if keywords else F.array().cast("array<string>")
    short = (F.col("duration_seconds") < LEAST_SECONDS) & ~F.col("channel_id").isin(list(short_allowed))
    status = F.when(short, "REJECTED").when(F.col("channel_id").isin(list(verified)), "ACCEPTED").when(F.size(hits) > 0, "ACCEPTED").otherwise("NEEDS_LLM")
    reason = F.when(short, f"duration_under_{LEAST_SECONDS}s").when(F.col("channel_id").isin(list(verified)), "verified_channel").when(F.size(hits) > 0, F.concat(F.lit("keyword_match: "), F.array_join(F.slice(hits, 1, 3), ", "))).otherwise("ambiguous_metadata")
    confidence = F.when(short | F.col("channel_id").isin(list(verified)), 1.0).when(F.size(hits) > 0, KEYWORD_CONFIDENCE).otherwise(0.0)
    return videos.withColumns({"triage_status": status, "triage_reason": reason, "triage_confidence": confidence})


def finish_triage(category: Column, confidence: Column) -> Column:
    """Status from a model's category and confidence."""
    sure = confidence >= LEAST_CONFIDENCE
    return F.when(sure & (category == "KNOWLEDGE"), "ACCEPTED").when(sure & (category == "NOISE"), "REJECTED").otherwise("PENDING_REVIEW")


def triage_prompt() -> Column:
    return F.format_string("Title: %s\nChannel: %s\nDuration: %s s\nDescription: %s", F.coalesce("title", F.lit("")), F.coalesce("channel_id", F.lit("")), F.coalesce(F.col("duration_seconds").cast("string"), F.lit("?")), F.substring(F.coalesce("description", F.lit("")), 1, 500))


#: What the entry of a video shows, and the reasons of videos that a batch leaves open.
DESCRIPTION, TAGS = 300, 5
MISSING, FAILED, CLASSIFIED = "llm_batch_missing_id", "llm_batch_error: ", "llm_classification"
_VERDICT = "video_id string, category string, confidence double, is_tutorial boolean, reason string, open boolean"


def entry(columns: list[str]) -> Column:
    """The lines of a video in a prompt; columns: those that the table has."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in columns else F.lit("")
    tags = F.coalesce(F.nullif(F.array_join(F.slice("tags", 1, TAGS), ", "), F.lit("")), F.lit("none")) if "tags" in columns else F.lit("none")
    return F.concat(F.lit("ID: "), text("video_id"), F.lit("\nTITLE: "), text("title"), F.lit("\nDESCRIPTION: "), F.substring(text("description"), 1, DESCRIPTION), F.lit("\nDURATION: "), text("duration_seconds"), F.lit("s\nTAGS: "), tags, F.lit("\n---"))


def _reply(text: str) -> dict:
    """The object of a reply, also in a code fence; raises on anything else."""
    found = json.loads(re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", text))
    if not isinstance(found, dict):
        raise ValueError("reply is no object")
    return found


def _judged(rows: list[tuple[str, str]], model: Callable[[str], str]) -> Iterator[tuple]:
    """Verdicts of (video_id, entry); a call or reply that fails is tried again in halves, down to one row."""
    try:
        found = _reply(model("\n".join(e for _, e in rows)))
    except Exception as problem:
        if len(rows) == 1:
            yield rows[0][0], None, 0.0, None, FAILED + (str(problem) or repr(problem))[:50], True
            return
        middle = len(rows) // 2
        yield from _judged(rows[:middle], model)
        yield from _judged(rows[middle:], model)
        return
    for video, _ in rows:
        said = found.get(video)
        if said is None:
            yield video, None, 0.0, None, MISSING, True
            continue
        try:
            yield video, str(said.get("category", "AMBIGUOUS")).upper(), float(said.get("confidence", 0.0)), bool(said.get("is_tutorial", False)), str(said.get("reason", CLASSIFIED)), False
        except Exception as problem:
            yield video, None, 0.0, None, FAILED + (str(problem) or repr(problem))[:50], True


def batch_triage(videos: DataFrame, model: Callable[[str], str], most: int = 20, characters: int = 8_000) -> DataFrame:
    """videos with triage_status, triage_reason, triage_confidence and is_tutorial as a model says, many videos to a prompt.

    A prompt has at most `most` videos and, beyond the first, at most `characters` characters, packed as the rows of a partition come; replies are
    {video_id: {category, confidence, is_tutorial, reason}}. A video that a reply leaves out waits for a person, as does one whose
    call still fails when it is asked alone; one bad video or reply doesn't spoil its batch.
    """
    ship(videos.sparkSession)
    asked = videos.select(F.col("video_id").cast("string").alias("video_id"), entry(videos.columns).alias("entry")).filter("video_id IS NOT NULL").dropDuplicates(["video_id"])
    kinds = pa.schema([("video_id", pa.string()), ("category", pa.string()), ("confidence", pa.float64()), ("is_tutorial", pa.bool_()), ("reason", pa.string()), ("open", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        size = 0

        def answered() -> pa.RecordBatch:
            rows = list(_judged(held, model))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)

        for batch in batches:
            for row in zip(batch["video_id"].to_pylist(), batch["entry"].to_pylist()):
                if held and (len(held) == most or size + len(row[1]) > characters):
                    yield answered()
                    held, size = [], 0
                held.append(row)
                size += len(row[1]) + 1
        if held:
            yield answered()

    verdicts = asked.mapInArrow(run, _VERDICT).withColumnsRenamed({c: f"__{c}" for c in ("category", "confidence", "is_tutorial", "reason", "open")})
    known = F.col("__open").isNotNull()
    out = videos.drop("is_tutorial").join(verdicts, "video_id", "left").withColumns({
        "triage_status": F.when(F.coalesce("__open", F.lit(True)), F.lit("PENDING_REVIEW")).otherwise(finish_triage(F.col("__category"), F.col("__confidence"))),
        "triage_reason": F.when(known, F.col("__reason")).otherwise(F.lit(MISSING)),
        "triage_confidence": F.coalesce("__confidence", F.lit(0.0)),
        "is_tutorial": F.coalesce("__is_tutorial", F.lit(False)),
    })
    return out.drop("__category", "__confidence", "__is_tutorial", "__reason", "__open")
