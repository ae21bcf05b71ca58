"""Mutations of a vault: triage, stages, locks, scans, soft delete, purge, outbox. Each returns a new vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.vault import Vault, upsert

#: What a second write of a row changes, by table; other columns keep their first value.
POLICIES = {
    "channels": {"url": "keep", "category": "keep", "language_iso": "keep", "discovered_at": "keep"},
    "videos": {c: "keep" for c in ("channel_id", "title", "url", "description", "duration_seconds", "upload_date", "tags", "triage_status", "triage_reason", "checkpoint_stage", "created_at")},
    "guests": {"mention_count": "add", "aliases": "union", "first_seen": "min", "last_seen": "max", "entity_type": "keep"},
    "pipeline_temp_state": {c: "fill" for c in ("raw_text", "cleaned_text", "translated_text")},
    "edges": {"weight": "add", "relationship": "fill"},
}


def save(vault: Vault, table: str, rows: DataFrame, parts: int | None = None) -> Vault:
    """Keyed write by the table's policy, by so many tasks."""
    return vault.having(**{table: upsert(getattr(vault, table), rows, schemas.key(table), POLICIES.get(table, {}), parts)})


def _video(video_id: str) -> Column:
    return F.col("video_id") == video_id


def set_triage(vault: Vault, video_id: str, status: str, reason: str = "", confidence: float = 0.0, is_tutorial: bool = False) -> Vault:
    if status not in schemas.TRIAGE:
        raise ValueError(f"no triage status {status}")
    return vault.update("videos", _video(video_id), triage_status=F.lit(status), triage_reason=F.lit(reason), triage_confidence=F.lit(confidence), is_tutorial=F.lit(is_tutorial))


def override_rejected(vault: Vault, video_id: str, reason: str = "") -> Vault:
    where = _video(video_id) & (F.col("triage_status") == "REJECTED")
    text = "manual_override" + (f": {reason}" if reason else "")
    return vault.update("videos", where, triage_status=F.lit("ACCEPTED"), triage_reason=F.lit(text), triage_confidence=F.lit(1.0), checkpoint_stage=F.lit("METADATA_HARVESTED"))


def skip(vault: Vault, video_id: str) -> Vault:
    return vault.update("videos", _video(video_id) & (F.col("triage_status") == "DISCOVERED"), triage_status=F.lit("SKIPPED"))


def advance(vault: Vault, video_id: str, stage: str) -> Vault:
    if stage not in schemas.STAGES:
        raise ValueError(f"no stage {stage}")
    return vault.update("videos", _video(video_id), checkpoint_stage=F.lit(stage))


def next_stage(stage: Column) -> Column:
    """The stage after; the first for an unknown one, null after the last."""
    names = F.array(*[F.lit(s) for s in schemas.STAGES])
    return F.get(names, F.array_position(names, F.coalesce(stage, F.lit(""))).cast("int"))


def remaining_stages(stage: Column) -> Column:
    names = F.array(*[F.lit(s) for s in schemas.STAGES])
    return F.slice(names, F.array_position(names, F.coalesce(stage, F.lit(""))).cast("int") + 1, len(schemas.STAGES))


def claim(vault: Vault, requests: DataFrame) -> Vault:
    """Locks for requests (video_id, scan_id): a free video goes to its least scan, one that is held stays."""
    winner = requests.groupBy("video_id").agg(F.min("scan_id").alias("__scan"))
    videos = vault.videos.join(winner, "video_id", "left").withColumn("locked_by_scan_id", F.coalesce("locked_by_scan_id", "__scan")).drop("__scan")
    return vault.having(videos=videos.select(*vault.videos.columns))


def release(vault: Vault, scan_id: str, video_id: str | None = None) -> Vault:
    where = F.col("locked_by_scan_id") == scan_id
    return vault.update("videos", where if video_id is None else where & _video(video_id), locked_by_scan_id=F.lit(None).cast("string"))


def update_scan(vault: Vault, scan_id: str, **values: object) -> Vault:
    """Sets what is given of a scan's totals, last video and status."""
    return vault.update("scan_checkpoints", F.col("scan_id") == scan_id, **{k: F.lit(v) for k, v in values.items() if v is not None})


def control(vault: Vault, status: str, scan_ids: list[str] | None = None, reason: str = "") -> Vault:
    """Pauses, resumes or stops scans, all running ones by default, and logs it."""
    if status not in schemas.CONTROL:
        raise ValueError(f"no control status {status}")
    scans = vault.scan_checkpoints.filter(F.col("status") == "IN_PROGRESS" if scan_ids is None else F.col("scan_id").isin(scan_ids)).select("scan_id")
    rows = scans.select("scan_id", F.lit(status).alias("status"), F.lit(reason).alias("pause_reason"))
    logged = scans.select("scan_id", F.lit("INFO").alias("level"), F.lit(f"scan {status}").alias("message"))
    return vault.upsert("pipeline_control", rows).append("pipeline_logs", logged)


def soft_delete(vault: Vault, where: Column, reason: str = "", kind: str = "VIDEO") -> Vault:
    """Marks videos (of one id, or of a channel) as deleted and records it."""
    gone = vault.videos.filter(where & ~F.coalesce("is_deleted", F.lit(False))).select(F.lit(kind).alias("deletion_type"), "video_id", "channel_id", F.lit(reason).alias("reason"))
    return vault.append("deletion_history", gone).update("videos", where, is_deleted=F.lit(True))


def restore(vault: Vault, video_id: str) -> Vault:
    return vault.update("videos", _video(video_id), is_deleted=F.lit(False))


#: Tables whose rows of a video go with it.
OF_VIDEO = ["transcript_chunks", "video_summaries", "claims", "quotes", "guest_appearances", "pipeline_temp_state", "actionable_blueprints", "video_sentiment", "external_citations", "sync_outbox"]


def purge(vault: Vault, videos: DataFrame, reason: str = "") -> Vault:
    """Deletes all data of videos (video_id), resets them, drops guests left without appearances, records counts."""
    ids = videos.select("video_id").distinct()
    counts = None
    before = vault.guest_appearances.join(ids, "video_id", "left_semi").select("guest_id").distinct()
    for name in OF_VIDEO:
        one = getattr(vault, name).join(ids, "video_id", "left_semi").groupBy("video_id").agg(F.count("*").alias("n")).withColumn("table", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
        if name in vault.tables:
            vault = vault.delete(name, ids)
    audit = ids.join(counts.groupBy("video_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table", "n")))).alias("data_deleted")), "video_id", "left").select(F.lit("PURGE").alias("deletion_type"), "video_id", F.lit(reason).alias("reason"), "data_deleted")
    orphans = before.join(vault.guest_appearances.select("guest_id"), "guest_id", "left_anti")
    marked = vault.videos.join(ids.withColumn("__gone", F.lit(True)), "video_id", "left")
    reset = {"checkpoint_stage": F.lit("METADATA_HARVESTED"), "triage_status": F.lit("DISCOVERED")}
    marked = marked.withColumns({c: F.when(F.col("__gone"), v).otherwise(F.col(c)) for c, v in reset.items()}).select(*vault.videos.columns)
    return vault.having(videos=marked).delete("guests", orphans).append("deletion_history", audit)


def outbox_entry(vault: Vault, videos: DataFrame) -> Vault:
    """New or repeated entries: both stores undone, a further try."""
    rows = videos.select("video_id").distinct().select("video_id", F.lit(False).alias("vector_done"), F.lit(False).alias("graph_done"), F.lit(1).alias("retry_count"))
    return vault.upsert("sync_outbox", rows, retry_count="add")


def outbox_done(vault: Vault, video_id: str, store: str) -> Vault:
    return vault.update("sync_outbox", _video(video_id), **{f"{store}_done": F.lit(True)})


def outbox_error(vault: Vault, video_id: str, error: str) -> Vault:
    return vault.update("sync_outbox", _video(video_id), last_error=F.lit(error[:500]), retry_count=F.col("retry_count") + 1)


def drain_outbox(vault: Vault, repair, most_tries: int = 5) -> Vault:
    """Replays undone entries with tries left through repair(vault, videos) (idempotent), then drops what is done."""
    undone = vault.sync_outbox.filter(~(F.col("vector_done") & F.col("graph_done")) & (F.col("retry_count") < most_tries)).select("video_id")
    vault = repair(vault, undone)
    return vault.having(sync_outbox=vault.sync_outbox.filter(~(F.col("vector_done") & F.col("graph_done"))))


def clean_temp_states(vault: Vault) -> Vault:
    return vault.delete("pipeline_temp_state", vault.videos.filter(F.col("checkpoint_stage").isin("GRAPH_SYNCED", "DONE")).select("video_id"))


def clear_logs(vault: Vault, before: object) -> Vault:
    return vault.having(pipeline_logs=vault.pipeline_logs.filter(F.col("timestamp") >= F.lit(before)))


def delete_session(vault: Vault, session_id: str) -> Vault:
    gone = vault.chat_sessions.filter(F.col("session_id") == session_id).select("session_id")
    return vault.delete("chat_messages", gone).delete("chat_sessions", gone)


def add_message(vault: Vault, rows: DataFrame, at: object) -> Vault:
    """Appends messages and moves their sessions' last activity."""
    vault = vault.append("chat_messages", rows)
    seen = rows.select("session_id").distinct().withColumn("last_active", F.lit(at).cast("timestamp"))
    return vault.upsert("chat_sessions", seen, last_active="max")
