"""Lookups, filters, sorts, limits and joins over a vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.vault import Vault

#: Orders that a caller may ask for by name.
ORDERS = {"created_at", "upload_date", "view_count", "title", "duration_seconds", "triage_confidence", "like_count", "video_id"}


def rows(df: DataFrame, where: Column | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Filter, sort and top-k in one; filters reach the scan, and order with limit becomes one top-k per partition."""
    df = df if where is None else df.filter(where)
    df = df if order is None else df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def by_key(vault: Vault, table: str, key: str, value: object) -> DataFrame:
    """Point lookup: channel, guest, chunk, blueprint, summary, control state, checkpoint, temporary state and so on."""
    return rows(getattr(vault, table), F.col(key) == F.lit(value))


def newest(vault: Vault, table: str, limit: int | None = None, column: str = "created_at", where: Column | None = None) -> DataFrame:
    """Newest rows first: reports, briefs, briefings, sessions, deletions, pinned searches, monitored channels."""
    return rows(getattr(vault, table), where, [F.col(column).desc_nulls_last()], limit)


def of_video(vault: Vault, table: str, video_id: str, order: str = "timestamp") -> DataFrame:
    """Rows of one video in order: chunks, claims, quotes, logs, history, citations."""
    return rows(getattr(vault, table), F.col("video_id") == video_id, [F.col(order).asc_nulls_first()])


def get_video(vault: Vault, video_id: str, include_deleted: bool = False) -> DataFrame:
    kept = F.col("video_id") == video_id
    return rows(vault.videos, kept if include_deleted else kept & ~F.coalesce("is_deleted", F.lit(False))).join(vault.channels.select("channel_id", F.col("name").alias("channel_name")), "channel_id", "left")


def all_channels(vault: Vault) -> DataFrame:
    return rows(vault.channels, order=[F.col("name"), F.col("channel_id")])


def videos_by_status(vault: Vault, status: str | list[str], limit: int | None = 500, include_deleted: bool = False, order: str = "created_at", descending: bool = True) -> DataFrame:
    """Videos of one or more triage states with their channel's name, newest first or in a named order."""
    if order not in ORDERS:
        raise ValueError(f"no order {order}")
    wanted = F.col("triage_status").isin([status] if isinstance(status, str) else status)
    if not include_deleted:
        wanted = wanted & ~F.coalesce("is_deleted", F.lit(False))
    key = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_first()
    named = rows(vault.videos, wanted, [key, F.col("video_id")], limit)
    # which side is small is Spark's to measure: channels grow with the vault, and a limit may bound the videos
    return named.join(vault.channels.select("channel_id", F.col("name").alias("channel_name")), "channel_id", "left")


def videos_by_channel(vault: Vault, channel_ids: str | list[str], limit: int | None = None) -> DataFrame:
    wanted = F.col("channel_id").isin([channel_ids] if isinstance(channel_ids, str) else channel_ids)
    return rows(vault.videos, wanted, [F.col("upload_date").desc_nulls_last(), F.col("video_id")], limit)


def resumable_videos(vault: Vault) -> DataFrame:
    """Accepted videos short of the last stage that nobody holds, oldest first."""
    wanted = (F.col("triage_status") == "ACCEPTED") & (F.col("checkpoint_stage") != "DONE") & F.col("locked_by_scan_id").isNull()
    return rows(vault.videos, wanted, [F.col("created_at").asc_nulls_first(), F.col("video_id")])


def manually_overridden(vault: Vault, limit: int | None = 100) -> DataFrame:
    wanted = (F.col("triage_status") == "ACCEPTED") & (F.col("checkpoint_stage") == "METADATA_HARVESTED") & F.contains(F.col("triage_reason"), F.lit("manual_override"))
    return rows(vault.videos, wanted, [F.col("created_at").desc_nulls_last(), F.col("video_id")], limit)


def missing_heatmaps(vault: Vault, limit: int | None = 200) -> DataFrame:
    wanted = (F.col("triage_status") == "ACCEPTED") & (F.coalesce(F.size("heatmap"), F.lit(0)) <= 0)
    return rows(vault.videos, wanted, [F.col("video_id")], limit)


def contains_any_case(column: str, text: str) -> Column:
    """Substring test in any case; wildcards of the text are ordinary characters."""
    return F.contains(F.lower(F.col(column)), F.lower(F.lit(text)))


def search_claims(vault: Vault, text: str, limit: int | None = 20) -> DataFrame:
    return rows(vault.claims, contains_any_case("claim_text", text), [F.col("confidence").desc_nulls_last(), F.col("claim_id")], limit)


def quotes_by_speaker(vault: Vault, speaker: str, limit: int | None = 50) -> DataFrame:
    return rows(vault.quotes, contains_any_case("speaker", speaker), [F.col("timestamp").asc_nulls_first()], limit)


def search_reports(vault: Vault, text: str, limit: int | None = 10) -> DataFrame:
    return rows(vault.research_reports, contains_any_case("query", text) | contains_any_case("title", text), [F.col("created_at").desc_nulls_last()], limit)


def thematic_bridges(vault: Vault, topic: str | None = None) -> DataFrame:
    wanted = None if topic is None else (F.col("topic_a") == topic) | (F.col("topic_b") == topic)
    return newest(vault, "thematic_bridges", where=wanted)


def find_guest(vault: Vault, name: str) -> DataFrame:
    """The guest of this name, else those with it as an alias."""
    hits = vault.guests.withColumn("rank", F.when(F.col("canonical_name") == name, 0).when(F.array_contains(F.coalesce("aliases", F.array().cast("array<string>")), name), 1))
    return rows(hits.filter(F.col("rank").isNotNull()), order=[F.col("rank"), F.col("guest_id")], limit=1).drop("rank")


def unresolved_guests(vault: Vault, limit: int = 20) -> DataFrame:
    """Guests with mentions or with a name that several rows share."""
    shared = vault.guests.groupBy("canonical_name").agg(F.count("*").alias("n")).filter("n > 1").select("canonical_name")
    flagged = vault.guests.join(shared.withColumn("twin", F.lit(True)), "canonical_name", "left")
    return rows(flagged.filter(F.coalesce("twin", F.lit(False)) | (F.col("mention_count") > 0)).drop("twin"), order=[F.col("mention_count").desc_nulls_last(), F.col("guest_id")], limit=2 * limit)


def top_performing(vault: Vault, limit: int = 10) -> DataFrame:
    return rows(vault.videos, ~F.coalesce("is_deleted", F.lit(False)), [F.col("view_count").desc_nulls_last(), F.col("video_id")], limit)


def most_engaged(vault: Vault, limit: int = 10, min_views: int = 1000) -> DataFrame:
    rate = F.try_divide((F.col("like_count") + F.col("comment_count")).cast("double"), F.col("view_count"))
    return rows(vault.videos.withColumn("engagement", rate), (F.col("view_count") >= min_views) & ~F.coalesce("is_deleted", F.lit(False)), [F.col("engagement").desc_nulls_last(), F.col("video_id")], limit)


def logs(vault: Vault, scan_id: str | None = None, video_id: str | None = None, level: str | None = None, limit: int | None = 1000, ascending: bool = False) -> DataFrame:
    wanted = F.lit(True)
    for column, value in (("scan_id", scan_id), ("video_id", video_id), ("level", level)):
        if value:
            wanted = wanted & (F.col(column) == value)
    order = [F.col("timestamp").asc_nulls_first(), F.col("log_id")] if ascending else [F.col("timestamp").desc_nulls_last(), F.col("log_id").desc()]
    return rows(vault.pipeline_logs, wanted, order, limit)


def saved_discoveries(vault: Vault, limit: int = 50) -> DataFrame:
    return newest(vault, "saved_discoveries", limit).join(vault.videos.select("video_id", "title"), "video_id")


def missing(vault: Vault, table: str, where: Column | None = None, of: Column | None = None, limit: int | None = 200) -> DataFrame:
    """Videos (of a kind) without a row (of a kind) in a table: no transcript, no summary, no vector."""
    there = rows(getattr(vault, table), where).select("video_id")
    return rows(rows(vault.videos, of).join(there, "video_id", "left_anti"), order=[F.col("video_id")], limit=limit)


def missing_transcripts(vault: Vault, limit: int | None = 200) -> DataFrame:
    return missing(vault, "transcript_chunks", limit=limit, of=F.col("triage_status") == "ACCEPTED")


def missing_summaries(vault: Vault, limit: int | None = 200) -> DataFrame:
    return missing(vault, "video_summaries", F.coalesce("summary_text", F.lit("")) != "", F.col("triage_status") == "ACCEPTED", limit)


def videos_for_summary(vault: Vault, limit: int | None = 50, stages: tuple[str, ...] = ("CHUNKED", "CHUNK_ANALYZED")) -> DataFrame:
    return missing(vault, "video_summaries", of=F.col("checkpoint_stage").isin(list(stages)), limit=limit)


def all_blueprints(vault: Vault) -> DataFrame:
    tutorials = vault.videos.filter("is_tutorial").select("video_id", "channel_id", "title")
    named = tutorials.join(vault.channels.select("channel_id", F.col("name").alias("channel_name")), "channel_id")
    return vault.actionable_blueprints.join(named, "video_id").orderBy(F.col("created_at").desc_nulls_last())


def sentiment_series(vault: Vault, video_id: str) -> DataFrame:
    chunks = vault.transcript_chunks.select("chunk_id", "start_timestamp", "chunk_index")
    return rows(vault.video_sentiment, F.col("video_id") == video_id).join(chunks, "chunk_id", "left").orderBy("id")


def pending_outbox(vault: Vault, limit: int = 100) -> DataFrame:
    undone = ~(F.coalesce("vector_done", F.lit(False)) & F.coalesce("graph_done", F.lit(False)))
    return rows(vault.sync_outbox, undone, [F.col("created_at").asc_nulls_first()], limit).join(vault.videos.select("video_id", "title", "checkpoint_stage"), "video_id", "left")


def active_scans(vault: Vault) -> DataFrame:
    """The latest running scan of each url."""
    ranked = vault.scan_checkpoints.filter(F.col("status") == "IN_PROGRESS").withColumn("rn", F.row_number().over(Window.partitionBy("source_url").orderBy(F.col("started_at").desc_nulls_last(), F.col("scan_id").desc())))
    state = vault.pipeline_control.select("scan_id", F.col("status").alias("control"))
    return ranked.filter("rn = 1").drop("rn").join(state, "scan_id", "left").withColumn("control", F.coalesce("control", F.lit("RUNNING")))


def processed_ids(vault: Vault, scan_id: str) -> DataFrame:
    """Videos that a scan holds, or that were done since it began."""
    began = vault.scan_checkpoints.filter(F.col("scan_id") == scan_id).agg(F.max("started_at").alias("began"))
    done = vault.videos.filter(F.col("checkpoint_stage") == "DONE").join(F.broadcast(began), F.col("updated_at") > F.col("began"), "left_semi").select("video_id")  # one row
    return vault.videos.filter(F.col("locked_by_scan_id") == scan_id).select("video_id").union(done).distinct()


def full_transcripts(vault: Vault, video_ids: list[str] | None = None) -> DataFrame:
    """(video_id, transcript, n_chunks, n_words): chunk texts in order, for one or more videos or all."""
    chunks = vault.transcript_chunks if video_ids is None else vault.transcript_chunks.filter(F.col("video_id").isin(video_ids))
    text = F.coalesce(F.nullif(F.col("cleaned_text"), F.lit("")), F.col("raw_text"), F.lit(""))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", text.alias("text"))))
    return chunks.groupBy("video_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("transcript"), F.count("*").alias("n_chunks"), F.sum("word_count").alias("n_words"))


def transcript_at(vault: Vault, video_id: str, seconds: float, context: float = 30) -> DataFrame:
    wanted = (F.col("video_id") == video_id) & (F.col("start_timestamp") <= seconds + context) & (F.col("end_timestamp") >= seconds - context)
    return rows(vault.transcript_chunks, wanted, [F.col("chunk_index")])


#: Seconds of a bin of time: rows meet in the bins that they touch, not all of a video's rows one another.
BIN = 60.0


def _bins(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def strip_intervals(segments: DataFrame, skips: DataFrame, width: float = BIN) -> DataFrame:
    """Segments (video_id, start, duration, ...) whose middle lies in no skip (video_id, start, end), ends included.

    A segment meets the skips of the one bin of its middle.
    """
    middle = F.col("start") + F.col("duration") / 2
    s = segments.withColumns({"__middle": middle, "__bin": F.floor(middle / width)}).alias("s")
    k = skips.select("video_id", F.col("start").alias("from"), F.col("end").alias("to"), _bins(F.col("start"), F.col("end"), width).alias("__bin")).alias("k")
    inside = F.col("s.__middle").between(F.col("k.from"), F.col("k.to"))
    return s.join(k, (F.col("s.video_id") == F.col("k.video_id")) & (F.col("s.__bin") == F.col("k.__bin")) & inside, "left_anti").drop("__middle", "__bin")


def overlaps(chunks: DataFrame, intervals: DataFrame, width: float = BIN) -> DataFrame:
    """Chunk rows with each overlapping interval (video_id, start, end, score) of their video, closed at both ends.

    Both sides stand in every bin that they touch; a pair counts in the bin of the later start, which both touch, so each comes once.
    """
    k = intervals.select(F.col("video_id").alias("k_video"), F.col("start").alias("from"), F.col("end").alias("to"), "score", _bins(F.col("start"), F.col("end"), width).alias("k_bin"))
    c = chunks.withColumn("__bin", _bins(F.col("start_timestamp"), F.col("end_timestamp"), width))
    met = (F.col("from") <= F.col("end_timestamp")) & (F.col("to") >= F.col("start_timestamp")) & (F.col("__bin") == F.floor(F.greatest("start_timestamp", "from") / width))
    return c.join(k, (F.col("video_id") == F.col("k_video")) & (F.col("__bin") == F.col("k_bin")) & met).drop("k_video", "k_bin", "__bin")


def topic_engagement(vault: Vault, topic: str, heat: DataFrame) -> DataFrame:
    """(video_id, engagement): mean heat over all pairs of a chunk on the topic and an interval that overlaps it."""
    on = vault.transcript_chunks.filter(F.exists("topics", lambda t: F.contains(F.lower(t["name"]), F.lower(F.lit(topic)))))
    return overlaps(on, heat).groupBy("video_id").agg(F.avg("score").alias("engagement"))


def islands(heat: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(video_id, island, start, end, score): runs of neighbouring entries (video_id, pos, start, end, score) at the threshold or over."""
    w = Window.partitionBy("video_id").orderBy("pos")
    hot = F.col("score") >= threshold
    marked = heat.withColumn("island", F.sum(F.when(hot & ~F.coalesce(F.lag(hot).over(w), F.lit(False)), 1).otherwise(0)).over(w))
    return marked.filter(hot).groupBy("video_id", "island").agg(F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.max("score").alias("score"))


def highlights(vault: Vault, heat: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Islands with the text of the chunks they overlap, hottest first."""
    found = islands(heat, threshold)
    text = F.coalesce(F.nullif(F.col("cleaned_text"), F.lit("")), F.col("raw_text"), F.lit(""))
    joined = overlaps(vault.transcript_chunks, found.select("video_id", "start", "end", "score"))
    texts = joined.groupBy("video_id", F.col("from").alias("start")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", text.alias("t")))), lambda x: x["t"]), " ").alias("text"))
    return found.join(texts, ["video_id", "start"], "left").orderBy(F.col("score").desc(), "video_id", "start")


def high_attention(chunks: DataFrame, heat: DataFrame, share: float = 0.2, least_overlap: float = 0.3) -> DataFrame:
    """Chunks (with a flag) of which at least 30 % lies in one interval from the hottest fifth of the video's values."""
    cut = heat.groupBy("video_id").agg(F.array_sort(F.collect_list("score")).alias("v"))
    cut = cut.select("video_id", F.element_at("v", -F.greatest(F.lit(1), F.floor(share * F.size("v")).cast("int"))).alias("cut"))
    hot = heat.join(cut, "video_id").filter("score >= cut").select("video_id", "start", "end", "score")
    part = (F.least("end_timestamp", "to") - F.greatest("start_timestamp", "from")) / F.greatest(F.lit(1.0), F.col("end_timestamp") - F.col("start_timestamp"))
    flagged = overlaps(chunks, hot).groupBy("chunk_id").agg(F.max(part).alias("part")).filter(F.col("part") >= least_overlap).select("chunk_id", F.lit(True).alias("is_high_attention"))
    return chunks.drop("is_high_attention").join(flagged, "chunk_id", "left").withColumn("is_high_attention", F.coalesce("is_high_attention", F.lit(False)))


def new_ids(found: DataFrame, known: DataFrame, key: str = "video_id") -> DataFrame:
    return found.select(key).distinct().join(known.select(key), key, "left_anti")


def changed_chunks(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks whose content hash differs from the known one (chunk_id, content_hash) or that are new."""
    text = F.coalesce(F.nullif(F.col("cleaned_text"), F.lit("")), F.col("raw_text"))
    hashed = chunks.withColumn("content_hash", F.sha2(text, 256))
    old = known.select("chunk_id", F.coalesce("content_hash", F.lit("")).alias("known_hash"))
    return hashed.join(old, "chunk_id", "left").filter(F.col("known_hash").isNull() | (F.col("known_hash") != F.col("content_hash"))).drop("known_hash")


def repair_plan(vault: Vault) -> DataFrame:
    """(video_id, reasons, stage): what repair has to redo; a video comes once."""
    accepted = F.col("triage_status") == "ACCEPTED"
    gaps = [("override", manually_overridden(vault, None), "METADATA_HARVESTED"), ("transcript", missing_transcripts(vault, None), "TRIAGE_COMPLETE"), ("summary", missing(vault, "video_summaries", F.coalesce("summary_text", F.lit("")) != "", accepted & F.col("checkpoint_stage").isin("CHUNK_ANALYZED", "DONE"), None), "CHUNK_ANALYZED")]
    found = [df.select("video_id", F.lit(i).alias("rank"), F.lit(name).alias("reason"), F.lit(stage).alias("stage")) for i, (name, df, stage) in enumerate(gaps)]
    union = found[0].unionByName(found[1]).unionByName(found[2])
    return union.groupBy("video_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"), F.min_by("stage", "rank").alias("stage"))
