"""Aggregates, windows and analytical summaries over a vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.cut import stored
from lodestone.vault import Vault


def chunk_topics(vault: Vault) -> DataFrame:
    """(chunk_id, video_id, name, relevance): one row for each topic of a chunk."""
    if "chunk_topics" in vault.tables:
        return vault.tables["chunk_topics"]
    return vault.transcript_chunks.select("chunk_id", "video_id", F.inline("topics")).select("chunk_id", "video_id", "name", F.coalesce("relevance", F.lit(0.5)).alias("relevance"))


def pipeline_stats(vault: Vault) -> DataFrame:
    """One row of counts over videos in one pass; the estimate is 25 s for each video in progress, 2880 min at most."""
    accepted = F.col("triage_status") == "ACCEPTED"
    done = accepted & F.col("checkpoint_stage").isin("SUMMARIZED", "GRAPH_SYNCED", "DONE")
    counts = vault.videos.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("triage_status") == s).alias(s.lower()) for s in ("DISCOVERED", "ACCEPTED", "REJECTED", "PENDING_REVIEW")],
        F.count_if(done).alias("done"),
        F.count_if(accepted & ~F.coalesce(F.col("checkpoint_stage").isin("SUMMARIZED", "GRAPH_SYNCED", "DONE"), F.lit(False))).alias("in_progress"),
    )
    return counts.withColumn("eta_minutes", F.least(F.lit(2880).cast("long"), F.expr("in_progress * 25 div 60")))


def status_histogram(vault: Vault, column: str = "triage_status", where: Column | None = None) -> DataFrame:
    """Counts by a column: triage status, stage of accepted videos, language, log level."""
    df = vault.videos if where is None else vault.videos.filter(where)
    return df.groupBy(column).agg(F.count("*").alias("n"))


def indexed_videos(vault: Vault) -> DataFrame:
    return vault.transcript_chunks.agg(F.count_distinct("video_id").alias("n"))


def store_stats(vault: Vault) -> DataFrame:
    """One row: numbers of rows of the main tables, each a one-row aggregate."""
    out = None
    for name in ("channels", "videos", "transcript_chunks", "claims"):
        one = getattr(vault, name).agg(F.count("*").alias(name))
        out = one if out is None else out.join(one)  # one row and one row
    return out


def outbox_stats(vault: Vault) -> DataFrame:
    done = F.coalesce("vector_done", F.lit(False)), F.coalesce("graph_done", F.lit(False))
    return vault.sync_outbox.agg(F.count("*").alias("total"), F.count_if(~done[0]).alias("vector_pending"), F.count_if(~done[1]).alias("graph_pending"), F.count_if(F.col("retry_count") >= 5).alias("exhausted"))


def temp_state_stats(vault: Vault) -> DataFrame:
    size = sum((F.length(F.coalesce(c, F.lit(""))) for c in ("raw_text", "cleaned_text", "translated_text")), F.lit(0))
    return vault.pipeline_temp_state.agg(F.count("*").alias("n"), F.expr("0L").alias("zero"), F.coalesce(F.sum(size), F.lit(0)).alias("chars")).select("n", F.expr("chars div 1024").alias("kib"))


def consolidated_topics(vault: Vault) -> DataFrame:
    """(name, channel_count, video_count, channels) of each topic, most videos first."""
    topics = chunk_topics(vault).select("video_id", "name").filter(F.col("name").isNotNull()).distinct()
    pairs = topics.join(vault.videos.select("video_id", "channel_id"), "video_id").groupBy("name", "channel_id").agg(F.count("*").alias("videos"))
    named = pairs.join(vault.channels.select("channel_id", F.col("name").alias("channel")), "channel_id", "left")
    # a video has one channel: distinct videos are the sum over channels
    return named.groupBy("name").agg(F.count("channel_id").alias("channel_count"), F.sum("videos").alias("video_count"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))


def topic_trends(vault: Vault) -> DataFrame:
    topics = chunk_topics(vault).select("video_id", "name").distinct()
    dated = topics.join(vault.videos.select("video_id", F.date_format("upload_date", "yyyy-MM").alias("month")), "video_id")
    return dated.groupBy("name", "month").agg(F.count("*").alias("n"))


def topic_mentions_over_time(vault: Vault, topic: str) -> DataFrame:
    """(day, n): chunks that mention the topic, each once."""
    chunks = chunk_topics(vault).filter(F.contains(F.lower("name"), F.lower(F.lit(topic)))).select("chunk_id", "video_id").distinct()
    return chunks.join(vault.videos.select("video_id", F.col("upload_date").alias("day")), "video_id").filter(F.col("day").isNotNull()).groupBy("day").agg(F.count("*").alias("n"))


def topic_lists(vault: Vault) -> DataFrame:
    """(video_id, topics): a video's topics as an array of (name, mentions), the chunks that mention one; written once.

    Rows meet by video in one shuffle, in four times as many partitions as others have, since a task holds three aggregates at once.
    """
    n = 4 * max(1, int(vault.spark.conf.get("spark.sql.shuffle.partitions")))
    said = chunk_topics(vault).select("chunk_id", "video_id", "name").repartition(n, "video_id").distinct()
    each = said.groupBy("video_id", "name").agg(F.count("*").alias("mentions"))
    return stored(each.groupBy("video_id").agg(F.collect_list(F.struct("name", "mentions")).alias("topics")), "topic_lists")


def topic_days(vault: Vault, lists: DataFrame) -> DataFrame:
    """(name, channel_id, day, videos, seconds, mentions): sums over videos by topic, channel and day, from topic_lists(); written once."""
    videos = vault.videos.select("video_id", "channel_id", F.col("upload_date").alias("day"), "duration_seconds")
    each = lists.join(videos, "video_id").select("channel_id", "day", "duration_seconds", F.inline("topics"))
    return stored(each.groupBy("name", "channel_id", "day").agg(F.count("*").alias("videos"), F.sum("duration_seconds").alias("seconds"), F.sum("mentions").alias("mentions")), "topic_days")


def topic_velocity(vault: Vault, days: DataFrame | None = None) -> DataFrame:
    """(name, velocity, trend): mean mentions of the last two days with any over the mean of the days before. days: of topic_days(), where they are known."""
    if days is None:
        daily = chunk_topics(vault).select("chunk_id", "video_id", "name").distinct().join(vault.videos.select("video_id", F.col("upload_date").alias("day")), "video_id").filter(F.col("day").isNotNull()).groupBy("name", "day").agg(F.count("*").alias("n"))
    else:
        daily = days.filter(F.col("day").isNotNull()).groupBy("name", "day").agg(F.sum("mentions").alias("n"))
    w = Window.partitionBy("name").orderBy(F.col("day").desc())
    ranked = daily.withColumn("rn", F.row_number().over(w))
    rate = ranked.groupBy("name").agg(F.avg(F.when(F.col("rn") <= 2, F.col("n"))).alias("recent"), F.avg(F.when(F.col("rn") > 2, F.col("n"))).alias("prior"), F.count("*").alias("days"), F.sum("n").alias("mentions"))
    velocity = F.when(F.col("days") >= 4, F.try_divide("recent", "prior")).otherwise(F.lit(1.0))
    return rate.select("name", "mentions", velocity.alias("velocity")).withColumn("trend", F.when(F.col("velocity") > 1.5, "rising").when(F.col("velocity") < 0.5, "declining").otherwise("stable"))


def video_topics(vault: Vault) -> DataFrame:
    """(video_id, name, relevance): topics of a video by folded name, greatest relevance."""
    return chunk_topics(vault).groupBy("video_id", F.lower(F.trim("name")).alias("name")).agg(F.max(F.coalesce("relevance", F.lit(0.5))).alias("relevance"))


def video_topics_summary(vault: Vault, limit: int = 10) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy(F.col("relevance").desc(), "name")
    return video_topics(vault).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def video_entities(vault: Vault) -> DataFrame:
    return vault.transcript_chunks.select("video_id", F.explode("entities.name").alias("name")).select("video_id", F.trim("name").alias("name")).filter("name <> ''").distinct()


def density_leaderboard(vault: Vault, limit: int | None = 10) -> DataFrame:
    """(video_id, chunks, guests, density): (2 chunks + 10 guests) a minute, one minute at least."""
    chunks = vault.transcript_chunks.groupBy("video_id").agg(F.count("*").alias("chunks"))
    guests = vault.guest_appearances.groupBy("video_id").agg(F.count("*").alias("guests"))
    joined = vault.videos.select("video_id", "duration_seconds").join(chunks, "video_id", "left").join(guests, "video_id", "left").fillna(0, ["chunks", "guests"])
    scored = joined.withColumn("density", (2 * F.col("chunks") + 10 * F.col("guests")) / F.greatest(F.lit(1.0), F.col("duration_seconds") / 60.0))
    ranked = scored.orderBy(F.col("density").desc(), "video_id")
    return ranked if limit is None else ranked.limit(limit)


def corroboration_stats(vault: Vault) -> DataFrame:
    """(topic, clusters, claims, channels, corroboration): corroboration is the mean number of channels of a claim's cluster."""
    claims = vault.claims.select("claim_id", "topic", "cluster_id", "video_id").join(vault.videos.select("video_id", "channel_id"), "video_id")
    counts = corroboration_counts(vault)
    return claims.join(counts, "cluster_id", "left").groupBy("topic").agg(F.count_distinct("cluster_id").alias("clusters"), F.count("*").alias("claims"), F.count_distinct("channel_id").alias("channels"), F.avg("corroboration_count").alias("corroboration"))


def corroboration_counts(vault: Vault) -> DataFrame:
    """(cluster_id, corroboration_count): distinct channels of each cluster."""
    pairs = vault.claims.select("cluster_id", "video_id").filter(F.col("cluster_id").isNotNull()).join(vault.videos.select("video_id", "channel_id"), "video_id").select("cluster_id", "channel_id").distinct()
    return pairs.groupBy("cluster_id").agg(F.count("*").alias("corroboration_count"))


def topic_coverage(vault: Vault, days: DataFrame | None = None) -> DataFrame:
    """(name, videos, channels, first_day, last_day, seconds, score, level, gaps) of each topic; seconds counts a video once. days: of topic_days(), where they are known."""
    if days is None:
        videos = vault.videos.select("video_id", "channel_id", F.col("upload_date").alias("day"), F.col("duration_seconds").alias("seconds"))
        days = chunk_topics(vault).select("video_id", "name").distinct().join(videos, "video_id").withColumn("videos", F.lit(1))
    facts = days.groupBy("name").agg(F.sum("videos").alias("videos"), F.count_distinct("channel_id").alias("channels"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("seconds").alias("seconds"))
    span = F.coalesce(F.datediff("last_day", "first_day"), F.lit(0))
    score = 0.4 * F.least(F.col("videos") / 10.0, F.lit(1.0)) + 0.4 * F.least(F.col("channels") / 3.0, F.lit(1.0)) + 0.2 * F.least(span / 365.0, F.lit(1.0))
    gaps = F.array_compact(F.array(F.when(F.col("channels") < 2, "few channels"), F.when(F.col("videos") < 5, "few videos"), F.when(span < 180, "short time span")))
    return facts.withColumn("score", score).withColumn("level", F.when(F.col("score") > 0.8, "High").when(F.col("score") > 0.4, "Moderate").otherwise("Low")).withColumn("gaps", gaps)


def vault_gaps(vault: Vault, below: float = 0.6) -> DataFrame:
    return topic_coverage(vault).filter(F.col("score") < below).orderBy("score", "name")


def suggestions(vault: Vault) -> DataFrame:
    """(name, suggestions): what to take in for each topic with gaps."""
    has = lambda gap: F.array_contains("gaps", gap)
    found = F.array_compact(F.array(F.when(has("few channels"), F.concat(F.lit("other channels on "), "name")), F.when(has("few videos"), F.concat(F.lit("more videos on "), "name")), F.when(has("short time span"), F.concat(F.lit("older videos on "), "name"))))
    return topic_coverage(vault).select("name", found.alias("suggestions"))


def topic_sentiment(sentiment: DataFrame) -> DataFrame:
    """(topic, score, label, distribution) from rows (topic, score, label)."""
    each = sentiment.groupBy("topic", "label").agg(F.count("*").alias("n"), F.sum("score").alias("total"))
    out = each.groupBy("topic").agg((F.sum("total") / F.sum("n")).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("distribution"))
    return out.withColumn("label", F.when(F.col("score") > 0.2, "Positive").when(F.col("score") < -0.2, "Negative").otherwise("Neutral"))


def channel_video_counts(vault: Vault) -> DataFrame:
    """(channel_id, total_videos, processed_videos) of every channel."""
    counts = vault.videos.groupBy("channel_id").agg(F.count("*").alias("total_videos"), F.count_if(F.col("checkpoint_stage") == "DONE").alias("processed_videos"))
    return vault.channels.select("channel_id").join(counts, "channel_id", "left").fillna(0)


def _metrics() -> list[Column]:
    ok = F.col("status") == "SUCCESS"
    return [F.count("*").alias("n"), F.avg("duration_seconds").alias("mean_s"), F.min("duration_seconds").alias("least_s"), F.max("duration_seconds").alias("most_s"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed")]


def aggregate_metrics(vault: Vault, since: object = None, by_stage: bool = True) -> DataFrame:
    df = vault.pipeline_metrics if since is None else vault.pipeline_metrics.filter(F.col("started_at") >= F.lit(since))
    out = df.groupBy("stage").agg(*_metrics()) if by_stage else df.agg(*_metrics())
    return out.withColumn("success_percent", F.round(F.try_divide(100.0 * F.col("succeeded"), F.col("n")), 2))


def latest_scan_metrics(vault: Vault) -> DataFrame:
    """Metrics by stage of the scan that began last."""
    last = vault.pipeline_metrics.agg(F.max_by("scan_id", F.struct("started_at", "metric_id")).alias("scan_id"))
    return vault.pipeline_metrics.join(F.broadcast(last), "scan_id").groupBy("scan_id", "stage").agg(*_metrics())  # one row


def high_momentum(vault: Vault, now: object, limit: int | None = 5, least_hours: float = 0.1) -> DataFrame:
    """(video_id, growth, hours, velocity): views gained since the first snapshot, by the hour."""
    first = vault.video_stats_history.groupBy("video_id").agg(F.min_by("view_count", F.struct("snapshot_at", "history_id")).alias("before"), F.min("snapshot_at").alias("since"))
    hours = F.timestamp_diff("SECOND", F.col("since").cast("timestamp"), F.lit(now).cast("timestamp")) / 3600.0
    out = vault.videos.select("video_id", "view_count").join(first, "video_id").select("video_id", (F.col("view_count") - F.col("before")).alias("growth"), hours.alias("hours")).filter(F.col("hours") > least_hours)
    out = out.withColumn("velocity", F.col("growth") / F.greatest(F.lit(0.1), F.col("hours"))).orderBy((F.col("growth") / (F.col("hours") + 0.01)).desc(), "video_id")
    return out if limit is None else out.limit(limit)


def error_summary(vault: Vault, prefix: int = 50) -> DataFrame:
    errors = vault.pipeline_logs.filter(F.col("level") == "ERROR")
    return errors.groupBy("stage", F.substring("message", 1, prefix).alias("message")).agg(F.count("*").alias("n"), F.count_distinct("video_id").alias("videos"), F.max("timestamp").alias("latest"))


def log_timeline(vault: Vault) -> DataFrame:
    """(video_id, n_logs, n_errors, first_at, last_at) of each video's log."""
    return vault.pipeline_logs.groupBy("video_id").agg(F.count("*").alias("n_logs"), F.count_if(F.col("level") == "ERROR").alias("n_errors"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))


def rejection_breakdown(vault: Vault, limit: int = 5) -> DataFrame:
    rejected = vault.videos.filter(F.col("triage_status") == "REJECTED")
    out = rejected.groupBy(F.split_part("triage_reason", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"), F.avg("triage_confidence").alias("confidence"))
    return out.orderBy(F.col("n").desc(), "reason").limit(limit)


def vault_diagnostics(vault: Vault) -> DataFrame:
    """One row: whole percent of accepted videos with a transcript and with a claim."""
    accepted = vault.videos.filter(F.col("triage_status") == "ACCEPTED").select("video_id")
    for name in ("transcript_chunks", "claims"):
        accepted = accepted.join(getattr(vault, name).select("video_id").distinct().withColumn(name, F.lit(1)), "video_id", "left")
    share = lambda c: F.expr(f"coalesce(count({c}) * 100 div nullif(count(*), 0), 0)")
    return accepted.agg(F.count("*").alias("accepted"), share("transcript_chunks").alias("transcript_percent"), share("claims").alias("claim_percent"))


def topic_mind_map(vault: Vault, least: int = 2) -> DataFrame:
    """(video_id, topic_a, topic_b, n): pairs of topics that share chunks of a video. A chunk has a handful of topics."""
    lists = chunk_topics(vault).groupBy("video_id", "chunk_id").agg(F.array_sort(F.collect_set("name")).alias("t"))
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda b: F.struct(a.alias("topic_a"), b.alias("topic_b")))))
    return lists.select("video_id", F.inline(pairs)).groupBy("video_id", "topic_a", "topic_b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
