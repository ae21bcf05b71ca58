"""Queries of the engine's own operators, with the DuckDB SQL of their results."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import fixtures
from lodestone.operators import aggregates as A
from lodestone.operators import graph as G
from lodestone.operators import relational as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = dt.datetime(2024, 2, 1)
_SPAN = "(SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY snapshot_at, history_id) AS pos, history_id, view_count FROM video_stats_history)"


def query(name: str, sql: str | None = None):
    """Registers a function of a vault; sql reads the fixture views by name."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(fixtures.vault(spark, sf_dir))
        if sql:
            SQL[name] = fixtures.oracle(sql)
        return f

    return add


def heat(v) -> DataFrame:
    """Intervals for heat operators: events of a user in order, as (video_id, pos, start, end, score)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("video_id").orderBy("snapshot_at", "history_id")
    pos = F.row_number().over(w)
    h = v.tables["video_stats_history"].withColumn("pos", pos)
    return h.select("video_id", "pos", (F.col("pos") * 10.0 - 10).alias("start"), (F.col("pos") * 10.0).alias("end"), (F.col("view_count") % 100 / 100.0).alias("score"))


_HEAT = "(SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY snapshot_at, history_id) AS pos, view_count % 100 / 100.0::double AS score FROM video_stats_history)"

query("consolidated_topics", """SELECT t.name, count(DISTINCT v.channel_id) AS channel_count, count(DISTINCT t.video_id) AS video_count, string_agg(DISTINCT c.name, ',' ORDER BY c.name) AS channels
    FROM chunk_topics t JOIN videos v USING (video_id) LEFT JOIN channels c ON c.channel_id = v.channel_id GROUP BY t.name""")(A.consolidated_topics)
query("pipeline_stats", """SELECT count(*) AS total, count(*) FILTER (triage_status = 'DISCOVERED') AS discovered, count(*) FILTER (triage_status = 'ACCEPTED') AS accepted, count(*) FILTER (triage_status = 'REJECTED') AS rejected,
    count(*) FILTER (triage_status = 'PENDING_REVIEW') AS pending_review, count(*) FILTER (triage_status = 'ACCEPTED' AND checkpoint_stage IN ('SUMMARIZED', 'GRAPH_SYNCED', 'DONE')) AS done,
    count(*) FILTER (triage_status = 'ACCEPTED' AND checkpoint_stage NOT IN ('SUMMARIZED', 'GRAPH_SYNCED', 'DONE')) AS in_progress,
    least(2880, count(*) FILTER (triage_status = 'ACCEPTED' AND checkpoint_stage NOT IN ('SUMMARIZED', 'GRAPH_SYNCED', 'DONE')) * 25 // 60) AS eta_minutes FROM videos""")(A.pipeline_stats)
query("status_histogram", "SELECT triage_status, count(*) AS n FROM videos GROUP BY 1")(A.status_histogram)
query("stage_histogram", "SELECT checkpoint_stage, count(*) AS n FROM videos WHERE triage_status = 'ACCEPTED' GROUP BY 1")(lambda v: A.status_histogram(v, "checkpoint_stage", F.col("triage_status") == "ACCEPTED"))
query("language_histogram", "SELECT language_iso, count(*) AS n FROM videos GROUP BY 1")(lambda v: A.status_histogram(v, "language_iso"))
query("translation_backlog", "SELECT needs_translation, count(*) AS n FROM videos WHERE triage_status = 'ACCEPTED' GROUP BY 1")(lambda v: A.status_histogram(v, "needs_translation", F.col("triage_status") == "ACCEPTED"))
query("indexed_videos", "SELECT count(DISTINCT video_id) AS n FROM transcript_chunks")(A.indexed_videos)
query("store_stats", "SELECT (SELECT count(*) FROM channels) AS channels, (SELECT count(*) FROM videos) AS videos, (SELECT count(*) FROM transcript_chunks) AS transcript_chunks, (SELECT count(*) FROM claims) AS claims")(A.store_stats)
query("topic_trends", "SELECT t.name, strftime(v.upload_date, '%Y-%m') AS month, count(DISTINCT t.video_id) AS n FROM chunk_topics t JOIN videos v USING (video_id) GROUP BY 1, 2")(A.topic_trends)
query("topic_mentions_over_time", "SELECT v.upload_date AS day, count(DISTINCT t.chunk_id) AS n FROM chunk_topics t JOIN videos v USING (video_id) WHERE contains(lower(t.name), 'r') GROUP BY 1")(lambda v: A.topic_mentions_over_time(v, "R"))
query("topic_velocity", """SELECT name, mentions, round(velocity, 6) AS velocity, CASE WHEN velocity > 1.5 THEN 'rising' WHEN velocity < 0.5 THEN 'declining' ELSE 'stable' END AS trend FROM (
    SELECT name, cast(sum(n) AS bigint) AS mentions, CASE WHEN count(*) >= 4 THEN avg(n) FILTER (rn <= 2) / avg(n) FILTER (rn > 2) ELSE 1.0 END AS velocity FROM (
    SELECT t.name, v.upload_date AS day, count(DISTINCT t.chunk_id) AS n, row_number() OVER (PARTITION BY t.name ORDER BY v.upload_date DESC) AS rn FROM chunk_topics t JOIN videos v USING (video_id) GROUP BY 1, 2) GROUP BY name)""")(lambda v: A.topic_velocity(v).withColumn("velocity", F.round("velocity", 6)))
query("video_topics", "SELECT video_id, lower(trim(name)) AS name, round(max(relevance), 6) AS relevance FROM chunk_topics GROUP BY 1, 2")(lambda v: A.video_topics(v).withColumn("relevance", F.round("relevance", 6)))
query("video_topics_summary", "SELECT * FROM (SELECT video_id, name, row_number() OVER (PARTITION BY video_id ORDER BY relevance DESC, name) AS rank FROM (SELECT video_id, lower(trim(name)) AS name, max(relevance) AS relevance FROM chunk_topics GROUP BY 1, 2)) WHERE rank <= 10")(lambda v: A.video_topics_summary(v).select("video_id", "name", F.col("rank").cast("long")))
query("density_leaderboard", """SELECT v.video_id, coalesce(c.n, 0) AS chunks, coalesce(g.n, 0) AS guests, round((2 * coalesce(c.n, 0) + 10 * coalesce(g.n, 0)) / greatest(1.0::double, v.duration_seconds / 60.0::double), 6) AS density FROM videos v
    LEFT JOIN (SELECT video_id, count(*) AS n FROM transcript_chunks GROUP BY 1) c USING (video_id) LEFT JOIN (SELECT video_id, count(*) AS n FROM guest_appearances GROUP BY 1) g USING (video_id)
    ORDER BY (2 * coalesce(c.n, 0) + 10 * coalesce(g.n, 0)) / greatest(1.0::double, v.duration_seconds / 60.0::double) DESC, v.video_id LIMIT 10""")(lambda v: A.density_leaderboard(v).select("video_id", "chunks", "guests", F.round("density", 6).alias("density")))
query("corroboration_counts", "SELECT c.cluster_id, count(DISTINCT v.channel_id) AS corroboration_count FROM claims c JOIN videos v USING (video_id) GROUP BY 1")(A.corroboration_counts)
query("corroboration_stats", """SELECT topic, count(DISTINCT cluster_id) AS clusters, count(*) AS claims, count(DISTINCT channel_id) AS channels, round(avg(n), 6) AS corroboration FROM claims JOIN videos USING (video_id)
    JOIN (SELECT c.cluster_id, count(DISTINCT v.channel_id) AS n FROM claims c JOIN videos v USING (video_id) GROUP BY 1) USING (cluster_id) GROUP BY topic""")(lambda v: A.corroboration_stats(v).withColumn("corroboration", F.round("corroboration", 6)))
_COVER = """SELECT name, videos, channels, first_day, last_day, seconds, 0.4::double * least(videos / 10.0::double, 1.0) + 0.4::double * least(channels / 3.0::double, 1.0) + 0.2::double * least((last_day - first_day) / 365.0::double, 1.0) AS score FROM (
    SELECT t.name, count(*) AS videos, count(DISTINCT v.channel_id) AS channels, min(v.upload_date) AS first_day, max(v.upload_date) AS last_day, cast(sum(v.duration_seconds) AS bigint) AS seconds
    FROM (SELECT DISTINCT video_id, name FROM chunk_topics) t JOIN videos v USING (video_id) GROUP BY 1)"""
query("topic_coverage", f"SELECT name, videos, channels, first_day, last_day, seconds, round(score, 6) AS score, CASE WHEN score > 0.8 THEN 'High' WHEN score > 0.4 THEN 'Moderate' ELSE 'Low' END AS level, concat_ws(',', CASE WHEN channels < 2 THEN 'few channels' END, CASE WHEN videos < 5 THEN 'few videos' END, CASE WHEN last_day - first_day < 180 THEN 'short time span' END) AS gaps FROM ({_COVER})")(lambda v: A.topic_coverage(v).withColumn("gaps", F.array_join("gaps", ",")).withColumn("score", F.round("score", 6)))
query("vault_gaps", f"SELECT name, round(score, 6) AS score FROM ({_COVER}) WHERE score < 2")(lambda v: A.vault_gaps(v, 2.0).select("name", F.round("score", 6).alias("score")))
query("topic_sentiment", """SELECT topic, round(avg(score), 6) AS score, CASE WHEN avg(score) > 0.2 THEN 'Positive' WHEN avg(score) < -0.2 THEN 'Negative' ELSE 'Neutral' END AS label, count(*) FILTER (label = 'Positive') AS positive
    FROM video_sentiment GROUP BY topic""")(lambda v: A.topic_sentiment(v.video_sentiment).select("topic", F.round("score", 6).alias("score"), "label", F.coalesce(F.try_element_at("distribution", F.lit("Positive")), F.lit(0)).alias("positive")))
query("channel_video_counts", "SELECT c.channel_id, count(v.video_id) AS total_videos, count(*) FILTER (v.checkpoint_stage = 'DONE') AS processed_videos FROM channels c LEFT JOIN videos v USING (channel_id) GROUP BY 1")(A.channel_video_counts)
_METRICS = "count(*) AS n, round(avg(duration_seconds), 6) AS mean_s, min(duration_seconds) AS least_s, max(duration_seconds) AS most_s, count(*) FILTER (status = 'SUCCESS') AS succeeded, count(*) FILTER (status <> 'SUCCESS') AS failed"
query("stage_metrics", f"SELECT stage, {_METRICS}, round(100.0::double * count(*) FILTER (status = 'SUCCESS') / count(*), 2) AS success_percent FROM pipeline_metrics GROUP BY stage")(lambda v: A.aggregate_metrics(v).withColumn("mean_s", F.round("mean_s", 6)))
query("recent_metrics", f"SELECT {_METRICS}, round(100.0::double * count(*) FILTER (status = 'SUCCESS') / count(*), 2) AS success_percent FROM pipeline_metrics WHERE started_at >= TIMESTAMP '2024-01-15'")(lambda v: A.aggregate_metrics(v, dt.datetime(2024, 1, 15), False).withColumn("mean_s", F.round("mean_s", 6)))
query("latest_scan_metrics", f"SELECT scan_id, stage, {_METRICS} FROM pipeline_metrics WHERE scan_id = (SELECT arg_max(scan_id, (started_at, metric_id)) FROM pipeline_metrics) GROUP BY 1, 2")(lambda v: A.latest_scan_metrics(v).withColumn("mean_s", F.round("mean_s", 6)))
query("high_momentum", """SELECT video_id, growth, round(hours, 6) AS hours, round(growth / greatest(0.1::double, hours), 6) AS velocity FROM (SELECT v.video_id, v.view_count - f.before AS growth, floor(epoch(TIMESTAMP '2024-02-01') - epoch(since)) / 3600.0::double AS hours FROM videos v
    JOIN (SELECT video_id, arg_min(view_count, (snapshot_at, history_id)) AS before, min(snapshot_at) AS since FROM video_stats_history GROUP BY 1) f USING (video_id)) WHERE hours > 0.1 ORDER BY growth / (hours + 0.01::double) DESC, video_id LIMIT 20""")(lambda v: A.high_momentum(v, NOW, 20).select("video_id", "growth", F.round("hours", 6).alias("hours"), F.round("velocity", 6).alias("velocity")))
query("error_summary", "SELECT stage, substring(message, 1, 50) AS message, count(*) AS n, count(DISTINCT video_id) AS videos, max(timestamp) AS latest FROM pipeline_logs WHERE level = 'ERROR' GROUP BY 1, 2")(A.error_summary)
query("log_timeline", "SELECT video_id, count(*) AS n_logs, count(*) FILTER (level = 'ERROR') AS n_errors, min(timestamp) AS first_at, max(timestamp) AS last_at FROM pipeline_logs GROUP BY 1")(A.log_timeline)
query("rejection_breakdown", "SELECT split_part(triage_reason, ':', 1) AS reason, count(*) AS n, round(avg(triage_confidence), 6) AS confidence FROM videos WHERE triage_status = 'REJECTED' GROUP BY 1 ORDER BY n DESC, reason LIMIT 5")(lambda v: A.rejection_breakdown(v).withColumn("confidence", F.round("confidence", 6)))
query("vault_diagnostics", """SELECT count(*) AS accepted, count(*) FILTER (video_id IN (SELECT video_id FROM transcript_chunks)) * 100 // count(*) AS transcript_percent, count(*) FILTER (video_id IN (SELECT video_id FROM claims)) * 100 // count(*) AS claim_percent
    FROM videos WHERE triage_status = 'ACCEPTED'""")(A.vault_diagnostics)
query("topic_mind_map", """SELECT a.video_id, a.name AS topic_a, b.name AS topic_b, count(DISTINCT a.chunk_id) AS n FROM chunk_topics a JOIN chunk_topics b ON a.chunk_id = b.chunk_id AND a.name < b.name GROUP BY 1, 2, 3 HAVING count(DISTINCT a.chunk_id) >= 2""")(A.topic_mind_map)

_CT = "(SELECT v.channel_id, t.name, count(*) AS n FROM (SELECT DISTINCT video_id, name FROM chunk_topics) t JOIN videos v USING (video_id) GROUP BY 1, 2)"
_GT = "(SELECT g.guest_id, t.name, count(*) AS n FROM guest_appearances g JOIN (SELECT DISTINCT video_id, name FROM chunk_topics) t USING (video_id) GROUP BY 1, 2)"
query("cross_channel_topics", f"SELECT a.name, a.channel_id AS channel_a, b.channel_id AS channel_b, a.n * b.n AS strength FROM {_CT} a JOIN {_CT} b ON a.name = b.name AND a.channel_id <> b.channel_id")(lambda v: G.cross_channel_topics(v, None))
query("echo_chambers", f"SELECT a.channel_id AS channel_a, b.channel_id AS channel_b, count(*) AS shared FROM {_CT} a JOIN {_CT} b ON a.name = b.name AND a.channel_id < b.channel_id GROUP BY 1, 2 HAVING count(*) >= 3")(lambda v: G.echo_chambers(v, 3, None))
query("guest_network", f"SELECT a.guest_id AS guest_a, b.guest_id AS guest_b, string_agg(a.name, ',' ORDER BY a.name) AS topics, count(*) AS shared FROM {_GT} a JOIN {_GT} b ON a.name = b.name AND a.guest_id < b.guest_id GROUP BY 1, 2")(G.guest_pairs)
query("guest_topics", f"SELECT guest_id, name, n AS videos FROM {_GT}")(G.guest_topics)
query("topic_cooccurrence", "SELECT a.name AS topic_a, b.name AS topic_b, count(*) AS n FROM (SELECT DISTINCT video_id, name FROM chunk_topics) a JOIN (SELECT DISTINCT video_id, name FROM chunk_topics) b ON a.video_id = b.video_id AND a.name < b.name GROUP BY 1, 2")(G.topic_cooccurrence)
query("central_authorities", f"SELECT c.channel_id, count(t.name) AS topics FROM channels c LEFT JOIN {_CT} t USING (channel_id) GROUP BY 1")(lambda v: G.central_authorities(v, None))
query("topic_authorities", f"""(SELECT 'Channel' AS kind, channel_id AS id, cast(sum(n) AS bigint) AS n FROM {_CT} WHERE contains(name, 're') GROUP BY 2 ORDER BY n DESC, id LIMIT 5) UNION ALL
    (SELECT 'Guest', cast(guest_id AS string), cast(sum(n) AS bigint) AS n FROM {_GT} WHERE contains(name, 're') GROUP BY guest_id ORDER BY n DESC, guest_id LIMIT 5)""")(lambda v: G.topic_authorities(v, "RE"))
query("guest_evolution", "SELECT video_id, upload_date, name FROM guest_appearances JOIN videos USING (video_id) JOIN (SELECT DISTINCT video_id, name FROM chunk_topics) USING (video_id) WHERE guest_id = 7")(lambda v: G.guest_evolution(v, 7))
query("guest_appearances_of", "SELECT video_id, title, channel_id, upload_date, c.name AS channel_name FROM guest_appearances JOIN videos USING (video_id) LEFT JOIN channels c USING (channel_id) WHERE guest_id = 7")(lambda v: G.guest_appearance_list(v, 7))
query("shared_videos", """SELECT video_id, count(*) AS shared, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT video_id, concat('topic:', name) AS label FROM chunk_topics UNION SELECT video_id, concat('guest:', cast(guest_id AS string)) FROM guest_appearances)
    WHERE video_id <> '4' AND label IN (SELECT concat('topic:', name) FROM chunk_topics WHERE video_id = '4' UNION SELECT concat('guest:', cast(guest_id AS string)) FROM guest_appearances WHERE video_id = '4') GROUP BY 1 ORDER BY shared DESC, video_id LIMIT 10""")(lambda v: G.shared_videos(v, "4").withColumn("labels", F.array_join("labels", ",")))
_EDGES = """(SELECT concat('channel:', channel_id) AS src, concat('video:', video_id) AS dst, 'PUBLISHED' AS type FROM videos UNION ALL SELECT DISTINCT concat('guest:', cast(guest_id AS string)), concat('video:', video_id), 'APPEARED_IN' FROM guest_appearances
    UNION ALL SELECT DISTINCT concat('video:', video_id), concat('topic:', name), 'DISCUSSES' FROM chunk_topics
    UNION ALL SELECT DISTINCT concat('topic:', a.name), concat('topic:', b.name), 'RELATED_TO' FROM chunk_topics a JOIN chunk_topics b ON a.video_id = b.video_id AND a.name < b.name)"""
_WEIGHTED = """(SELECT concat('channel:', channel_id) AS src, concat('video:', video_id) AS dst, 'PUBLISHED' AS type, 1.0::double AS weight FROM videos UNION ALL SELECT DISTINCT concat('guest:', cast(guest_id AS string)), concat('video:', video_id), 'APPEARED_IN', 1.0 FROM guest_appearances
    UNION ALL SELECT concat('video:', video_id), concat('topic:', name), 'DISCUSSES', max(relevance)::double FROM chunk_topics GROUP BY video_id, name
    UNION ALL SELECT concat('topic:', a.name), concat('topic:', b.name), 'RELATED_TO', count(DISTINCT a.video_id)::double FROM chunk_topics a JOIN chunk_topics b ON a.video_id = b.video_id AND a.name < b.name GROUP BY a.name, b.name)"""
query("graph_stats", f"SELECT split_part(id, ':', 1) AS label, count(*) AS n FROM (SELECT src AS id FROM {_EDGES} UNION SELECT dst FROM {_EDGES}) GROUP BY 1 UNION ALL SELECT type, count(*) FROM {_EDGES} GROUP BY 1")(G.vault_stats)
query("degrees", f"SELECT id, count(*) AS degree FROM (SELECT src AS id FROM {_EDGES} UNION ALL SELECT dst FROM {_EDGES}) GROUP BY 1")(lambda v: G.degrees(G.edges_of(v)))
query("neighbourhood", f"SELECT DISTINCT CASE WHEN src = 'topic:small' THEN dst ELSE src END AS dst, type, round(weight, 6) AS weight FROM {_WEIGHTED} WHERE src = 'topic:small' OR dst = 'topic:small'")(lambda v: G.neighbourhood(G.edges_of(v), "topic:small", None).withColumn("weight", F.round("weight", 6)))
query("distances", f"""SELECT id, min(d) AS distance FROM (SELECT 'guest:7' AS id, 0 AS d UNION ALL SELECT dst, 1 FROM {_EDGES} WHERE src = 'guest:7' UNION ALL
    SELECT CASE WHEN e.src = f.dst THEN e.dst ELSE e.src END, 2 FROM {_EDGES} e JOIN (SELECT dst FROM {_EDGES} WHERE src = 'guest:7') f ON e.src = f.dst OR e.dst = f.dst) GROUP BY 1""")(lambda v: G.distances(G.links_of(v), "guest:7", 2).select("id", "distance"))
query("shortest_path", """SELECT concat('guest:7 > ', via, ' > channel:3') AS path, cast(2 AS int) AS length FROM (SELECT min(concat('video:', video_id)) AS via FROM guest_appearances JOIN videos USING (video_id) WHERE guest_id = 7 AND channel_id = '3') WHERE via IS NOT NULL""")(
    lambda v: G.shortest_path(G.links_of(v), "guest:7", "channel:3", 3).withColumn("path", F.array_join("path", " > "))
)

query("videos_by_status", "SELECT video_id, channel_id, created_at FROM videos WHERE triage_status = 'ACCEPTED' AND NOT is_deleted ORDER BY created_at DESC, video_id LIMIT 500")(lambda v: R.videos_by_status(v, "ACCEPTED").select("video_id", "channel_id", "created_at"))
query("videos_by_channel", "SELECT video_id, upload_date FROM videos WHERE channel_id IN ('3', '4')")(lambda v: R.videos_by_channel(v, ["3", "4"]).select("video_id", "upload_date"))
query("resumable_videos", "SELECT video_id FROM videos WHERE triage_status = 'ACCEPTED' AND checkpoint_stage <> 'DONE' AND locked_by_scan_id IS NULL")(lambda v: R.resumable_videos(v).select("video_id"))
query("manually_overridden", "SELECT video_id FROM videos WHERE triage_status = 'ACCEPTED' AND checkpoint_stage = 'METADATA_HARVESTED' AND contains(triage_reason, 'manual_override') ORDER BY created_at DESC, video_id LIMIT 100")(lambda v: R.manually_overridden(v).select("video_id"))
query("search_claims", "SELECT claim_id, claim_text FROM claims WHERE contains(lower(claim_text), 'small') ORDER BY confidence DESC, claim_id LIMIT 20")(lambda v: R.search_claims(v, "SMALL").select("claim_id", "claim_text"))
query("top_performing", "SELECT video_id, view_count FROM videos WHERE NOT is_deleted ORDER BY view_count DESC, video_id LIMIT 10")(lambda v: R.top_performing(v).select("video_id", "view_count"))
query("most_engaged", "SELECT video_id, round((like_count + comment_count)::double / nullif(view_count, 0), 9) AS engagement FROM videos WHERE view_count >= 1000 AND NOT is_deleted ORDER BY (like_count + comment_count)::double / nullif(view_count, 0) DESC, video_id LIMIT 10")(lambda v: R.most_engaged(v).select("video_id", F.round("engagement", 9).alias("engagement")))
query("logs", "SELECT log_id, message FROM pipeline_logs WHERE scan_id = '3' AND level = 'ERROR' ORDER BY timestamp DESC, log_id DESC LIMIT 1000")(lambda v: R.logs(v, scan_id="3", level="ERROR").select("log_id", "message"))
query("missing_transcripts", "SELECT video_id FROM videos WHERE triage_status = 'ACCEPTED' AND video_id NOT IN (SELECT video_id FROM transcript_chunks)")(lambda v: R.missing_transcripts(v, None).select("video_id"))
query("full_transcripts", "SELECT video_id, string_agg(cleaned_text, ' ' ORDER BY chunk_index) AS transcript, count(*) AS n_chunks, cast(sum(word_count) AS bigint) AS n_words FROM transcript_chunks GROUP BY 1")(R.full_transcripts)
query("transcript_at", "SELECT chunk_id, cleaned_text FROM transcript_chunks WHERE video_id = '4' AND start_timestamp <= 35 AND end_timestamp >= 5")(lambda v: R.transcript_at(v, "4", 20, 15).select("chunk_id", "cleaned_text"))
query("strip_intervals", f"SELECT video_id, pos FROM {_HEAT} s WHERE NOT EXISTS (SELECT 1 FROM {_HEAT} k WHERE k.video_id = s.video_id AND k.score >= 0.8 AND s.pos * 10 - 5 BETWEEN k.pos * 10 - 20 AND k.pos * 10)")(
    lambda v: R.strip_intervals(heat(v).withColumn("duration", F.lit(10.0)), heat(v).filter("score >= 0.8").select("video_id", (F.col("start") - 10).alias("start"), "end")).select("video_id", F.col("pos").cast("long"))
)
query("heat_islands", f"""SELECT video_id, island, min(pos) * 10.0::double - 10 AS start, max(pos) * 10.0::double AS "end", max(score) AS score FROM (SELECT *, sum(first) OVER (PARTITION BY video_id ORDER BY pos)::bigint AS island FROM (
    SELECT *, CASE WHEN score >= 0.7 AND coalesce(lag(score) OVER (PARTITION BY video_id ORDER BY pos), 0) < 0.7 THEN 1 ELSE 0 END AS first FROM {_HEAT})) WHERE score >= 0.7 GROUP BY 1, 2""")(lambda v: R.islands(heat(v), 0.7))
query("high_attention", f"""WITH h AS {_HEAT}, cut AS (SELECT video_id, list_sort(list(score)) AS v FROM h GROUP BY 1), hot AS (SELECT h.* FROM h JOIN cut USING (video_id) WHERE score >= v[len(v) - greatest(1, floor(0.2::double * len(v))::int) + 1])
    SELECT chunk_id, EXISTS (SELECT 1 FROM hot WHERE hot.video_id = c.video_id AND hot.pos * 10 - 10 <= c.end_timestamp AND hot.pos * 10 >= c.start_timestamp
    AND (least(c.end_timestamp, hot.pos * 10) - greatest(c.start_timestamp, hot.pos * 10 - 10)) / greatest(1.0, c.end_timestamp - c.start_timestamp) >= 0.3) AS is_high_attention FROM transcript_chunks c""".replace("WITH h", "WITH_H"))(
    lambda v: R.high_attention(v.transcript_chunks, heat(v)).select("chunk_id", "is_high_attention")
)
query("new_ids", "SELECT DISTINCT video_id FROM pipeline_logs WHERE video_id NOT IN (SELECT video_id FROM videos WHERE triage_status = 'ACCEPTED')")(lambda v: R.new_ids(v.pipeline_logs, v.videos.filter("triage_status = 'ACCEPTED'")))
query("repair_plan", """SELECT video_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM (SELECT video_id, 'override' AS reason FROM videos WHERE triage_status = 'ACCEPTED' AND checkpoint_stage = 'METADATA_HARVESTED' AND contains(triage_reason, 'manual_override')
    UNION SELECT video_id, 'transcript' FROM videos WHERE triage_status = 'ACCEPTED' AND video_id NOT IN (SELECT video_id FROM transcript_chunks) UNION SELECT video_id, 'summary' FROM videos WHERE triage_status = 'ACCEPTED' AND checkpoint_stage IN ('CHUNK_ANALYZED', 'DONE')) GROUP BY 1""")(
    lambda v: R.repair_plan(v).select("video_id", F.array_join("reasons", ",").alias("reasons"))
)
for _name in SQL:
    SQL[_name] = SQL[_name].replace("WITH_H", ", h") if "WITH_H" in SQL[_name] else SQL[_name]
    SQL[_name] = SQL[_name].replace(") , h AS", "), h AS")
