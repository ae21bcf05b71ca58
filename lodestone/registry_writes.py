"""Sequences of writes over whole tables, and the lookups that read them back, with SQL over every column; registered on import."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.cut import stored
from lodestone.operators import graph as G
from lodestone.operators import lifecycle as L
from lodestone.operators import relational as R
from lodestone.registry import query
from lodestone.sources import export
from lodestone.vault import tasks, upsert

LATER = dt.datetime(2024, 3, 1)


def _having(v, *names: str):
    return v.having(**{n: v.tables[n] for n in names})


def _long(c: str):
    return F.col(c).cast("long")


def channels_saved(v) -> DataFrame:
    new = v.channels.select((_long("channel_id") + 10).cast("string").alias("channel_id"), F.concat(F.lit("new "), "name").alias("name"), F.lit("NEW").alias("category"))
    return L.save(_having(v, "channels"), "channels", new).channels


query("write_channels", "SELECT coalesce(a.channel_id, b.channel_id) AS channel_id, coalesce(b.name, a.name) AS name, coalesce(a.category, b.category) AS category FROM channels a FULL JOIN (SELECT cast(channel_id::bigint + 10 AS string) AS channel_id, concat('new ', name) AS name, 'NEW' AS category FROM channels) b ON a.channel_id = b.channel_id")(channels_saved)

_VIDEO = ["video_id", "channel_id", "title", "view_count", "like_count", "triage_status", "checkpoint_stage", "language_iso"]


def videos_saved(v) -> DataFrame:
    """A second harvest: counts are replaced, what was decided stays; every third video comes back, and as many new ones."""
    again = v.videos.filter(_long("video_id") % 3 == 0).withColumns({"title": F.lit("changed"), "view_count": F.col("view_count") + 5, "like_count": F.col("like_count") + 1, "triage_status": F.lit("DISCOVERED"), "checkpoint_stage": F.lit("METADATA_HARVESTED"), "language_iso": F.lit("xx")})
    fresh = again.withColumn("video_id", F.concat(F.lit("n"), "video_id"))
    kept = v.having(videos=v.videos.select(*_VIDEO))
    return L.save(kept, "videos", again.unionByName(fresh).select(*_VIDEO)).videos


query("write_videos", """SELECT video_id, channel_id, title, view_count + CASE WHEN k % 3 = 0 THEN 5 ELSE 0 END AS view_count, like_count + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS like_count, triage_status, checkpoint_stage, CASE WHEN k % 3 = 0 THEN 'xx' ELSE language_iso END AS language_iso FROM (SELECT *, video_id::bigint AS k FROM videos)
    UNION ALL SELECT concat('n', video_id), channel_id, 'changed', view_count + 5, like_count + 1, 'DISCOVERED', 'METADATA_HARVESTED', 'xx' FROM videos WHERE video_id::bigint % 3 = 0""")(videos_saved)


def guests_saved(v) -> DataFrame:
    """Guests met again: mentions add up, aliases are united, the first kind of entity stays."""
    old = v.having(guests=v.guests.withColumn("aliases", F.array(F.lower("canonical_name"))))
    new = v.guests.select("guest_id", "canonical_name", F.array(F.lower("canonical_name"), F.upper("canonical_name")).alias("aliases"), F.lit("OTHER").alias("entity_type"), F.lit(3).cast("long").alias("mention_count"))
    return L.save(old, "guests", new).guests.withColumn("aliases", F.array_join("aliases", ";"))


query("write_guests", "SELECT guest_id, canonical_name, entity_type, mention_count + 3 AS mention_count, concat(lower(canonical_name), ';', upper(canonical_name)) AS aliases FROM guests")(guests_saved)


def appearances_saved(v) -> DataFrame:
    """Appearances are added where the key is new: the same ones again change nothing, later moments count."""
    old = v.having(guest_appearances=v.guest_appearances.withColumn("start_timestamp", F.lit(0.0)))
    return old.append("guest_appearances", old.guest_appearances, ignore=True).append("guest_appearances", old.guest_appearances.withColumn("start_timestamp", F.lit(5.0)), ignore=True).guest_appearances


query("write_appearances", "SELECT guest_id, video_id, t::double AS start_timestamp FROM guest_appearances, (SELECT unnest([0, 5]) AS t)")(appearances_saved)


def findings_saved(v) -> DataFrame:
    """Claims and quotes of a second analysis, read back for every video."""
    claims = ["claim_id", "video_id", "speaker", "claim_text", "topic"]
    old = v.having(claims=v.claims.select(*claims))
    out = old.append("claims", old.claims.withColumns({"claim_id": -F.col("claim_id") - 1, "speaker": F.lit("again")}))
    out = out.append("quotes", old.claims.select(F.col("claim_id").alias("quote_id"), "video_id", "speaker", F.upper("claim_text").alias("quote_text"), "topic"))
    return out.claims.select("claim_id", "video_id", "speaker", "claim_text", "topic").unionByName(out.quotes.select(F.col("quote_id").alias("claim_id"), "video_id", "speaker", F.col("quote_text").alias("claim_text"), "topic"))


query("write_findings", "SELECT claim_id, video_id, speaker, claim_text, topic FROM claims UNION ALL SELECT -claim_id - 1, video_id, 'again', claim_text, topic FROM claims UNION ALL SELECT claim_id, video_id, speaker, upper(claim_text), topic FROM claims")(findings_saved)


def blueprints_saved(v) -> DataFrame:
    """Steps are replaced by a second write; progress set by a third, which doesn't touch them."""
    one = v.videos.select("video_id", F.array(F.lit("a")).alias("steps"), F.create_map(F.lit("a"), F.lit(False)).alias("progress"))
    out = v.having(actionable_blueprints=one).upsert("actionable_blueprints", v.videos.filter(_long("video_id") % 2 == 0).select("video_id", F.array(F.lit("b"), F.col("title")).alias("steps")))
    out = out.upsert("actionable_blueprints", v.videos.filter(_long("video_id") % 3 == 0).select("video_id", F.create_map(F.lit("a"), F.lit(True)).alias("progress")))
    return out.actionable_blueprints.select("video_id", F.array_join("steps", ";").alias("steps"), F.to_json("progress").alias("progress"))


query("write_blueprints", """SELECT video_id, CASE WHEN k % 2 = 0 THEN concat('b;', title) ELSE 'a' END AS steps, CASE WHEN k % 3 = 0 THEN '{"a":true}' ELSE '{"a":false}' END AS progress FROM (SELECT *, video_id::bigint AS k FROM videos)""")(blueprints_saved)


def watch_list(v) -> DataFrame:
    """Monitored channels: added twice, every fifth removed, briefs noted for those of a category."""
    rows = v.channels.select("channel_id", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp").alias("added_at"), F.lit(None).cast("timestamp").alias("last_brief_at"))
    out = v.append("monitored_channels", rows, ignore=True).append("monitored_channels", rows.withColumn("added_at", F.lit(LATER).cast("timestamp")), ignore=True)
    out = out.delete("monitored_channels", v.channels.filter(_long("channel_id") % 5 == 0).select("channel_id"))
    asia = v.channels.filter("category = 'ASIA'").select("channel_id", F.lit(LATER).cast("timestamp").alias("last_brief_at"))
    return out.upsert("monitored_channels", asia.join(out.monitored_channels.select("channel_id"), "channel_id", "left_semi")).monitored_channels


query("write_watch_list", "SELECT channel_id, timestamp '2024-01-01' AS added_at, CASE WHEN category = 'ASIA' THEN timestamp '2024-03-01' END AS last_brief_at FROM channels WHERE channel_id::bigint % 5 <> 0")(watch_list)


def discoveries(v) -> DataFrame:
    """Saved discoveries and pinned searches: saved, pinned once each, some deleted and unpinned."""
    saved = v.tables["chat_messages"].select(F.col("message_id").alias("discovery_id"), F.col("role").alias("query"), F.col("session_id").alias("video_id"))
    out = v.having(saved_discoveries=saved).delete("saved_discoveries", saved.filter("discovery_id % 4 = 0").select("discovery_id"))
    pins = saved.select(F.col("discovery_id").alias("query_id"), F.concat("query", F.lit(" "), F.col("video_id")).alias("query"))
    first = pins.groupBy("query").agg(F.min("query_id").alias("query_id"))
    out = out.append("pinned_searches", first, ignore=True).append("pinned_searches", first.withColumn("query_id", F.lit(-1).cast("long")), ignore=True)
    out = out.delete("pinned_searches", first.filter("query_id % 3 = 0").select("query"))
    return out.saved_discoveries.select(F.col("discovery_id").alias("id"), "query").unionByName(out.pinned_searches.select(F.col("query_id").alias("id"), "query"))


query("write_discoveries", """SELECT message_id AS id, role AS query FROM chat_messages WHERE message_id % 4 <> 0
    UNION ALL SELECT id, query FROM (SELECT min(message_id) AS id, concat(role, ' ', session_id) AS query FROM chat_messages GROUP BY 2) WHERE id % 3 <> 0""")(discoveries)


def chats(v) -> DataFrame:
    """Sessions are created, get their messages, half are renamed and some deleted with their messages."""
    messages = v.tables["chat_messages"].select("message_id", "session_id", "role", "content")
    sessions = messages.select("session_id").distinct().select("session_id", F.concat(F.lit("chat "), "session_id").alias("name"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp").alias("last_active"))
    out = v.having(chat_sessions=sessions, chat_messages=messages.limit(0))
    out = L.add_message(out, messages, LATER)
    out = out.upsert("chat_sessions", sessions.filter(_long("session_id") % 2 == 0).select("session_id", F.lit("renamed").alias("name")))
    for gone in ("0", "3", "no such"):
        out = L.delete_session(out, gone)
    counted = out.chat_messages.groupBy("session_id").agg(F.count("*").alias("messages"))
    return out.chat_sessions.join(counted, "session_id", "left").select("session_id", "name", "last_active", "messages")


query("write_chats", "SELECT session_id, CASE WHEN session_id::bigint % 2 = 0 THEN 'renamed' ELSE concat('chat ', session_id) END AS name, timestamp '2024-03-01' AS last_active, count(*) AS messages FROM chat_messages WHERE session_id NOT IN ('0', '3') GROUP BY session_id")(chats)


def summaries(v) -> DataFrame:
    """Summaries written twice: the last counts; takeaways joined for the comparison."""
    one = v.tables["transcripts"].select("video_id", F.substring("text", 1, 40).alias("summary_text"), F.array(F.lit("x")).alias("takeaways"))
    out = v.having(video_summaries=one).upsert("video_summaries", one.filter(_long("video_id") % 2 == 1).select("video_id", F.lit("again").alias("summary_text"), F.array(F.lit("y"), F.lit("z")).alias("takeaways")))
    return out.video_summaries.withColumn("takeaways", F.array_join("takeaways", ","))


query("write_summaries", "SELECT video_id, CASE WHEN k % 2 = 1 THEN 'again' ELSE s END AS summary_text, CASE WHEN k % 2 = 1 THEN 'y,z' ELSE 'x' END AS takeaways FROM (SELECT video_id, video_id::bigint AS k, substring(text, 1, 40) AS s FROM transcripts)")(summaries)


def graph_writes(v) -> DataFrame:
    """Edges linked twice (weights add up), guests' and videos' nodes deleted with their edges. The edges are written once; their number says how many tasks sort them."""
    n = 4 * tasks(v.spark, 0)
    topics = v.tables["chunk_topics"].select("video_id", "name").repartition(n, "video_id").groupBy("video_id", "name").agg(F.count("*").cast("double").alias("weight"))
    edges = topics.select(F.col("video_id").alias("src"), F.lit("Video").alias("src_label"), F.col("name").alias("dst"), F.lit("Topic").alias("dst_label"), F.lit("DISCUSSES").alias("type"), "weight", F.lit("").alias("relationship"))
    edges = stored(edges, "edges")
    n = tasks(v.spark, edges.count())
    out = L.save(v.having(edges=edges), "edges", edges.withColumn("relationship", F.lit("SEEN")), n)
    gone = v.videos.filter("is_deleted").select(F.col("video_id").alias("src"))
    # few names are videos as well: only those meet the edges by their ends
    ends = edges.select("dst").distinct().join(gone.select(F.col("src").alias("dst")), "dst", "left_semi")
    # what is deleted says in how many tasks the edges meet it
    return out.delete("edges", gone.repartition(n, "src")).delete("edges", ends).edges.select("src", "dst", "type", "weight", "relationship")


query("write_graph", "SELECT video_id AS src, name AS dst, 'DISCUSSES' AS type, 2.0::double * count(*) AS weight, 'SEEN' AS relationship FROM chunk_topics WHERE video_id NOT IN (SELECT video_id FROM videos WHERE is_deleted) GROUP BY ALL")(graph_writes)


def outbox(v) -> DataFrame:
    """Entries made, repeated, partly done, failed, then replayed by a repair that ends the vector side of those with tries left."""
    out = L.outbox_entry(L.outbox_entry(v, v.videos), v.videos.filter(_long("video_id") % 3 == 0))
    out = out.update("sync_outbox", _long("video_id") % 2 == 0, graph_done=F.lit(True))
    out = out.update("sync_outbox", _long("video_id") % 5 == 0, retry_count=F.lit(5), last_error=F.lit("down"))

    def repair(vault, undone):
        return vault.upsert("sync_outbox", undone.select("video_id", F.lit(True).alias("vector_done")))

    return L.drain_outbox(out, repair).sync_outbox.select("video_id", "vector_done", "graph_done", "retry_count", "last_error")


query("write_outbox", """SELECT video_id, k % 5 <> 0 AS vector_done, k % 2 = 0 AS graph_done, CASE WHEN k % 5 = 0 THEN 5 WHEN k % 3 = 0 THEN 2 ELSE 1 END AS retry_count, CASE WHEN k % 5 = 0 THEN 'down' END AS last_error
    FROM (SELECT video_id, video_id::bigint AS k FROM videos) WHERE NOT (k % 5 <> 0 AND k % 2 = 0)""")(outbox)


def scans(v) -> DataFrame:
    """A scan a channel: created, counted up, some completed or failed; those that run are paused, one resumed; control states joined."""
    rows = v.channels.select(F.col("channel_id").alias("scan_id"), F.concat(F.lit("u"), "channel_id").alias("source_url"), F.lit("channel").alias("scan_type"), F.lit(0).cast("long").alias("total_discovered"), F.lit(0).cast("long").alias("total_processed"), F.lit("IN_PROGRESS").alias("status"), F.lit(LATER).cast("timestamp").alias("started_at"))
    out = v.having(scan_checkpoints=rows)
    seen = v.videos.groupBy(F.col("channel_id").alias("scan_id")).agg(F.count("*").alias("total_discovered"), F.count_if(F.col("checkpoint_stage") == "DONE").alias("total_processed"))
    out = out.upsert("scan_checkpoints", seen)
    out = L.update_scan(L.update_scan(out, "1", status="COMPLETED"), "2", status="FAILED", total_processed=None)
    out = L.control(L.control(out, "PAUSED", reason="upstream"), "RUNNING", ["4"])
    return R.active_scans(out).select("scan_id", "source_url", "total_discovered", "total_processed").join(out.pipeline_control.select("scan_id", F.col("status").alias("control"), "pause_reason"), "scan_id", "left")


query("write_scans", """SELECT c.channel_id AS scan_id, concat('u', c.channel_id) AS source_url, count(v.video_id) AS total_discovered, count(v.video_id) FILTER (checkpoint_stage = 'DONE') AS total_processed, CASE WHEN c.channel_id = '4' THEN 'RUNNING' ELSE 'PAUSED' END AS control, CASE WHEN c.channel_id = '4' THEN '' ELSE 'upstream' END AS pause_reason
    FROM channels c LEFT JOIN videos v ON v.channel_id = c.channel_id WHERE c.channel_id NOT IN ('1', '2') GROUP BY c.channel_id""")(scans)


def purged(v) -> DataFrame:
    """What a purge of a channel's videos records: the rows that went, by table, for each video."""
    whole = v.having(videos=v.videos, claims=v.claims, guest_appearances=v.guest_appearances, guests=v.guests, transcript_chunks=v.transcript_chunks)
    out = L.purge(whole, v.videos.filter("channel_id = '3'"), "no longer wanted")
    n = lambda t: F.coalesce(F.try_element_at("data_deleted", F.lit(t)), F.lit(0)).alias(t)
    return out.deletion_history.select("video_id", "deletion_type", "reason", n("claims"), n("guest_appearances"), n("transcript_chunks"))


query("write_purge", """SELECT video_id, 'PURGE' AS deletion_type, 'no longer wanted' AS reason, coalesce(c.n, 0) AS claims, coalesce(g.n, 0) AS guest_appearances, coalesce(t.n, 0) AS transcript_chunks FROM (SELECT video_id FROM videos WHERE channel_id = '3')
    LEFT JOIN (SELECT video_id, count(*) AS n FROM claims GROUP BY 1) c USING (video_id) LEFT JOIN (SELECT video_id, count(*) AS n FROM guest_appearances GROUP BY 1) g USING (video_id) LEFT JOIN (SELECT video_id, count(*) AS n FROM transcript_chunks GROUP BY 1) t USING (video_id)""")(purged)


def temp_states(v) -> DataFrame:
    """Working texts filled in by two writes (an empty one changes nothing), then those of finished videos cleaned away."""
    one = v.videos.select("video_id", F.col("title").alias("raw_text"), F.lit(None).cast("string").alias("cleaned_text"))
    two = v.videos.select("video_id", F.when(_long("video_id") % 2 == 0, "").otherwise("second").alias("raw_text"), F.lit("clean").alias("cleaned_text"))
    out = L.save(v.having(videos=v.videos, pipeline_temp_state=one), "pipeline_temp_state", two)
    return L.clean_temp_states(out).pipeline_temp_state


query("write_temp_states", "SELECT video_id, CASE WHEN video_id::bigint % 2 = 0 THEN title ELSE 'second' END AS raw_text, 'clean' AS cleaned_text FROM videos WHERE checkpoint_stage NOT IN ('GRAPH_SYNCED', 'DONE')")(temp_states)


def log_writes(v) -> DataFrame:
    """Events logged, old ones cleared; snapshots of counts and stage times appended alike."""
    day = dt.datetime(2024, 1, 10)
    out = _having(v, "pipeline_logs").append("pipeline_logs", v.tables["pipeline_metrics"].select(F.col("metric_id").alias("log_id"), "scan_id", "video_id", "stage", F.lit("INFO").alias("level"), F.concat(F.lit("took "), F.floor("duration_seconds").cast("string")).alias("message"), F.lit(LATER).cast("timestamp_ntz").alias("timestamp")))
    return L.clear_logs(out, day).pipeline_logs.groupBy("stage", "level").agg(F.count("*").alias("n"), F.min("log_id").alias("first"), F.max("message").alias("last_message"))


query("write_logs", """SELECT stage, level, count(*) AS n, min(log_id) AS first, max(message) AS last_message FROM (SELECT log_id, stage, level, message FROM pipeline_logs WHERE timestamp >= timestamp '2024-01-10'
    UNION ALL SELECT metric_id, stage, 'INFO', concat('took ', floor(duration_seconds)::bigint) FROM pipeline_metrics) GROUP BY ALL""")(log_writes)


def lookups(v) -> DataFrame:
    """Point lookups by key, each with what it finds: (lookup, id)."""
    tables = {n: v.tables[n] for n in ("videos", "channels", "transcript_chunks", "claims")}
    guests = v.guests.withColumn("aliases", F.array(F.concat(F.lit("also "), "canonical_name")))
    vault = v.having(**tables, guests=guests, quotes=v.claims.select(F.col("claim_id").alias("quote_id"), "video_id", "speaker", F.col("claim_text").alias("quote_text"), "timestamp"))
    one = lambda name, df, c: df.select(F.lit(name).alias("lookup"), F.col(c).cast("string").alias("id"))
    found = [
        one("video", R.get_video(vault, "7"), "title"), one("deleted video", R.get_video(vault, "100"), "title"), one("channel", R.by_key(vault, "channels", "channel_id", "3"), "name"),
        one("chunk", R.by_key(vault, "transcript_chunks", "chunk_id", "7__chunk_0001"), "cleaned_text"), one("chunks", R.of_video(vault, "transcript_chunks", "7", "chunk_index"), "chunk_id"),
        one("claims", R.of_video(vault, "claims", "7"), "claim_id"), one("quotes", R.of_video(vault, "quotes", "7"), "quote_id"), one("speaker", R.quotes_by_speaker(vault, "Supplier#000000001", None), "quote_id"),
        one("guest", R.find_guest(vault, "also Supplier#000000002"), "guest_id"), one("history", R.of_video(v, "video_stats_history", "7", "snapshot_at"), "history_id"), one("logs", R.of_video(v, "pipeline_logs", "7"), "log_id"),
        one("channels", R.all_channels(vault), "name"), one("guests", R.newest(vault, "guests", 5, "mention_count"), "mention_count"), one("searched", R.search_claims(vault, "BRUSHED", None), "claim_id"),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


query("lookups", """SELECT 'video' AS lookup, title AS id FROM videos WHERE video_id = '7' AND NOT is_deleted UNION ALL SELECT 'deleted video', title FROM videos WHERE video_id = '100' AND NOT is_deleted UNION ALL SELECT 'channel', name FROM channels WHERE channel_id = '3'
    UNION ALL SELECT 'chunk', cleaned_text FROM transcript_chunks WHERE chunk_id = '7__chunk_0001' UNION ALL SELECT 'chunks', chunk_id FROM transcript_chunks WHERE video_id = '7' UNION ALL SELECT 'claims', claim_id::string FROM claims WHERE video_id = '7'
    UNION ALL SELECT 'quotes', claim_id::string FROM claims WHERE video_id = '7' UNION ALL SELECT 'speaker', claim_id::string FROM claims WHERE contains(lower(speaker), 'supplier#000000001') UNION ALL SELECT 'guest', guest_id::string FROM guests WHERE canonical_name = 'Supplier#000000002'
    UNION ALL SELECT 'history', history_id::string FROM video_stats_history WHERE video_id = '7' UNION ALL SELECT 'logs', log_id::string FROM pipeline_logs WHERE video_id = '7' UNION ALL SELECT 'channels', name FROM channels
    UNION ALL SELECT 'guests', mention_count::string FROM (SELECT mention_count FROM guests ORDER BY mention_count DESC LIMIT 5) UNION ALL SELECT 'searched', claim_id::string FROM claims WHERE contains(lower(claim_text), 'brushed')""")(lookups)


def taxonomy_contexts(v) -> DataFrame:
    """The children of one topic, from edges made of the topics' names."""
    names = v.tables["chunk_topics"].select("name").distinct()
    edges = names.filter("length(name) > 3").select(F.col("name").alias("src"), F.lit("Topic").alias("src_label"), F.lit("green").alias("dst"), F.lit("Topic").alias("dst_label"), F.lit("SUBTOPIC_OF").alias("type")).filter("src <> dst")
    return G.taxonomy_context(edges, "green").select(F.explode("children").alias("child"))


query("taxonomy_children", "SELECT DISTINCT name AS child FROM chunk_topics WHERE length(name) > 3 AND name <> 'green'")(taxonomy_contexts)
query("export_citations", "SELECT concat('source_', claim_id) AS source_id, video_id, title, speaker AS channel_name, cast(timestamp AS string) AS at, '' AS link, claim_text AS excerpt FROM claims JOIN videos USING (video_id)")(
    lambda v: export.citations_csv(v.claims.join(v.videos.select("video_id", "title"), "video_id").select(F.concat(F.lit("source_"), F.col("claim_id").cast("string")).alias("source_id"), "video_id", "title", F.col("speaker").alias("channel_name"), F.col("timestamp").cast("string").alias("at"), F.lit("").alias("link"), F.col("claim_text").alias("excerpt")))
)
query("export_claim_texts", r"""SELECT concat('claims/claim ', cast(claim_id AS string), '.md') AS path, concat('> ', claim_text, chr(10), 'Speaker: ', speaker, chr(10), '[[', trim(regexp_replace(coalesce(title, 'Unknown'), '[^\p{L}\p{N} _-]', '_', 'g')), ']]') AS text FROM claims LEFT JOIN videos USING (video_id)""")(lambda v: export.notes(v, "claims").select("path", "text"))


def merged_upserts(v) -> DataFrame:
    """Every policy of a keyed write at once, over all videos and half of them again."""
    old = v.videos.select("video_id", F.col("view_count").alias("added"), F.col("like_count").alias("most"), F.col("like_count").alias("least"), F.col("title").alias("kept"), F.col("title").alias("filled"), F.array("title").alias("united"))
    new = v.videos.filter(_long("video_id") % 2 == 0).select("video_id", F.lit(1).cast("long").alias("added"), F.lit(20).cast("long").alias("most"), F.lit(20).cast("long").alias("least"), F.lit("other").alias("kept"), F.when(_long("video_id") % 4 == 0, "").otherwise("fill").alias("filled"), F.array(F.lit("more")).alias("united"))
    return upsert(old, new, ["video_id"], {"added": "add", "most": "max", "least": "min", "kept": "keep", "filled": "fill", "united": "union"}).withColumn("united", F.array_join("united", ";"))


query("write_policies", """SELECT video_id, view_count + CASE WHEN e THEN 1 ELSE 0 END AS added, CASE WHEN e THEN greatest(like_count, 20) ELSE like_count END AS most, CASE WHEN e THEN least(like_count, 20) ELSE like_count END AS least, title AS kept, CASE WHEN e AND k % 4 <> 0 THEN 'fill' ELSE title END AS filled, CASE WHEN e THEN concat(title, ';more') ELSE title END AS united
    FROM (SELECT *, video_id::bigint AS k, video_id::bigint % 2 = 0 AS e FROM videos)""")(merged_upserts)
query("export_stats", """SELECT concat('# Pipeline Statistics', chr(10), chr(10), '**Generated:** today', chr(10), chr(10), '| Metric | Count |', chr(10), '|---|---|', chr(10), '| Total Channels | ', (SELECT count(*) FROM channels), ' |', chr(10), '| Total Videos | ', count(*), ' |', chr(10),
    '| Triage: Accepted | ', count(*) FILTER (triage_status = 'ACCEPTED'), ' |', chr(10), '| Triage: Rejected | ', count(*) FILTER (triage_status = 'REJECTED'), ' |', chr(10), '| Triage: Pending | ', count(*) FILTER (triage_status = 'PENDING_REVIEW'), ' |', chr(10),
    '| Transcripts Fetched | ', count(*) FILTER (checkpoint_stage <> 'METADATA_HARVESTED'), ' |', chr(10), '| Chunks Indexed | ', (SELECT count(*) FROM transcript_chunks), ' |', chr(10), '| Guests Identified | ', (SELECT count(*) FROM guests), ' |', chr(10)) AS text FROM videos""")(
    lambda v: export.stats_markdown(v.having(**{n: v.tables[n] for n in ("videos", "channels", "transcript_chunks", "guests")}), "today")
)
