"""Schemas of the vault's tables, their keys and state enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

_TOPIC = "struct<name:string,parent_topic:string,relevance:double>"
_ENTITY = "struct<name:string,type:string,context:string>"

#: Table -> (key columns, columns).
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "channels": (("channel_id",), "channel_id string, name string, url string, description string, category string, language_iso string, total_videos long, processed_videos long, discovered_at timestamp, last_scanned_at timestamp, follower_count long, handle string, thumbnail_url string, is_verified boolean"),
    "videos": (("video_id",), "video_id string, channel_id string, title string, url string, description string, duration_seconds int, upload_date date, view_count long, like_count long, comment_count long, tags array<string>, language_iso string, triage_status string, triage_reason string, triage_confidence double, transcript_strategy string, needs_translation boolean, checkpoint_stage string, heatmap array<struct<start:double,end:double,score:double>>, thumbnail_url string, locked_by_scan_id string, is_tutorial boolean, is_deleted boolean, created_at timestamp, updated_at timestamp"),
    "guests": (("guest_id",), "guest_id long, canonical_name string, aliases array<string>, entity_type string, mention_count long, first_seen timestamp, last_seen timestamp"),
    "guest_appearances": (("guest_id", "video_id", "start_timestamp"), "guest_id long, video_id string, context_snippet string, start_timestamp double, end_timestamp double"),
    "transcript_chunks": (("chunk_id",), f"chunk_id string, video_id string, chunk_index int, raw_text string, cleaned_text string, word_count int, start_timestamp double, end_timestamp double, topics array<{_TOPIC}>, entities array<{_ENTITY}>, claims array<string>, quotes array<string>, content_hash string, is_high_attention boolean"),
    "scan_checkpoints": (("scan_id",), "scan_id string, source_url string, scan_type string, total_discovered long, total_processed long, last_video_id string, status string, started_at timestamp, updated_at timestamp"),
    "video_summaries": (("video_id",), f"video_id string, summary_text string, topics array<{_TOPIC}>, takeaways array<string>, entities array<string>, references array<string>, timeline array<string>, created_at timestamp"),
    "pipeline_temp_state": (("video_id",), "video_id string, raw_text string, cleaned_text string, translated_text string, segments array<struct<text:string,start:double,duration:double>>"),
    "claims": (("claim_id",), "claim_id long, video_id string, chunk_id string, speaker string, claim_text string, topic string, timestamp double, confidence double, cluster_id string, corroboration_count int"),
    "quotes": (("quote_id",), "quote_id long, video_id string, chunk_id string, speaker string, quote_text string, topic string, timestamp double"),
    "pipeline_logs": (("log_id",), "log_id long, scan_id string, video_id string, channel_id string, level string, stage string, message string, error_detail string, timestamp timestamp"),
    "pipeline_control": (("scan_id",), "scan_id string, status string, pause_reason string, updated_at timestamp"),
    "deletion_history": (("deletion_id",), "deletion_id long, deletion_type string, video_id string, channel_id string, reason string, data_deleted map<string,long>, deleted_at timestamp"),
    "video_stats_history": (("history_id",), "history_id long, video_id string, snapshot_at timestamp, view_count long, like_count long, comment_count long"),
    "actionable_blueprints": (("video_id",), "video_id string, steps array<string>, progress map<string,boolean>, created_at timestamp"),
    "expert_clashes": (("clash_id",), "clash_id long, topic string, expert_a string, expert_b string, claim_a string, claim_b string, source_a string, source_b string, created_at timestamp"),
    "video_sentiment": (("id",), "id long, video_id string, chunk_id string, score double, label string"),
    "external_citations": (("citation_id",), "citation_id long, video_id string, name string, url string, type string"),
    "thematic_bridges": (("bridge_id",), "bridge_id long, topic_a string, topic_b string, insight string, created_at timestamp"),
    "research_reports": (("report_id",), "report_id long, query string, title string, file_path string, sources array<string>, created_at timestamp"),
    "sync_outbox": (("video_id",), "video_id string, vector_done boolean, graph_done boolean, retry_count int, last_error string, created_at timestamp, updated_at timestamp"),
    "user_queue": (("queue_id",), "queue_id long, item_type string, item_value string, created_at timestamp"),
    "monitored_channels": (("channel_id",), "channel_id string, added_at timestamp, last_brief_at timestamp"),
    "weekly_briefs": (("brief_id",), "brief_id long, content string, created_at timestamp"),
    "chat_sessions": (("session_id",), "session_id string, name string, created_at timestamp, last_active timestamp"),
    "chat_messages": (("message_id",), "message_id long, session_id string, role string, content string, suggested array<string>, citations array<struct<source_id:string,video_id:string,title:string>>, created_at timestamp"),
    "saved_discoveries": (("discovery_id",), "discovery_id long, query string, video_id string, snippet string, type string, created_at timestamp"),
    "pinned_searches": (("query",), "query_id long, query string, created_at timestamp"),
    "insight_briefings": (("briefing_id",), "briefing_id long, topic string, channels array<string>, relationship_type string, summary string, sources array<string>, created_at timestamp"),
    "pipeline_metrics": (("metric_id",), "metric_id long, scan_id string, video_id string, stage string, started_at timestamp, ended_at timestamp, duration_seconds double, status string"),
    "sponsor_segments": (("video_id", "start"), "video_id string, start double, end double, category string"),
    "vertices": (("label", "id"), "label string, id string, name string, props map<string,string>"),
    "edges": (("src", "dst", "type"), "src string, src_label string, dst string, dst_label string, type string, weight double, relationship string, context string"),
}

#: Order of the stages of a video.
STAGES = ["METADATA_HARVESTED", "TRIAGE_COMPLETE", "TRANSCRIPT_FETCHED", "TRANSLATED", "SPONSOR_FILTERED", "TEXT_NORMALIZED", "CHUNKED", "CHUNK_ANALYZED", "SUMMARIZED", "EMBEDDED", "GRAPH_SYNCED", "CORROBORATED", "DONE"]
TRIAGE = ["DISCOVERED", "ACCEPTED", "REJECTED", "PENDING_REVIEW", "NEEDS_LLM", "SKIPPED"]
CONTROL = ["RUNNING", "PAUSED", "STOPPING", "STOPPED"]
SCHEMA_VERSION = 31


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name][1])


def key(name: str) -> tuple[str, ...]:
    return TABLES[name][0]
