"""What a person reviews: rejected videos, sources, blueprints, scans, stores that differ, citations by title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.relational import all_blueprints, contains_any_case, rows
from lodestone.vault import Vault

#: Name of an order -> column, greatest first.
ORDERS = {"Highest Confidence": "triage_confidence", "Longest Duration": "duration_seconds", "Most Views": "view_count"}


def rejected(vault: Vault, reason: str | None = None, text: str | None = None, order: str | None = None) -> DataFrame:
    """Rejected videos whose reason contains one text and whose title or description contains another in any case; null matches nothing."""
    wanted = F.col("triage_status") == "REJECTED"
    if reason:
        wanted = wanted & F.contains(F.col("triage_reason"), F.lit(reason))
    if text:
        fields = [c for c in ("title", "description") if c in vault.videos.columns]
        hit = F.lit(False)
        for c in fields:
            hit = hit | F.coalesce(contains_any_case(c, text), F.lit(False))
        wanted = wanted & hit
    return rows(vault.videos, wanted, [F.col(ORDERS[order]).desc_nulls_last(), F.col("video_id")] if order else None)


def sources(vault: Vault, pattern: str | None = None, statuses: list[str] = ("ACCEPTED", "DONE")) -> DataFrame:
    """Videos whose title or id matches a pattern in any case, of some states (all if none is given)."""
    wanted = F.lit(True)
    if pattern:
        wanted = F.col("title").rlike(f"(?i){pattern}") | F.col("video_id").rlike(f"(?i){pattern}")
    if statuses:
        wanted = wanted & F.col("triage_status").isin(list(statuses))
    return rows(vault.videos, wanted)


def store_divergence(vault: Vault, vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: videos that aren't deleted, videos with vectors (video_id), video vertices of a graph (video_id)."""
    tables = vault.videos.agg(F.count_if(~F.coalesce("is_deleted", F.lit(False))).alias("in_tables"))
    # three tables of one row
    return tables.join(vectors.agg(F.count_distinct("video_id").alias("in_vectors"))).join(nodes.agg(F.count_distinct("video_id").alias("in_graph")))


def scan_videos(vault: Vault, scan_id: str, limit: int | None = 10) -> DataFrame:
    """The last videos of a scan's checkpoints."""
    last = vault.scan_checkpoints.filter(F.col("scan_id") == scan_id).select(F.col("last_video_id").alias("video_id"))
    found = vault.videos.select("video_id", "title", "triage_status", "checkpoint_stage").join(last, "video_id", "left_semi")
    return rows(found, order=[F.col("video_id")], limit=limit)


def search_blueprints(vault: Vault, text: str) -> DataFrame:
    return all_blueprints(vault).filter(contains_any_case("title", text) | contains_any_case("channel_name", text))


def citations_by_title(citations: DataFrame) -> DataFrame:
    """(first, title, n, sources) of citations (rank, title, source_id); `first` orders the titles."""
    grouped = citations.groupBy("title").agg(F.min("rank").alias("first"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "source_id"))).alias("c"))
    return grouped.select("first", "title", "n", F.col("c")["source_id"].alias("sources"))
