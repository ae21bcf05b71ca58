"""Exports: Markdown, JSON and CSV rows, notes by entity, packages and snapshots. Rows are made by Spark; a sink writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import file_name
from lodestone.operators.aggregates import pipeline_stats
from lodestone.schemas import STAGES
from lodestone.vault import Vault

#: Fixed header of citation tables.
CITATION_COLUMNS = ["source_id", "video_id", "title", "channel_name", "at", "link", "excerpt"]


def _lines(*parts: Column | str) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])), "\n")


def citations_csv(citations: DataFrame) -> DataFrame:
    return citations.select(*CITATION_COLUMNS)


def answer_markdown(query: str, answer: str, citations: DataFrame, confidence: DataFrame) -> DataFrame:
    """One row (text): an answer of at most a few citations with its confidence."""
    line = F.concat(F.lit("- **["), "source_id", F.lit("]** "), "title", F.lit(" ("), "channel_name", F.lit(", "), "at", F.lit("): "), "link")
    listed = citations.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("sources"))
    return confidence.join(listed).select(_lines(f"# {query}", answer, "## Sources", F.col("sources"), "## Confidence", F.format_string("overall %.2f, diversity %.2f, relevance %.2f, coverage %.2f", "overall", "diversity", "relevance", "coverage")).alias("text"))  # one row and one row


def answer_json(query: str, answer: str, citations: DataFrame, confidence: DataFrame) -> DataFrame:
    listed = citations.agg(F.array_sort(F.collect_list(F.struct(*CITATION_COLUMNS))).alias("citations"))
    return confidence.select(F.struct("*").alias("confidence")).join(listed).select(F.to_json(F.struct(F.lit(query).alias("query"), F.lit(answer).alias("answer"), "citations", "confidence")).alias("json"))  # one row and one row


def guests_table(vault: Vault) -> DataFrame:
    return vault.guests.select("canonical_name", "entity_type", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), "; ").alias("aliases"), "mention_count")


def guests_markdown(vault: Vault) -> DataFrame:
    """(canonical_name, line): one Markdown table row a guest."""
    return guests_table(vault).select("canonical_name", F.format_string("| %s | %s | %s | %d |", "canonical_name", "entity_type", "aliases", "mention_count").alias("line"))


def video_packages(vault: Vault) -> DataFrame:
    """(video_id, json): a video with its summary and its claims in order."""
    claims = vault.claims.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "claim_id", "speaker", "claim_text"))).alias("claims"))
    summary = vault.video_summaries.select("video_id", "summary_text")
    full = vault.videos.select("video_id", "title", "channel_id").join(summary, "video_id", "left").join(claims, "video_id", "left")
    return full.select("video_id", F.to_json(F.struct("video_id", "title", "channel_id", "summary_text", "claims")).alias("json"))


#: The rows of the table of figures and what they count.
FIGURES = [("Total Channels", "total_channels"), ("Total Videos", "total_videos"), ("Triage: Accepted", "accepted"), ("Triage: Rejected", "rejected"), ("Triage: Pending", "pending_review"), ("Transcripts Fetched", "transcript_fetched"), ("Chunks Indexed", "total_chunks"), ("Guests Identified", "total_guests")]


def stats_markdown(vault: Vault, at: str) -> DataFrame:
    """One row (text): figures of the vault as a table; a transcript counts from its stage on."""
    count = lambda table, name: getattr(vault, table).agg(F.count("*").alias(name))
    stages = F.array(*[F.lit(x) for x in STAGES])
    fetched = vault.videos.agg(F.count_if(F.array_position(stages, F.coalesce("checkpoint_stage", F.lit(""))) >= STAGES.index("TRANSCRIPT_FETCHED") + 1).alias("transcript_fetched"))
    stats = pipeline_stats(vault).withColumnRenamed("total", "total_videos")
    for one in (count("channels", "total_channels"), count("transcript_chunks", "total_chunks"), count("guests", "total_guests"), fetched):
        stats = stats.join(one)  # one row each
    rows = [F.concat(F.lit(f"| {name} | "), F.col(c).cast("string"), F.lit(" |\n")) for name, c in FIGURES]
    return stats.select(F.concat(F.lit(f"# Pipeline Statistics\n\n**Generated:** {at}\n\n| Metric | Count |\n|---|---|\n"), *rows).alias("text"))


def session_markdown(vault: Vault) -> DataFrame:
    """(session_id, text): each chat session as Markdown, messages in order."""
    line = F.concat(F.lit("**"), F.initcap("role"), F.lit("**: "), F.coalesce("content", F.lit("")))
    return vault.chat_messages.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_id", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("text"))


def mission_package(vault: Vault, session_ids: list[str]) -> DataFrame:
    """(video_id, title): distinct videos that some sessions cite."""
    cited = vault.chat_messages.filter(F.col("session_id").isin(session_ids)).select(F.explode("citations.video_id").alias("video_id")).distinct()
    return cited.join(vault.videos.select("video_id", "title"), "video_id")


def missions_in(package: DataFrame) -> DataFrame:
    """(missions): number of missions of an exported package (json)."""
    return package.select(F.coalesce(F.size(F.from_json("json", "struct<missions:array<string>>")["missions"]), F.lit(0)).alias("missions"))


def notes(vault: Vault, kind: str) -> DataFrame:
    """(path, text): one note a channel, video or claim; one for all bridges or clashes."""
    link = lambda c: F.concat(F.lit("[["), file_name(F.coalesce(c, F.lit("Unknown"))), F.lit("]]"))
    if kind == "channels":
        return vault.channels.select(F.concat(F.lit("channels/"), file_name(F.col("name")), F.lit(".md")).alias("path"), _lines(F.concat(F.lit("# "), "name"), F.concat(F.lit("Category: "), F.coalesce("category", F.lit("")))).alias("text"))
    if kind == "videos":
        claims = vault.claims.groupBy("video_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("claim_id", "claim_text"))), 1, 5)["claim_text"].alias("claims"))
        full = vault.videos.join(vault.channels.select("channel_id", F.col("name").alias("channel")), "channel_id", "left").join(vault.video_summaries.select("video_id", "summary_text"), "video_id", "left").join(claims, "video_id", "left")
        return full.select(F.concat(F.lit("videos/"), file_name(F.concat_ws(" ", "title", "video_id")), F.lit(".md")).alias("path"), _lines(F.concat(F.lit("# "), "title"), link(F.col("channel")), F.col("summary_text"), F.array_join(F.transform("claims", lambda c: F.concat(F.lit("- "), c)), "\n")).alias("text"))
    if kind == "claims":
        full = vault.claims.join(vault.videos.select("video_id", "title"), "video_id", "left")
        return full.select(F.concat(F.lit("claims/claim "), F.col("claim_id").cast("string"), F.lit(".md")).alias("path"), _lines(F.concat(F.lit("> "), "claim_text"), F.concat(F.lit("Speaker: "), F.coalesce("speaker", F.lit(""))), link(F.col("title"))).alias("text"))
    if kind == "bridges":
        line = F.concat(F.lit("- "), link(F.col("topic_a")), F.lit(" and "), link(F.col("topic_b")), F.lit(": "), F.coalesce("insight", F.lit("")))
        return vault.thematic_bridges.agg(F.lit("bridges.md").alias("path"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    if kind == "clashes":
        line = F.concat(F.lit("- "), F.col("topic"), F.lit(": "), F.col("expert_a"), F.lit(" and "), F.col("expert_b"))
        return vault.expert_clashes.agg(F.lit("clashes.md").alias("path"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    raise ValueError(f"no notes of {kind}")


def snapshot(vault: Vault, path: str) -> None:
    """All tables as Parquet and a manifest of their rows."""
    manifest = None
    for name, df in vault.tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        one = df.sparkSession.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        manifest = one if manifest is None else manifest.unionByName(one)
    if manifest is not None:
        manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
