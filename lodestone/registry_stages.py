"""Queries over the stages of a video, progress and what a person reviews; registered on import.

Models are stand-ins made of built-in functions, so that SQL can say the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import aggregates as A
from lodestone.operators import graph as G
from lodestone.operators import review as V
from lodestone.operators import stages as P
from lodestone.registry import _HEAT, heat, query
from lodestone.registry_text import _W, table
from lodestone.sources import metadata
from lodestone.streaming.stages import step


def _judge(prompt):
    reply = lambda category, sure: F.lit(f'Here: {{"category": "{category}", "confidence": {sure}, "reasoning": "r"}}')
    has = lambda word: F.contains(prompt, F.lit(word))
    return F.when(has("2-HIGH"), reply("knowledge", 0.9)).when(has("3-MEDIUM"), reply("NOISE", 0.8)).when(has("4-NOT"), reply("KNOWLEDGE", 0.5)).otherwise("no reply")


def _triaged(videos):
    return P.triage(videos.withColumn("description", F.col("title")), _judge, ["1-URGENT"], ["3"]).drop("description")


def _states(v):
    t = v.tables["transcripts"]
    none = F.lit(None).cast("string")
    return t.select("video_id", "language_iso", F.col("text").alias("raw_text"), none.alias("cleaned_text"), F.when(F.length("video_id") % 2 == 0, "").otherwise(none).alias("translated_text"))


def _translated(v):
    return P.translate(_states(v), lambda c: F.when(F.length("video_id") != 3, F.concat(F.lit("[en] "), c))).drop("ok")


_TRIAGE = """CASE WHEN duration_seconds < 60 THEN 'REJECTED' WHEN channel_id = '3' OR contains(title, '1-URGENT') THEN 'ACCEPTED' WHEN contains(title, '2-HIGH') THEN 'ACCEPTED' WHEN contains(title, '3-MEDIUM') THEN 'REJECTED' ELSE 'PENDING_REVIEW' END"""
_TR = """CASE WHEN coalesce(language_iso, '') <> 'en' AND coalesce(text, '') <> '' AND length(video_id) <> 3 THEN concat('[en] ', text) WHEN length(video_id) % 2 = 0 THEN '' END"""

query("stage_triage", f"""SELECT video_id, {_TRIAGE} AS triage_status, CASE WHEN duration_seconds < 60 OR channel_id = '3' THEN 1.0 WHEN contains(title, '1-URGENT') THEN 0.85 WHEN contains(title, '2-HIGH') THEN 0.9 WHEN contains(title, '3-MEDIUM') THEN 0.8
    WHEN contains(title, '4-NOT') THEN 0.5 ELSE 0.0 END::double AS triage_confidence FROM videos""")(lambda v: _triaged(v.videos).select("video_id", "triage_status", "triage_confidence"))
query("stage_transcript", """SELECT video_id, coalesce(c.language, language_iso) AS language_iso, CASE WHEN c.language IS NULL THEN 'DONE' ELSE checkpoint_stage END AS checkpoint_stage, c.language IS NOT NULL AS ok
    FROM videos LEFT JOIN (SELECT cast(doc_id AS string) AS video_id, lang AS language FROM documents WHERE doc_id % 3 <> 0) c USING (video_id)""")(
    lambda v: P.transcript(v.videos, metadata.choose_transcript(table(v, "documents").filter("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("video_id"), F.col("lang").alias("language"), F.lit(True).alias("manual"), "text"))).select("video_id", "language_iso", "checkpoint_stage", "ok")
)
query("stage_translate", f"""SELECT video_id, {_TR} AS translated_text, NOT (coalesce(language_iso, '') <> 'en' AND coalesce(text, '') <> '' AND length(video_id) = 3) AS ok FROM transcripts""")(
    lambda v: P.translate(_states(v), lambda c: F.when(F.length("video_id") != 3, F.concat(F.lit("[en] "), c))).select("video_id", "translated_text", "ok")
)
query("stage_sponsor_filter", f"""SELECT v.video_id, coalesce(s.text, '') AS raw_text FROM (SELECT DISTINCT video_id FROM {_HEAT}) v LEFT JOIN (SELECT video_id, string_agg(concat('s', cast(pos AS string)), ' ' ORDER BY pos) AS text FROM {_HEAT} s WHERE NOT EXISTS (
    SELECT 1 FROM {_HEAT} k WHERE k.video_id = s.video_id AND k.score >= 0.8 AND s.pos * 10 - 5 BETWEEN k.pos * 10 - 20 AND k.pos * 10) GROUP BY 1) s USING (video_id)""")(
    lambda v: P.sponsor_filter(
        heat(v).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("s"), F.col("pos").cast("string")).alias("text"), "start", F.lit(10.0).alias("duration")))).alias("segments")).withColumn("raw_text", F.lit("before")),
        heat(v).filter("score >= 0.8").select("video_id", (F.col("start") - 10).alias("start"), "end"),
    ).select("video_id", "raw_text")
)
query("stage_normalize", f"""SELECT video_id, CASE WHEN s <> '' THEN concat('A: ', coalesce(nullif(regexp_replace(s, '[a-m]+', '', 'g'), ''), s)) END AS cleaned_text FROM (SELECT video_id, coalesce(nullif({_TR}, ''), text) AS s FROM transcripts)""")(
    lambda v: P.normalize(_translated(v), lambda c: F.regexp_replace(c, "[a-m]+", ""), lambda c: F.concat(F.lit("A: "), c)).select("video_id", "cleaned_text")
)
query("stage_chunk", f"""SELECT video_id, chunk_index, CASE WHEN chunk_index >= 0 THEN array_to_string(w[chunk_index * 40 + 1 : chunk_index * 40 + 50], ' ') END AS text, ok FROM (SELECT *, unnest(CASE WHEN ok AND len(w) >= 20 THEN list_filter(range(0, (len(w) - 1) // 40 + 1), lambda x: x = 0 OR len(w) - x * 40 >= 20)
    ELSE [-1] END) AS chunk_index FROM (SELECT video_id, w, coalesce(text, '') = '' OR len(w) >= 20 AS ok FROM (SELECT video_id, text, {_W} AS w FROM transcripts)))""")(lambda v: _chunk_rows(v))


def _chunk_rows(v):
    made = P.chunks(_states(v), size=50, overlap=10, least=20)
    passed = P.chunked(_states(v), made).select("video_id", "ok")
    return passed.join(made, "video_id", "left").select("video_id", F.coalesce(F.col("chunk_index").cast("long"), F.lit(-1).cast("long")).alias("chunk_index"), "text", "ok")


_MODELS = {
    "topics": lambda c: F.concat(F.lit('["'), F.regexp_extract(c, "[a-z]+", 0), F.lit('"]')),
    "entities": lambda c: F.concat(F.lit('```json\n["e", "'), F.substring(F.regexp_replace(c, "[^a-z]", ""), 1, 5), F.lit('"]\n```')),
    "claims": lambda c: F.concat(F.lit("Sorry, none in "), c),
    "references": lambda c: F.concat(F.lit('["'), F.length(c).cast("string"), F.lit('"]')),
}


def _analysed(v):
    return P.analyse(v.tables["transcripts"].select(F.col("video_id").alias("chunk_id"), F.col("channel_id").alias("video_id"), "text"), _MODELS)


query("chunk_analysis", f"""SELECT video_id AS chunk_id, CASE WHEN long THEN regexp_extract(substring(text, 1, 3000), '[a-z]+', 0) ELSE '' END AS topics, CASE WHEN long THEN concat('e,', substring(regexp_replace(substring(text, 1, 3000), '[^a-z]', '', 'g'), 1, 5)) ELSE '' END AS entities,
    '' AS claims, '' AS quotes, CASE WHEN long THEN cast(least(length(text), 3000) AS string) ELSE '' END AS "references" FROM (SELECT *, len({_W}) >= 20 AS long FROM transcripts)""")(lambda v: _analysed(v).select("chunk_id", *[F.array_join(k, ",").alias(k) for k in P.KINDS]))
query("chunk_analysis_counts", f"""SELECT channel_id AS video_id, count(*) FILTER (long) AS topics, 2 * count(*) FILTER (long) AS entities, cast(0 AS bigint) AS claims, cast(0 AS bigint) AS quotes, count(*) FILTER (long) AS "references" FROM (SELECT *, coalesce(len({_W}), 0) >= 20 AS long FROM transcripts) GROUP BY 1""")(lambda v: P.analysis_counts(_analysed(v)))
query("chunk_findings", f"""SELECT video_id AS chunk_id, place, CASE place WHEN 0 THEN 'e' ELSE substring(regexp_replace(substring(text, 1, 3000), '[^a-z]', '', 'g'), 1, 5) END AS found FROM (SELECT *, unnest([0, 1]) AS place FROM transcripts WHERE len({_W}) >= 20)""")(lambda v: P.findings(_analysed(v), "entities").select("chunk_id", "place", "found"))
_MANY = "(SELECT chunk_id, concat('v', substring(video_id, 1, 3)) AS video_id, chunk_index, cleaned_text AS text FROM transcript_chunks)"
_GROUPS = f"""(SELECT video_id, part, substring(string_agg(text, ' ' ORDER BY chunk_index, chunk_id), 1, 12000) AS text FROM (SELECT *, cast((row_number() OVER (PARTITION BY video_id ORDER BY chunk_index, chunk_id) - 1) // 4 AS int) AS part FROM {_MANY}) GROUP BY 1, 2)"""


def _many(v):
    return v.transcript_chunks.select("chunk_id", F.concat(F.lit("v"), F.substring("video_id", 1, 3)).alias("video_id"), "chunk_index", F.col("cleaned_text").alias("text"))


query("summary_groups", f"SELECT video_id, part, text FROM {_GROUPS}")(lambda v: P.summary_groups(_many(v)))
query("stage_summarize", f"""SELECT video_id, concat('S: ', substring(string_agg(trim(substring(text, 1, 30)), chr(10) || chr(10) ORDER BY concat('group_', cast(part AS string))), 1, 25000)) AS summary_text FROM {_GROUPS} WHERE NOT contains(substring(text, 1, 30), 'z') GROUP BY 1""")(
    lambda v: P.summarise(_many(v), lambda c: F.when(F.contains(F.substring(c, 1, 30), F.lit("z")), "").otherwise(F.substring(c, 1, 30)), lambda c: F.concat(F.lit("S: "), c))
)
query("stage_corroborate", """SELECT claim_id, coalesce(n, 0) AS corroboration_count FROM claims LEFT JOIN (SELECT c.cluster_id, count(DISTINCT v.channel_id) AS n FROM claims c JOIN videos v USING (video_id) GROUP BY 1) USING (cluster_id)""")(
    lambda v: P.corroborate(v.tables["claims"], A.corroboration_counts(v)).select("claim_id", "corroboration_count")
)
query("stage_machine", f"""SELECT video_id, CASE WHEN triage_status <> 'ACCEPTED' THEN checkpoint_stage WHEN checkpoint_stage = 'METADATA_HARVESTED' THEN 'TRIAGE_COMPLETE' WHEN checkpoint_stage = 'CHUNKED' AND video_id IN (SELECT video_id FROM transcript_chunks WHERE chunk_index >= 3) THEN 'CHUNK_ANALYZED'
    WHEN checkpoint_stage = 'GRAPH_SYNCED' THEN 'CORROBORATED' ELSE checkpoint_stage END AS checkpoint_stage, CASE WHEN triage_status = 'ACCEPTED' AND checkpoint_stage = 'METADATA_HARVESTED' THEN {_TRIAGE} ELSE triage_status END AS triage_status FROM videos""")(
    lambda v: step(v.videos, {
        "TRIAGE_COMPLETE": _triaged,
        "CHUNK_ANALYZED": lambda rows: rows.join(v.transcript_chunks.filter("chunk_index >= 3").select("video_id").distinct().withColumn("ok", F.lit(True)), "video_id", "left"),
        "CORROBORATED": lambda rows: rows.withColumn("ok", F.lit(True)),
    }).select("video_id", "checkpoint_stage", "triage_status")
)

query("completion", """SELECT event_id, round(least(99.9::double, user_id * 100.0::double / 2000 + (event_id % 13) / 13.0::double * (100.0::double / 2000)), 6) AS percent, CASE event_id % 13 WHEN 0 THEN 'DISCOVERY' WHEN 1 THEN 'TRIAGE_COMPLETE' WHEN 2 THEN 'TRANSCRIPT_FETCHED' WHEN 3 THEN 'SPONSOR_FILTERED' WHEN 4 THEN 'TEXT_NORMALIZED'
    WHEN 5 THEN 'CHUNKED' WHEN 6 THEN 'CHUNK_ANALYZED' WHEN 7 THEN 'EMBEDDED' WHEN 8 THEN 'GRAPH_SYNCED' WHEN 9 THEN 'DONE' ELSE concat('STAGE_', cast(event_id % 13 AS string)) END AS stage FROM events""")(
    lambda v: table(v, "events").select("event_id", F.round(P.completion(F.col("user_id"), F.col("event_id") % 13, 2000, 13), 6).alias("percent"), P.reported_stage(F.col("event_id") % 13).alias("stage"))
)
query("progress_summary", """SELECT concat('Discovered: 100000 | Completed: ', n, ' | Throughput: ', printf('%.1f', n * 3600.0::double / span), ' videos/hour | ETA: ~', cast(floor((100000 - n) * each / 60) AS bigint), 'min') AS summary FROM
    (SELECT count(DISTINCT video_id) AS n, floor(epoch(max(started_at)) - epoch(min(started_at))) AS span FROM pipeline_metrics), (SELECT sum(m) AS each FROM (SELECT avg(duration_seconds) AS m FROM pipeline_metrics GROUP BY stage))""")(lambda v: P.progress(v.pipeline_metrics, 100_000))

query("rejected_review", "SELECT video_id, duration_seconds FROM videos WHERE triage_status = 'REJECTED' AND contains(triage_reason, 'rule1') AND contains(lower(title), 'urgent')")(lambda v: V.rejected(v, "rule1", "Urgent", "Longest Duration").select("video_id", "duration_seconds"))
query("source_filter", "SELECT video_id, title FROM videos WHERE (regexp_matches(lower(title), 'hi.h 7') OR regexp_matches(video_id, 'hi.h 7')) AND triage_status IN ('ACCEPTED', 'DONE')")(lambda v: V.sources(v, "HI.H 7").select("video_id", "title"))
query("store_divergence", "SELECT count(*) FILTER (NOT is_deleted) AS in_tables, (SELECT count(DISTINCT video_id) FROM transcript_chunks) AS in_vectors, (SELECT count(*) FROM (SELECT video_id FROM videos UNION SELECT video_id FROM guest_appearances UNION SELECT video_id FROM chunk_topics)) AS in_graph FROM videos")(
    lambda v: V.store_divergence(v, v.transcript_chunks.select("video_id"), G.videos_of(v))
)
query("scan_videos", "SELECT video_id, title, triage_status, checkpoint_stage FROM videos WHERE video_id IN (SELECT video_id FROM pipeline_metrics WHERE scan_id = '3') ORDER BY video_id LIMIT 10")(
    lambda v: V.scan_videos(v.having(videos=v.videos, scan_checkpoints=v.pipeline_metrics.select("scan_id", F.col("video_id").alias("last_video_id"))), "3")
)
query("blueprint_search", "SELECT video_id, title, c.name AS channel_name FROM videos JOIN channels c USING (channel_id) WHERE is_tutorial AND (contains(lower(title), 'urgent') OR contains(lower(c.name), 'urgent'))")(
    lambda v: V.search_blueprints(v.having(videos=v.videos, channels=v.channels, actionable_blueprints=v.videos.select("video_id", F.array("title").alias("steps"), "created_at")), "URGENT").select("video_id", "title", "channel_name")
)
query("citation_groups", "SELECT min(claim_id) AS first, topic AS title, count(*) AS n, string_agg(video_id, ',' ORDER BY claim_id) AS sources FROM claims GROUP BY topic")(
    lambda v: V.citations_by_title(v.tables["claims"].select(F.col("claim_id").alias("rank"), F.col("topic").alias("title"), F.col("video_id").alias("source_id"))).withColumn("sources", F.array_join("sources", ","))
)
