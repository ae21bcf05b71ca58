"""Queries over texts, search, entities, lifecycle and exports; registered on import."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.cut import stored
from lodestone.functions import text as X
from lodestone.functions.triage import rule_triage
from lodestone.operators import entities as E
from lodestone.operators import lifecycle as L
from lodestone.plans import dossier, index
from lodestone.plans import search as S
from lodestone.registry import query
from lodestone.sources import export, metadata
from lodestone.vault import upsert


def table(v, name: str) -> DataFrame:
    return v.spark.read.parquet(f"{v.tables.sf_dir}/{name}.parquet")


_W = "list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')"

query("url_parse", r"""SELECT url_id, CASE WHEN NOT regexp_matches(url, 'youtube\.com|youtu\.be') THEN NULL WHEN regexp_matches(url, '[?&]v=[A-Za-z0-9_-]{11}|youtu\.be/[A-Za-z0-9_-]{11}|youtube\.com/(shorts|embed|live)/[A-Za-z0-9_-]{11}') THEN 'video'
    WHEN regexp_matches(url, '[?&]list=') THEN 'playlist' WHEN regexp_matches(url, 'youtube\.com/(channel/UC|@)') THEN 'channel' END AS kind,
    CASE CAST(url_id AS bigint) % 8 WHEN 0 THEN lpad(url_id, 11, 'a') WHEN 1 THEN lpad(url_id, 11, 'b') WHEN 2 THEN concat('chan', url_id) WHEN 3 THEN concat('PL', url_id) WHEN 4 THEN concat('UC', url_id) WHEN 7 THEN lpad(url_id, 11, 'c') END AS id FROM urls""")(lambda v: v.tables["urls"].select("url_id", X.parse_url(F.col("url")).alias("u")).select("url_id", "u.kind", "u.id"))
query("page_urls_rejected", "SELECT page_id FROM pages WHERE NOT regexp_matches(url, 'youtube\\.com|youtu\\.be')")(lambda v: table(v, "pages").filter(X.parse_url(F.col("url"))["kind"].isNull()).select("page_id"))
query("sliding_window_chunks", f"""SELECT concat(video_id, '__chunk_', lpad(cast(i // 320 AS string), 4, '0')) AS chunk_id, i // 320 AS chunk_index, len(w[i + 1 : i + 400]) AS word_count, array_to_string(w[i + 1 : i + 400], ' ') AS text
    FROM (SELECT video_id, w, unnest(range(0, greatest(len(w), 1), 320)) AS i FROM (SELECT video_id, {_W} AS w FROM transcripts)) WHERE len(w) >= 50 AND (i = 0 OR len(w) - i >= 50)""")(lambda v: X.sliding_chunks(v.tables["transcripts"]).select("chunk_id", F.col("chunk_index").cast("long"), F.col("word_count").cast("long"), "text"))
query("word_counts", f"SELECT video_id, len({_W}) AS n FROM transcripts")(lambda v: v.tables["transcripts"].select("video_id", F.size(X.words(F.col("text"))).cast("long").alias("n")))
query("content_hash", "SELECT chunk_id, sha256(cleaned_text) AS h FROM transcript_chunks")(lambda v: v.transcript_chunks.select("chunk_id", X.content_hash(F.col("cleaned_text"), F.col("raw_text")).alias("h")))
query("deep_links", """SELECT chunk_id, concat('https://www.youtube.com/watch?v=', video_id, '&t=', cast(cast(start_timestamp AS bigint) AS string), 's') AS link, printf('%02d:%02d', cast(start_timestamp AS bigint) // 60, cast(start_timestamp AS bigint) % 60) AS at
    FROM transcript_chunks""")(lambda v: v.transcript_chunks.select("chunk_id", X.deep_link(F.col("video_id"), F.col("start_timestamp")).alias("link"), X.minutes_seconds(F.col("start_timestamp")).alias("at")))
query("language_names", "SELECT DISTINCT language_iso, CASE language_iso WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' END AS name FROM transcripts")(lambda v: v.tables["transcripts"].select("language_iso", X.language_name(F.col("language_iso")).alias("name")).distinct())
query("semantic_chunks")(lambda v: X.semantic_chunks(v.tables["transcripts"]))
query("sentences")(lambda v: v.tables["transcripts"].select("video_id", F.size(X.sentences(F.col("text"))).alias("n")))
query("rule_triage", """SELECT video_id, CASE WHEN duration_seconds < 60 THEN 'REJECTED' WHEN channel_id IN ('3', '5') THEN 'ACCEPTED' WHEN list_contains(string_split(lower(title), ' '), '1-urgent') OR list_contains(string_split(lower(title), ' '), '2-high') THEN 'ACCEPTED' ELSE 'NEEDS_LLM' END AS triage_status,
    CASE WHEN duration_seconds < 60 THEN 'duration_under_60s' WHEN channel_id IN ('3', '5') THEN 'verified_channel' WHEN contains(lower(title), '1-urgent') THEN 'keyword_match: 1-URGENT' WHEN contains(lower(title), '2-high') THEN 'keyword_match: 2-HIGH' ELSE 'ambiguous_metadata' END AS triage_reason,
    CASE WHEN duration_seconds < 60 OR channel_id IN ('3', '5') THEN 1.0 WHEN contains(lower(title), '1-urgent') OR contains(lower(title), '2-high') THEN 0.85 ELSE 0.0 END::double AS triage_confidence
    FROM videos""")(lambda v: rule_triage(v.videos, ["1-URGENT", "2-HIGH"], ["3", "5"]).select("video_id", "triage_status", "triage_reason", "triage_confidence"))
_REPLY = """CASE event_id % 5 WHEN 0 THEN concat('```json\\n{"category": "KNOWLEDGE", "confidence": ', user_id % 10 / 10D, ', "reasoning": "talk ', user_id, '"}\\n```')
    WHEN 1 THEN concat('Sure: {"category": "noise", "reasoning": "', event_type, '"} done') WHEN 2 THEN concat('{"confidence": 0.', user_id % 9, '}') WHEN 3 THEN '' END"""
query("triage_replies", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'KNOWLEDGE' WHEN 1 THEN 'NOISE' ELSE 'AMBIGUOUS' END AS category, CASE event_id % 5 WHEN 0 THEN user_id % 10 / 10.0::double WHEN 2 THEN user_id % 9 / 10.0::double ELSE 0.0 END::double AS confidence,
    CASE event_id % 5 WHEN 0 THEN concat('talk ', cast(user_id AS string)) WHEN 1 THEN event_type ELSE '' END AS reasoning FROM events""")(lambda v: table(v, "events").select("event_id", X.triage_reply(F.expr(_REPLY)).alias("r")).select("event_id", "r.*"))

_TOK = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
_PART = "(SELECT chunk_id, video_id, cleaned_text AS text FROM transcript_chunks)"
_BM = f"""SELECT chunk_id, video_id, -(CASE WHEN ln((n - hits + 0.5) / (hits + 0.5)) > 0 THEN ln((n - hits + 0.5) / (hits + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean)) AS score, f FROM (
    SELECT *, count(*) OVER () AS n, count(*) FILTER (f > 0) OVER () AS hits, avg(d) OVER () AS mean FROM (SELECT chunk_id, video_id, len({_TOK.format('text')}) + len({_TOK.format('chunk_id')}) + len({_TOK.format('video_id')}) AS d,
    len(list_filter({_TOK.format('text')}, lambda x: x = 'ring'))::double AS f FROM {_PART})) WHERE f > 0"""


def _texts(v) -> DataFrame:
    return v.transcript_chunks.select("chunk_id", "video_id", "chunk_index", F.col("cleaned_text").alias("text"), "start_timestamp", "end_timestamp")


def _texts_once(v) -> DataFrame:
    """The same, written once: a search reads them several times, and they are a window over all chunks joined to their texts."""
    return stored(_texts(v), "texts")


def _searched(v) -> tuple[DataFrame, DataFrame]:
    texts = _texts_once(v)
    return index.postings(texts), index.lengths(texts)


query("bm25_search", f"SELECT chunk_id, round(score, 6) AS score FROM ({_BM})")(lambda v: S.bm25(_texts_once(v), "Ring", None).select("chunk_id", F.round("score", 6).alias("score")))
_PHRASE = _BM.replace(f"len(list_filter({_TOK.format('text')}, lambda x: x = 'ring'))::double AS f", f"len(list_filter(range(1, len({_TOK.format('text')})), lambda i: {_TOK.format('text')}[i] = 'small' AND {_TOK.format('text')}[i + 1] = 'ring'))::double AS f")
query("bm25_phrase", f"SELECT chunk_id, video_id, round(score, 6) AS score, cast(f AS int) AS f FROM ({_PHRASE})")(lambda v: S.bm25(_texts_once(v), "small ring", None).withColumn("score", F.round("score", 6)))
query("search_all_transcripts", f"SELECT video_id, hits FROM (SELECT video_id, count(*) AS hits, min(score) AS best, any_value(upload_date) AS day FROM ({_BM}) JOIN videos USING (video_id) GROUP BY 1 ORDER BY round(best, 9), hits DESC, day DESC, video_id LIMIT 1000000)")(lambda v: S.search_videos(_texts_once(v), v.videos, "ring", 1_000_000).select("video_id", "hits"))
query("search_transcript", f"SELECT chunk_id FROM {_PART} WHERE video_id = '4' AND contains(text, 'r')")(lambda v: S.search_transcript(_texts(v), "4", "r").select("chunk_id"))
_VEC = [((7 * i) % 13 - 6) / 10.0 for i in range(64)]
query("vector_topk", f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::double[], {_VEC}::double[]), 6) AS distance FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::double[], {_VEC}::double[]), vec_id LIMIT 15")(lambda v: S.nearest(table(v, "embeddings"), _VEC).select("vec_id", F.round("distance", 6).alias("distance")))
query("vector_topk_filtered", f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::double[], {_VEC}::double[]), 6) AS distance FROM embeddings WHERE label IN (1, 2) ORDER BY 1 - list_cosine_similarity(embedding::double[], {_VEC}::double[]), vec_id LIMIT 15")(lambda v: S.nearest(table(v, "embeddings"), _VEC, where=F.col("label").isin(1, 2)).select("vec_id", F.round("distance", 6).alias("distance")))


def _vectors(v, texts: DataFrame) -> DataFrame:
    """Chunks get the vectors of the embeddings table in turn; each vector's distance from the query is found once, not for each of its chunks."""
    e = table(v, "embeddings").select("vec_id", X.cosine_distance(F.col("embedding"), F.array(*[F.lit(x) for x in _VEC])).alias("distance"))
    return texts.withColumn("vec_id", F.pmod(F.crc32("chunk_id"), F.lit(500))).join(e, "vec_id").select("chunk_id", "video_id", "distance")


def _hybrid(v, texts: DataFrame, **rest) -> DataFrame:
    return S.hybrid(texts, _vectors(v, texts), "ring", _VEC, **rest)


def _cited(v) -> DataFrame:
    texts = _texts_once(v)
    return S.citations(_hybrid(v, texts), texts, v.videos, v.channels)


_RV = f"(SELECT vec_id, row_number() OVER (ORDER BY 1 - list_cosine_similarity(embedding::double[], {_VEC}::double[]), vec_id) - 1 AS r FROM embeddings ORDER BY r LIMIT 15)"
_RT = "(SELECT vec_id, vec_id % 5 + vec_id // 5 * 5 AS r FROM embeddings ORDER BY vec_id LIMIT 15)"


def _fused(v) -> DataFrame:
    a = S.nearest(table(v, "embeddings"), _VEC).select(F.col("vec_id").alias("chunk_id"), "distance")
    b = table(v, "embeddings").orderBy("vec_id").limit(15).select(F.col("vec_id").alias("chunk_id"))
    return S.fuse(S.ranked(a, F.col("distance"), F.col("chunk_id")), S.ranked(b, F.col("chunk_id")))


query("rrf_fusion", f"""SELECT coalesce(a.vec_id, b.vec_id) AS chunk_id, round(coalesce(1.0::double / (60 + a.r + 1), 0) + coalesce(1.0::double / (60 + b.r + 1), 0), 9) AS rrf FROM {_RV} a FULL JOIN {_RT} b ON a.vec_id = b.vec_id""")(lambda v: _fused(v).select("chunk_id", F.round("rrf", 9).alias("rrf")))
query("hybrid_search")(lambda v: _hybrid(v, _texts_once(v), topic_videos=v.tables["chunk_topics"].filter(F.col("name") == "small").select("video_id", "relevance")))
query("hybrid_citations")(_cited)
query("confidence_score", """SELECT round(least(count(DISTINCT c.name) / count(*)::double, 1.0), 6) AS diversity, round(greatest(0, least(1, 1 - avg(v.triage_confidence))), 6) AS relevance, 0.5::double AS coverage FROM videos v JOIN channels c USING (channel_id) WHERE v.video_id IN ('1', '2', '3', '4', '5', '6')""")(
    lambda v: S.confidence(v.videos.filter(F.col("video_id").isin("1", "2", "3", "4", "5", "6")).join(v.channels.select("channel_id", F.col("name").alias("channel_name")), "channel_id").select("channel_name", F.col("triage_confidence").alias("distance"), F.col("title").alias("excerpt")), ["video", "unicorn", "a"]).select(F.round("diversity", 6).alias("diversity"), F.round("relevance", 6).alias("relevance"), "coverage")
)
query("chat_history", "SELECT session_id, string_agg(concat(role, ': ', content), chr(10) ORDER BY message_id) AS context FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY message_id DESC) AS rn FROM chat_messages) WHERE rn <= 6 GROUP BY 1")(lambda v: S.history(v.tables["chat_messages"]))

query("guest_purge", "SELECT guest_id FROM guests WHERE length(trim(canonical_name)) >= 2")(lambda v: E.purge_noise(v.having(guests=v.guests, guest_appearances=v.guest_appearances)).guests.select("guest_id"))
query("fuzzy_pairs")(lambda v: E.fuzzy_links(table(v, "customer").select(F.col("c_custkey").alias("guest_id"), F.col("c_name").alias("canonical_name"), F.lit(1).alias("mention_count"))))
query("claim_clusters")(lambda v: E.claim_clusters(v.tables["claims"], X.bag_embedder))
query("bridge_pairs", """SELECT topic_a, category_a, topic_b, category_b FROM (WITH k AS (SELECT DISTINCT category, t.name FROM videos v JOIN channels c ON v.channel_id = c.channel_id JOIN chunk_topics t ON t.video_id = v.video_id WHERE category <> 'UNCLASSIFIED' AND t.name IS NOT NULL),
    p AS (SELECT category, name, row_number() OVER (ORDER BY category, substring(md5(name), 1, 2), name) - 1 AS pos FROM k),
    s AS (SELECT category, count(*) AS n, min(pos) AS a, (SELECT count(*) FROM p) - min(pos) - count(*) AS rest FROM p GROUP BY category),
    b AS (SELECT *, sum(n * rest) OVER (ORDER BY a) - n * rest AS first FROM s), t AS (SELECT sum(n * rest)::bigint AS total FROM s),
    d AS (SELECT * FROM (SELECT turn, ('0x' || substring(md5('0:' || turn), 1, 15))::bigint % total AS v FROM (SELECT unnest(range(0, 60)) AS turn), t) QUALIFY row_number() OVER (PARTITION BY v ORDER BY turn) = 1 ORDER BY turn LIMIT 20),
    e AS (SELECT turn, a + (v - first) // rest AS one, a + n + (v - first) % rest AS two FROM d JOIN b ON rest > 0 AND v >= first AND v < first + n * rest)
    SELECT turn, x.name AS topic_a, x.category AS category_a, y.name AS topic_b, y.category AS category_b FROM e JOIN p x ON x.pos = one JOIN p y ON y.pos = two WHERE x.name <> y.name
    QUALIFY row_number() OVER (PARTITION BY least(x.name, y.name), greatest(x.name, y.name) ORDER BY turn) = 1 ORDER BY turn LIMIT 5)""")(
    lambda v: E.bridge_pairs(v.videos.join(v.channels.select("channel_id", "category"), "channel_id").join(v.tables["chunk_topics"].select("video_id", "name"), "video_id").select("category", "name"))
)
#: Fixed similarity of guests for the merge: a rule in place of names, in bands of neighbouring ids.
_ALIKE = "SELECT a.guest_id, b.guest_id AS other_id, 0.85 + (a.guest_id + b.guest_id) % 15 / 100.0 AS ratio FROM guests a JOIN guests b ON b.guest_id > a.guest_id AND b.guest_id < a.guest_id + 40 AND (a.guest_id * 31 + b.guest_id * 17) % 13 = 0"


def _alike(v) -> DataFrame:
    ids = v.guests.select("guest_id")
    near = ids.select("guest_id", F.explode(F.sequence(F.col("guest_id") + 1, F.col("guest_id") + 39)).alias("other_id")).join(ids.withColumnRenamed("guest_id", "other_id"), "other_id", "left_semi")
    return near.filter((F.col("guest_id") * 31 + F.col("other_id") * 17) % 13 == 0).withColumn("ratio", 0.85 + (F.col("guest_id") + F.col("other_id")) % 15 / 100.0)


query("fuzzy_merge_plan", f"""SELECT id, survivor FROM (WITH RECURSIVE p AS ({_ALIKE}), q AS (SELECT * FROM p UNION ALL SELECT other_id, guest_id, ratio FROM p),
    l AS (SELECT guest_id, list(other_id) AS others FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY guest_id ORDER BY ratio DESC, other_id) <= 4) GROUP BY guest_id),
    o AS (SELECT guest_id, coalesce(others, []) AS others, row_number() OVER (ORDER BY mention_count DESC, guest_id) AS n FROM guests LEFT JOIN l USING (guest_id)),
    place AS (SELECT map(list(guest_id), list(n)) AS m FROM o),
    r AS (SELECT 0::bigint AS n, []::bigint[] AS merged, []::bigint[] AS new, NULL::bigint AS survivor
        UNION ALL SELECT o.n, list_concat(merged, fresh), fresh, o.guest_id FROM (SELECT o.n, o.guest_id, r.merged,
            CASE WHEN list_contains(r.merged, o.guest_id) THEN []::bigint[] ELSE list_filter(o.others, lambda x: NOT list_contains(r.merged, x) AND m[x] > o.n) END AS fresh FROM r JOIN o ON o.n = r.n + 1, place) o)
    SELECT unnest(new) AS id, survivor FROM r)""")(lambda v: E.merge_plan(v.guests, _alike(v)))

query("upsert_merge", """SELECT coalesce(a.guest_id, b.guest_id) AS guest_id, coalesce(a.canonical_name, b.canonical_name) AS canonical_name, coalesce(a.mention_count, 0) + coalesce(b.n, 0) AS mention_count
    FROM guests a FULL JOIN (SELECT guest_id + 5 AS guest_id, concat('new ', cast(guest_id AS string)) AS canonical_name, 2 AS n FROM guests) b ON a.guest_id = b.guest_id""")(
    lambda v: upsert(v.guests.select("guest_id", "canonical_name", "mention_count"), v.guests.select((F.col("guest_id") + 5).alias("guest_id"), F.concat(F.lit("new "), F.col("guest_id").cast("string")).alias("canonical_name"), F.lit(2).cast("long").alias("mention_count")), ["guest_id"], {"canonical_name": "keep", "mention_count": "add"})
)
query("soft_delete", "SELECT video_id, is_deleted OR channel_id = '3' AS is_deleted FROM videos")(lambda v: L.soft_delete(v, F.col("channel_id") == "3").videos.select("video_id", "is_deleted"))
query("remaining_stages", "SELECT video_id, CASE checkpoint_stage WHEN 'METADATA_HARVESTED' THEN 12 WHEN 'CHUNKED' THEN 6 WHEN 'SUMMARIZED' THEN 4 WHEN 'GRAPH_SYNCED' THEN 2 ELSE 0 END AS n FROM videos")(lambda v: v.videos.select("video_id", F.size(L.remaining_stages(F.col("checkpoint_stage"))).cast("long").alias("n")))
query("purge_orphans", "SELECT guest_id FROM guests WHERE guest_id NOT IN (SELECT guest_id FROM guest_appearances WHERE video_id IN (SELECT video_id FROM videos WHERE channel_id = '3')) OR guest_id IN (SELECT guest_id FROM guest_appearances WHERE video_id NOT IN (SELECT video_id FROM videos WHERE channel_id = '3'))")(
    lambda v: L.purge(v.having(**{t: v.tables[t] for t in ("videos", "guests", "guest_appearances", "claims")}), v.videos.filter("channel_id = '3'")).guests.select("guest_id")
)
query("release_locks", "SELECT video_id FROM videos WHERE locked_by_scan_id IS NULL OR locked_by_scan_id = 'scan1'")(lambda v: L.release(v, "scan1").videos.filter("locked_by_scan_id is null").select("video_id"))
query("claim_locks", "SELECT video_id, coalesce(locked_by_scan_id, CASE WHEN channel_id = '3' THEN 'a' END) AS owner FROM videos")(
    lambda v: L.claim(v, v.videos.filter("channel_id = '3'").select("video_id", F.lit("b").alias("scan_id")).union(v.videos.filter("channel_id = '3'").select("video_id", F.lit("a")))).videos.select("video_id", F.col("locked_by_scan_id").alias("owner"))
)
query("metadata_ingest", "SELECT cast(doc_id AS string) AS video_id, substring(text, 1, 500) AS description, date '2024-01-15' AS upload_date FROM documents")(
    lambda v: metadata.parse_metadata(table(v, "documents").select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("description"), F.lit("20240115").alias("upload_date"))).alias("json")))[0].select("video_id", "description", "upload_date")
)
query("choose_transcript", "SELECT source AS video_id, CASE WHEN count(*) FILTER (lang = 'en' AND doc_id % 2 = 0) > 0 OR count(*) FILTER (lang = 'en') > 0 THEN 'en' ELSE min(lang) END AS language FROM documents GROUP BY source")(
    lambda v: metadata.choose_transcript(table(v, "documents").select(F.col("source").alias("video_id"), F.col("lang").alias("language"), (F.col("doc_id") % 2 == 0).alias("manual"), "text")).select("video_id", "language")
)
query("export_guests", "SELECT canonical_name, entity_type, '' AS aliases, mention_count FROM guests")(lambda v: export.guests_table(v.having(guests=v.guests.withColumn("aliases", F.array().cast("array<string>")))))
query("export_sessions", "SELECT session_id, string_agg(concat('**', upper(role[1]), role[2:], '**: ', content), chr(10) || chr(10) ORDER BY message_id) AS text FROM chat_messages GROUP BY 1")(lambda v: export.session_markdown(v))
query("export_claim_notes", "SELECT concat('claims/claim ', cast(claim_id AS string), '.md') AS path FROM claims JOIN videos USING (video_id)")(lambda v: export.notes(v, "claims").select("path"))
query("export_video_packages")(lambda v: export.video_packages(v))
query("bm25_indexed", f"SELECT chunk_id, round(score, 6) AS score FROM ({_BM})")(lambda v: index.search(_searched(v), "Ring", None).select("chunk_id", F.round("score", 6).alias("score")))
query("bm25_indexed_phrase", f"SELECT chunk_id, round(score, 6) AS score FROM ({_PHRASE})")(lambda v: index.search(_searched(v), "small ring", None).select("chunk_id", F.round("score", 6).alias("score")))
query("postings", f"SELECT term, count(*) AS chunks, cast(sum(n) AS bigint) AS n FROM (SELECT chunk_id, term, count(*) AS n FROM (SELECT chunk_id, unnest({_TOK.format('text')}) AS term FROM {_PART}) GROUP BY 1, 2) GROUP BY 1")(
    lambda v: index.postings(_texts(v)).groupBy("term").agg(F.count("*").alias("chunks"), F.sum(F.size("positions")).alias("n"))
)
query("dossiers", """SELECT name, count(DISTINCT t.video_id) AS videos, count(DISTINCT v.channel_id) AS channels, count(DISTINCT t.chunk_id) AS mentions FROM chunk_topics t JOIN videos v USING (video_id) GROUP BY 1""")(lambda v: dossier.dossiers(v).select("name", "videos", "channels", "mentions"))
query("dossier_markdown")(lambda v: dossier.dossier_markdown(dossier.dossiers(v)))
