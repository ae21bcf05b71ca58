"""The vault's tables bound to the star-schema tables of a test folder.

Each view is SQL that Spark and DuckDB both run, so that a query and its oracle start from the
same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.ship import ship
from lodestone.vault import Vault

#: View -> SQL, in order of their use of one another.
VIEWS: dict[str, str] = {
    "channels": """SELECT cast(n_nationkey AS string) AS channel_id, n_name AS name, r_name AS category
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "videos": """SELECT cast(o_orderkey AS string) AS video_id, cast(c_nationkey AS string) AS channel_id,
        concat('Video ', o_orderpriority, ' ', cast(o_orderkey % 100 AS string)) AS title,
        cast(o_orderkey % 4000 + 30 AS int) AS duration_seconds, cast(o_orderdate AS date) AS upload_date,
        cast(round(o_totalprice) AS bigint) AS view_count, o_orderkey % 97 AS like_count, o_orderkey % 31 AS comment_count,
        CASE o_orderstatus WHEN 'F' THEN 'ACCEPTED' WHEN 'O' THEN 'REJECTED' ELSE 'PENDING_REVIEW' END AS triage_status,
        CASE WHEN o_orderkey % 9 = 0 THEN 'manual_override: kept' ELSE concat('rule', cast(o_orderkey % 4 AS string), ':x') END AS triage_reason,
        cast(o_orderkey % 10 AS double) / 10 AS triage_confidence,
        CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'METADATA_HARVESTED' WHEN '2' THEN 'CHUNKED' WHEN '3' THEN 'SUMMARIZED' WHEN '4' THEN 'GRAPH_SYNCED' ELSE 'DONE' END AS checkpoint_stage,
        CASE o_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END AS language_iso, o_orderkey % 3 <> 0 AS needs_translation,
        o_orderkey % 50 = 0 AS is_deleted, o_orderkey % 7 = 0 AS is_tutorial,
        CASE WHEN o_orderkey % 11 = 0 THEN 'scan1' END AS locked_by_scan_id, o_orderdate AS created_at, o_orderdate AS updated_at
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "chunk_rows": """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_discount, l_extendedprice, l_returnflag, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS i FROM lineitem""",
    "transcript_chunks": """SELECT concat(cast(l_orderkey AS string), '__chunk_', lpad(cast(i AS string), 4, '0')) AS chunk_id, cast(l_orderkey AS string) AS video_id,
        cast(i AS int) AS chunk_index, p_name AS cleaned_text, concat('raw ', p_name) AS raw_text, cast(l_quantity AS int) AS word_count,
        cast(i * 10 AS double) AS start_timestamp, cast(i * 10 + 10 AS double) AS end_timestamp
        FROM chunk_rows JOIN part ON l_partkey = p_partkey""",
    "chunk_topics": """SELECT concat(cast(l_orderkey AS string), '__chunk_', lpad(cast(i AS string), 4, '0')) AS chunk_id, cast(l_orderkey AS string) AS video_id,
        ROWS_OF(split(p_name, ' ')) AS name, l_discount * 10 AS relevance FROM chunk_rows JOIN part ON l_partkey = p_partkey""",
    "guests": """SELECT s_suppkey AS guest_id, s_name AS canonical_name, CASE WHEN s_suppkey % 5 = 0 THEN 'ORGANIZATION' ELSE 'PERSON' END AS entity_type,
        cast(abs(round(s_acctbal)) AS bigint) AS mention_count FROM supplier""",
    "guest_appearances": """SELECT DISTINCT l_suppkey AS guest_id, cast(l_orderkey AS string) AS video_id FROM lineitem""",
    "claims": """SELECT l_orderkey * 100 + i AS claim_id, cast(l_orderkey AS string) AS video_id, s_name AS speaker, concat(p_type, ' is ', p_name) AS claim_text, p_brand AS topic,
        cast(i * 10 AS double) AS timestamp, l_discount * 10 AS confidence, concat(p_brand, '/', cast(p_size % 3 AS string)) AS cluster_id
        FROM chunk_rows JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "video_sentiment": """SELECT event_id AS id, cast(event_id % 1500 AS string) AS video_id, event_type AS topic, cast(value AS double) / 100 - 0.5 AS score,
        CASE WHEN value > 60 THEN 'Positive' WHEN value < 20 THEN 'Negative' ELSE 'Neutral' END AS label FROM events""",
    "video_stats_history": """SELECT event_id AS history_id, cast(user_id AS string) AS video_id, ts AS snapshot_at, cast(floor(value) AS bigint) AS view_count FROM events""",
    "pipeline_logs": """SELECT event_id AS log_id, cast(user_id % 7 AS string) AS scan_id, cast(user_id AS string) AS video_id, event_type AS stage,
        CASE WHEN event_id % 5 = 0 THEN 'ERROR' WHEN event_id % 5 = 1 THEN 'WARNING' ELSE 'INFO' END AS level,
        concat('failed at ', event_type, ' with code ', cast(event_id % 3 AS string)) AS message, ts AS timestamp FROM events""",
    "pipeline_metrics": """SELECT event_id AS metric_id, cast(user_id % 7 AS string) AS scan_id, cast(user_id AS string) AS video_id, event_type AS stage, ts AS started_at,
        cast(value AS double) AS duration_seconds, CASE WHEN event_id % 9 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM events""",
    "chat_messages": """SELECT conv_id * 1000 + turn AS message_id, cast(conv_id AS string) AS session_id, turn, role, text AS content FROM conversations""",
    "transcripts": """SELECT cast(doc_id AS string) AS video_id, source AS channel_id, lang AS language_iso, text FROM documents""",
    "urls": """SELECT cast(doc_id AS string) AS url_id, CASE doc_id % 8 WHEN 0 THEN concat('https://www.youtube.com/watch?v=', lpad(cast(doc_id AS string), 11, 'a'), '&list=PLx')
        WHEN 1 THEN concat('https://youtu.be/', lpad(cast(doc_id AS string), 11, 'b')) WHEN 2 THEN concat('https://www.youtube.com/@chan', cast(doc_id AS string))
        WHEN 3 THEN concat('https://www.youtube.com/playlist?list=PL', cast(doc_id AS string)) WHEN 4 THEN concat('https://www.youtube.com/channel/UC', cast(doc_id AS string))
        WHEN 5 THEN concat('https://example.com/watch?x=', cast(doc_id AS string)) WHEN 6 THEN '' ELSE concat('https://www.youtube.com/shorts/', lpad(cast(doc_id AS string), 11, 'c')) END AS url FROM documents""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "conversations", "labels")


def _dialect(sql: str, spark: bool) -> str:
    return sql.replace("ROWS_OF", "explode" if spark else "unnest")


def _uses(sql: str) -> list[str]:
    import re

    return [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]


def needed(sql: str) -> list[str]:
    """Views that a query reads, with those that they read, in order."""
    found: set[str] = set()
    todo = _uses(sql)
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo += [n for n in _uses(VIEWS[name]) if n != name]
    return [n for n in VIEWS if n in found]


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that the query reads as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({_dialect(VIEWS[n], False)})" for n in needed(sql)) + " " + sql if needed(sql) else sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the tables of sf_dir."""
    import re

    sql = VIEWS[name]
    parts = needed(sql)
    body = "\n".join([*(VIEWS[n] for n in parts), sql])
    prefix = "t_" + re.sub(r"\W", "_", sf_dir)
    for table in BASE:
        if re.search(rf"\b{table}\b", body):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"{prefix}_{table}")
    bound = re.compile(r"\b(FROM|JOIN) (" + "|".join(BASE) + r")\b")
    ctes = ", ".join(f"{n} AS ({bound.sub(rf'\1 {prefix}_\2', _dialect(VIEWS[n], True))})" for n in parts if n != name)
    final = bound.sub(rf"\1 {prefix}_\2", _dialect(sql, True))
    return spark.sql((f"WITH {ctes} " if ctes else "") + final)


class Fixture(dict):
    """Views by name, made when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __contains__(self, name: object) -> bool:
        return name in VIEWS

    def __missing__(self, name: str) -> DataFrame:
        self[name] = view(self.spark, self.sf_dir, name)
        return self[name]


def vault(spark: SparkSession, sf_dir: str) -> Vault:
    return Vault(ship(spark), Fixture(spark, sf_dir))
