"""Topic dossiers and the numbers that go with an answer: one row for each topic, from one pass over the topics of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import aggregates as A
from lodestone.operators import graph as G
from lodestone.vault import Vault


def quantitative_context(vault: Vault, days: DataFrame | None = None) -> DataFrame:
    """(name, videos, channels, score, level, velocity, trend, mentions, claims, clusters, warning) of every topic."""
    days = A.topic_days(vault, A.topic_lists(vault)) if days is None else days
    claims = vault.claims.groupBy(F.col("topic").alias("name")).agg(F.count("*").alias("claims"), F.count_distinct("cluster_id").alias("clusters"))
    cover = A.topic_coverage(vault, days).select("name", "videos", "channels", "score", "level", "gaps")
    out = cover.join(A.topic_velocity(vault, days), "name", "left").join(claims, "name", "left").fillna(0, ["mentions", "claims", "clusters"])
    return out.withColumn("warning", F.when(F.col("channels") == 1, "one channel only: an echo chamber"))


def dossiers(vault: Vault, top: int = 5) -> DataFrame:
    """quantitative_context() with the leading channels and guests of each topic. The topics of videos are found and written once for all of it."""
    lists = A.topic_lists(vault)
    days = A.topic_days(vault, lists)

    def leading(rows: DataFrame, key: str, n: str, name: str) -> DataFrame:
        rows = rows.select("name", F.col(n).alias("n"), F.col(key).cast("string").alias("id"))
        best = rows.withColumn("__n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), F.desc("id")))).filter(F.col("__n") <= top)
        return best.groupBy("name").agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", "id")))).alias(name))

    channels = leading(days.groupBy("channel_id", "name").agg(F.sum("videos").alias("n")), "channel_id", "n", "leading_channels")
    guests = leading(G.guest_topics(vault, lists), "guest_id", "videos", "leading_guests")
    return quantitative_context(vault, days).join(channels, "name", "left").join(guests, "name", "left")


def dossier_markdown(found: DataFrame) -> DataFrame:
    """(name, text) of dossiers; missing numbers are 0."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    listed = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x["id"], F.lit(": "), x["n"].cast("string"))), "\n"), F.lit(""))
    parts = F.array(
        F.concat(F.lit("# "), "name"),
        F.concat(F.lit("Coverage: "), F.coalesce("level", F.lit("Low")), F.lit(", "), number("videos"), F.lit(" videos, "), number("channels"), F.lit(" channels")),
        F.concat(F.lit("Trend: "), F.coalesce("trend", F.lit("stable")), F.lit(", "), number("mentions"), F.lit(" mentions")),
        F.concat(F.lit("Claims: "), number("claims"), F.lit(" in "), number("clusters"), F.lit(" clusters")),
        F.col("warning"),
        F.lit("## Channels"),
        listed("leading_channels"),
        F.lit("## Guests"),
        listed("leading_guests"),
    )
    return found.select("name", F.array_join(F.array_compact(parts), "\n").alias("text"))
