"""An inverted index for full-text search: postings sorted by term, and lengths of chunks.

A search reads the row groups of its terms only (Parquet keeps each one's least and greatest term),
not the texts; its cost follows the postings of its rarest and commonest words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.cut import stored
from lodestone.plans.search import K1, B, query_tokens, tokens


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, positions) of chunks (chunk_id, video_id, text)."""
    each = chunks.select("chunk_id", F.posexplode(tokens(F.col("text"))).alias("at", "term"))
    return each.groupBy("term", "chunk_id").agg(F.array_sort(F.collect_list("at")).alias("positions"))


def lengths(chunks: DataFrame) -> DataFrame:
    """(chunk_id, video_id, d): tokens of the text and of both ids."""
    d = F.size(tokens(F.col("text"))) + F.size(tokens(F.col("chunk_id"))) + F.size(tokens(F.col("video_id")))
    return chunks.select("chunk_id", "video_id", d.alias("d"))


def build(chunks: DataFrame, path: str) -> None:
    postings(chunks).repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
    lengths(chunks).write.mode("overwrite").parquet(f"{path}/lengths")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")


def refreshed(index: tuple[DataFrame, DataFrame], changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index with the chunks of `changed` put in place of what it had of them."""
    old, sizes = index
    ids = changed.select("chunk_id")
    return old.join(ids, "chunk_id", "left_anti").unionByName(postings(changed)), sizes.join(ids, "chunk_id", "left_anti").unionByName(lengths(changed))


def search(index: tuple[DataFrame, DataFrame], query: str, limit: int | None = 20) -> DataFrame:
    """(chunk_id, video_id, score, f): as plans.search.bm25, from the index."""
    found, sizes = index
    phrase = query_tokens(found.sparkSession, query)
    if not phrase:
        return found.sparkSession.createDataFrame([], "chunk_id string, video_id string, score double, f int")
    own = found.filter(F.col("term").isin(sorted(set(phrase))))
    # places where the phrase begins: of each word, its positions less its place in the phrase
    shifted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(phrase)])
    starts = own.select("chunk_id", F.explode(F.filter(shifted, lambda s: s["w"] == F.col("term"))).alias("s"), "positions").select("chunk_id", "s.i", F.explode(F.transform("positions", lambda p: p - F.col("s.i"))).alias("at"))
    hits = starts.groupBy("chunk_id", "at").agg(F.count("*").alias("n")).filter(F.col("n") == len(phrase)).groupBy("chunk_id").agg(F.count("*").cast("int").alias("f"))
    hits = stored(hits.join(sizes, "chunk_id"), "hits")  # read for their number and for their scores
    stats = sizes.agg(F.count("*").alias("n"), F.avg("d").alias("mean")).join(hits.agg(F.count("*").alias("hits")))  # one row and one row
    idf = F.ln((F.col("n") - F.col("hits") + 0.5) / (F.col("hits") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
    f = F.col("f").cast("double")
    score = -idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d") / F.col("mean")))
    out = hits.join(F.broadcast(stats)).select("chunk_id", "video_id", score.alias("score"), "f")  # one row
    return out if limit is None else out.orderBy("score", "chunk_id").limit(limit)
