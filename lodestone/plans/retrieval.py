"""Retrieval as one call for many questions: filters, vector search, citations, confidence and the context of a prompt; stances of topics.

Everything is keyed by question, so that one plan serves a table of them; a question keeps at most `top` citations.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import minutes_seconds
from lodestone.plans import vector_index
from lodestone.plans.query_parser import QueryPlan
from lodestone.ship import ship
from lodestone.vault import Vault

#: Characters of an excerpt, words of the answer without hits, and what is suggested then.
EXCERPT = 300
NOTHING = "Insufficient context in the current vault. No relevant transcript chunks were found. Try ingesting more channels or broadening your query."
WITHOUT = ["Can you search for a different topic?", "Try broadening the search filters."]
STANCES = 50


def allowed_videos(vault: Vault, plan: QueryPlan) -> DataFrame:
    """(video_id): videos that meet all filters of a search string, the guest's and the topic's included (any case, the whole name)."""
    where = plan.predicate()
    out = vault.videos if where is None else vault.videos.filter(where)
    out = out.select("video_id").distinct()
    if guest := plan.filters.get("guest"):
        named = F.lower("canonical_name") == guest.lower()
        if "aliases" in vault.guests.columns:
            named = named | F.coalesce(F.exists("aliases", lambda a: F.lower(a) == guest.lower()), F.lit(False))
        seen = vault.guest_appearances.join(vault.guests.filter(named).select("guest_id"), "guest_id", "left_semi")
        out = out.join(seen.select("video_id"), "video_id", "left_semi")
    if topic := plan.filters.get("topic"):
        on = vault.tables["chunk_topics"].filter(F.lower("name") == topic.lower())
        out = out.join(on.select("video_id"), "video_id", "left_semi")
    return out


def cited(found: DataFrame, chunks: DataFrame, vault: Vault, top: int = 8) -> DataFrame:
    """Numbered citations of each question: found (query_id, rank, id, distance), chunks (chunk_id, video_id, text, start_timestamp)."""
    best = found.filter(F.col("rank") <= top).withColumnRenamed("id", "chunk_id")
    full = best.join(chunks.select("chunk_id", "video_id", "text", "start_timestamp"), "chunk_id")
    full = full.join(vault.videos.select("video_id", "title", "channel_id"), "video_id", "left").join(vault.channels.select("channel_id", F.col("name").alias("channel_name")), "channel_id", "left")
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))
    unknown = lambda c: F.coalesce(c, F.lit("Unknown")).alias(c)
    return full.select("query_id", number.alias("number"), "chunk_id", "video_id", unknown("title"), unknown("channel_name"), F.coalesce("start_timestamp", F.lit(0.0)).alias("start"), "distance", F.substring(F.coalesce("text", F.lit("")), 1, EXCERPT).alias("excerpt"))


def confidence_of(citations: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, diversity, relevance, coverage, overall) of each question (query_id, question): channels, nearness, and words of over two characters that some excerpt holds."""
    rows = citations.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("channel_name").alias("channels"), F.avg("distance").alias("distance"), F.collect_list(F.lower("excerpt")).alias("texts"))
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("question", F.lit(""))), r"\s+"), lambda w: F.length(w) > 2))
    met = F.size(F.filter(words, lambda w: F.exists("texts", lambda t: F.contains(t, w))))
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    out = questions.select("query_id", "question").join(rows, "query_id", "left").select(
        "query_id",
        F.coalesce(unit(F.col("channels") / F.col("n")), F.lit(0.0)).alias("diversity"),
        F.coalesce(unit(1 - F.col("distance")), F.lit(0.0)).alias("relevance"),
        F.coalesce(F.try_divide(met.cast("double"), F.size(words)), F.lit(0.0)).alias("coverage"),
    )
    return out.withColumn("overall", 0.5 * F.col("diversity") + 0.3 * F.col("relevance") + 0.2 * F.col("coverage"))


def contexts(citations: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, citations, context): the prompt of each question (query_id, question, and if it has them history and numbers), its parts in fixed order."""
    line = F.concat(F.lit("[source_"), F.col("number").cast("string"), F.lit('] Video: "'), "title", F.lit('" (Channel: '), "channel_name", F.lit(", Timestamp: "), minutes_seconds(F.col("start")), F.lit(")\n"), "excerpt", F.lit("\n"))
    listed = citations.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))).alias("lines"))
    some = lambda c: F.nullif(F.col(c), F.lit("")) if c in questions.columns else F.lit(None).cast("string")
    parts = F.array(
        F.concat(F.lit("PREVIOUS CONVERSATION:\n"), some("history"), F.lit("\n\n---\n")),
        F.concat(some("numbers"), F.lit("\n\n---\n")),
        F.concat(F.lit("CONTEXT CHUNKS:\n"), F.coalesce(F.array_join(F.transform("lines", lambda x: x["line"]), "\n---\n"), F.lit(""))),
        F.concat(F.lit("\nRESEARCH QUESTION:\n"), F.coalesce("question", F.lit(""))),
    )
    return questions.join(listed, "query_id", "left").select("query_id", F.coalesce(F.size("lines"), F.lit(0)).alias("citations"), F.array_join(F.array_compact(parts), "\n\n").alias("context"))


def answered(prompts: DataFrame, model: Callable[[list[str]], list[str]], suggest: Callable[[list[str]], list[list[str]]]) -> DataFrame:
    """prompts (query_id, citations, context) with the model's answer and follow-up questions; those without citations get the fixed ones, and ask no model.

    A call that fails is asked again in halves; a prompt that fails alone has a null answer.
    """
    ship(prompts.sparkSession)

    def each(texts: list[str], call: Callable) -> list:
        if not texts:
            return []
        try:
            out = list(call(texts))
            if len(out) != len(texts):
                raise ValueError("as many replies as prompts are needed")
            return out
        except Exception:
            if len(texts) == 1:
                return [None]
            middle = len(texts) // 2
            return each(texts[:middle], call) + each(texts[middle:], call)

    @F.pandas_udf("struct<answer string, suggestions array<string>>")
    def asked(texts: pd.Series) -> pd.DataFrame:
        known = texts[texts.notna()]
        out = pd.DataFrame({"answer": None, "suggestions": None}, index=texts.index, dtype=object)
        out.loc[known.index, "answer"] = pd.Series(each(known.tolist(), model), index=known.index, dtype=object)
        out["suggestions"] = pd.Series(dict(zip(known.index, each(known.tolist(), suggest))), index=texts.index, dtype=object)
        return out.where(out.notna(), None)

    some = F.col("citations") > 0
    reply = prompts.withColumn("__a", asked(F.when(some, F.col("context"))))
    fixed = F.array(*[F.lit(s) for s in WITHOUT])
    return reply.select(*prompts.columns, F.when(some, F.col("__a.answer")).otherwise(F.lit(NOTHING)).alias("answer"), F.when(some, F.coalesce("__a.suggestions", F.array().cast("array<string>"))).otherwise(fixed).alias("suggestions"))


def retrieve(vault: Vault, index: vector_index.VectorIndex, chunks: DataFrame, questions: DataFrame, where: Column | None = None, k: int = 15, top: int = 8, probes: int | None = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(citations, confidence, contexts) of questions (query_id, question, vector[, history, numbers])."""
    found = vector_index.search(index, questions.select("query_id", "vector"), k, probes, where)
    citations = cited(found, chunks, vault, top)
    return citations, confidence_of(citations, questions), contexts(citations, questions.drop("vector"))


def stances(claims: DataFrame, model: Callable[[str], str], most: int = STANCES) -> DataFrame:
    """(topic, claims, stance, consensus_score, narrative): what a model makes of each topic's claims (claim_id, video_id, topic, claim_text, confidence).

    A prompt lists the `most` surest claims. A reply without an object in it is Inconclusive, a call that fails an Error.
    """
    ship(claims.sparkSession)
    order = Window.partitionBy("topic").orderBy(F.desc_nulls_last("confidence"), "claim_id")
    best = claims.filter("topic IS NOT NULL").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    line = F.concat(F.lit("- "), F.coalesce("claim_text", F.lit("")), F.lit(" (Source: "), F.coalesce("video_id", F.lit("")), F.lit(")"))
    prompts = best.groupBy("topic").agg(F.count("*").alias("claims"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("listed"))

    @F.pandas_udf("string")
    def asked(topics: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for topic, text in zip(topics, texts):
            try:
                out.append(model(f'Topic: "{topic}"\nReply with stance, consensus_score from 0 to 1 and prevailing_narrative as JSON.\nCLAIMS:\n{text}'))
            except Exception:
                out.append(None)
        return pd.Series(out, dtype=object)

    said = prompts.select("topic", "claims", asked("topic", "listed").alias("reply"))
    found = F.from_json(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), "stance string, consensus_score double, prevailing_narrative string")
    said = said.withColumn("x", found)
    bad = F.col("x").isNull() | (F.coalesce(F.col("x.stance"), F.col("x.prevailing_narrative"), F.col("x.consensus_score").cast("string"))).isNull()
    pick = lambda field, open_, error: F.when(F.col("reply").isNull(), error).when(bad, open_).otherwise(F.col(f"x.{field}"))
    return said.select("topic", "claims", pick("stance", F.lit("Inconclusive"), F.lit("Error")).alias("stance"), pick("consensus_score", F.lit(0.5), F.lit(0.0)).alias("consensus_score"), pick("prevailing_narrative", F.lit(None).cast("string"), F.lit(None).cast("string")).alias("narrative"))
