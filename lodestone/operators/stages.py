"""Transforms of the stages of a video, and how far a scan has come.

A state is a row (video_id, language_iso, raw_text, cleaned_text, translated_text, segments). Stages take rows and
return them with `ok`, as `streaming.stages.step` wants them. A model is a function from a column of inputs to a
column of replies (`functions.text.model_column` makes one from Python); a null input asks for no call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as X
from lodestone.functions.triage import finish_triage, rule_triage, triage_prompt

Model = Callable[[Column], Column]

#: Characters of a text that each kind of call reads.
EXTRACT, GROUP, REDUCE = 3000, 12000, 25000
#: Chunks under this many words aren't analysed; chunks of a group that is summarised at once.
LEAST_WORDS, GROUP_SIZE = 20, 4
#: Kinds of what an analysis finds in a chunk.
KINDS = ("topics", "entities", "claims", "quotes", "references")
#: Names of stages in reports of progress.
REPORTED = ["DISCOVERY", "TRIAGE_COMPLETE", "TRANSCRIPT_FETCHED", "SPONSOR_FILTERED", "TEXT_NORMALIZED", "CHUNKED", "CHUNK_ANALYZED", "EMBEDDED", "GRAPH_SYNCED", "DONE"]


def _some(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def triage(videos: DataFrame, judge: Model, keywords: list[str], verified: list[str] = ()) -> DataFrame:
    """Rules first; the model decides what they leave open, and an unsure reply leaves the video to a person."""
    ruled = rule_triage(videos, keywords, verified)
    asked = F.col("triage_status") == "NEEDS_LLM"
    ruled = ruled.withColumn("__reply", X.triage_reply(judge(F.when(asked, triage_prompt()))))
    reply = F.col("__reply")
    return ruled.withColumns({
        "triage_status": F.when(asked, finish_triage(reply["category"], reply["confidence"])).otherwise(F.col("triage_status")),
        "triage_reason": F.when(asked, F.concat(F.lit("llm:"), reply["reasoning"])).otherwise(F.col("triage_reason")),
        "triage_confidence": F.when(asked, reply["confidence"]).otherwise(F.col("triage_confidence")),
        "ok": F.lit(True),
    }).drop("__reply")


def transcript(videos: DataFrame, chosen: DataFrame) -> DataFrame:
    """Videos with the language of their transcript (video_id, language); one without any is done."""
    found = chosen.select("video_id", F.col("language").alias("__language"), F.lit(True).alias("__found"))
    joined = videos.join(found, "video_id", "left")
    ok = F.coalesce("__found", F.lit(False))
    return joined.withColumns({
        "language_iso": F.coalesce("__language", "language_iso"),
        "needs_translation": F.when(ok, F.coalesce(F.col("__language") != "en", F.lit(True))).otherwise(F.col("needs_translation")),
        "checkpoint_stage": F.when(ok, F.col("checkpoint_stage")).otherwise(F.lit("DONE")),
        "ok": ok,
    }).drop("__language", "__found")


def translate(states: DataFrame, model: Model) -> DataFrame:
    """States with translated_text where the language isn't English and there is text; a null reply fails."""
    wanted = F.coalesce(F.col("language_iso") != "en", F.lit(True)) & (F.coalesce("raw_text", F.lit("")) != "")
    out = states.withColumn("__reply", model(F.when(wanted, F.col("raw_text"))))
    reply = F.when(wanted, F.col("__reply"))
    return out.withColumns({"translated_text": F.coalesce(reply, F.col("translated_text")), "ok": ~wanted | F.col("__reply").isNotNull()}).drop("__reply")


def sponsor_filter(states: DataFrame, skips: DataFrame) -> DataFrame:
    """States without the segments whose middle lies in a skip (video_id, start, end), ends included; raw_text is what stays.

    Skips meet their video as one list, so segments aren't exploded. Null segments leave a state as it is.
    """
    lists = skips.groupBy("video_id").agg(F.collect_list(F.struct(F.col("start").alias("from"), F.col("end").alias("to"))).alias("__skips"))
    middle = lambda s: s["start"] + s["duration"] / 2
    cut = F.filter("segments", lambda s: ~F.exists("__skips", lambda k: middle(s).between(k["from"], k["to"])))
    out = states.join(lists, "video_id", "left").withColumn("segments", F.when(F.col("__skips").isNull(), F.col("segments")).otherwise(cut)).drop("__skips")
    return out.withColumns({"raw_text": F.when(F.col("segments").isNull(), F.col("raw_text")).otherwise(F.array_join(F.col("segments")["text"], " ")), "ok": F.lit(True)})


def normalize(states: DataFrame, clean: Model, diarize: Model) -> DataFrame:
    """States with cleaned_text: the translated text, else the raw one, cleaned, then marked by speakers; a null or empty reply changes nothing."""
    source = _some(F.col("translated_text"), F.col("raw_text"))
    out = states.withColumn("__text", source).withColumn("__clean", _some(clean(F.col("__text")), F.col("__text")))
    cleaned = _some(diarize(F.col("__clean")), F.col("__clean"))
    return out.withColumns({"cleaned_text": F.when(F.col("__text").isNotNull(), cleaned).otherwise(F.col("cleaned_text")), "ok": F.lit(True)}).drop("__text", "__clean")


def state_text(states: DataFrame) -> DataFrame:
    """(video_id, text): the cleaned text, else the translated, else the raw one."""
    return states.select("video_id", _some(F.col("cleaned_text"), F.col("translated_text"), F.col("raw_text")).alias("text"))


def chunks(states: DataFrame, embed: Callable | None = None, size: int = 400, overlap: int = 80, least: int = 50) -> DataFrame:
    """(video_id, chunk_index, text) of states: semantic chunks if there is a model, sliding windows where those give none."""
    texts = state_text(states).filter("text is not null")
    if embed is None:
        return X.sliding_chunks(texts, size, overlap, least).select("video_id", "chunk_index", "text")
    semantic = X.semantic_chunks(texts, embed, most=size + 200, least=least).select("video_id", "chunk_index", "text")
    rest = texts.join(semantic.select("video_id").distinct(), "video_id", "left_anti")
    return semantic.unionByName(X.sliding_chunks(rest, size, overlap, least).select("video_id", "chunk_index", "text"))


def chunked(states: DataFrame, made: DataFrame) -> DataFrame:
    """States with `ok`: false for a text that gave no chunk; a state without text passes."""
    has = made.select("video_id").distinct().withColumn("__made", F.lit(True))
    text = _some(F.col("cleaned_text"), F.col("translated_text"), F.col("raw_text"))
    return states.join(has, "video_id", "left").withColumn("ok", text.isNull() | F.col("__made").isNotNull()).drop("__made")


def analyse(rows: DataFrame, models: dict[str, Model]) -> DataFrame:
    """Chunks (chunk_id, video_id, text, ...) with an array of strings for each kind, from the first 3000 characters.

    Chunks under 20 words and replies that are no JSON list give empty arrays.
    """
    long = F.size(X.words(F.col("text"))) >= LEAST_WORDS
    asked = F.when(long, F.substring("text", 1, EXTRACT))
    none = F.array().cast("array<string>")
    return rows.withColumns({k: F.coalesce(X.json_list(models[k](asked), "string"), none) if k in models else none for k in KINDS})


def analysis_counts(analysed: DataFrame) -> DataFrame:
    """(video_id, topics, entities, claims, quotes, references): how many of each kind a video's chunks hold."""
    return analysed.groupBy("video_id").agg(*[F.sum(F.size(k)).alias(k) for k in KINDS])


def findings(analysed: DataFrame, kind: str) -> DataFrame:
    """(chunk_id, video_id, place, found): one row for each thing of a kind."""
    return analysed.select("chunk_id", "video_id", F.posexplode(kind).alias("place", "found"))


def summary_groups(rows: DataFrame, size: int = GROUP_SIZE) -> DataFrame:
    """(video_id, part, text): chunks (chunk_id, video_id, chunk_index, text) of a video in order, `size` together, 12000 characters at most."""
    w = Window.partitionBy("video_id").orderBy("chunk_index", "chunk_id")
    numbered = rows.select("video_id", "chunk_index", "chunk_id", "text", F.floor((F.row_number().over(w) - 1) / size).cast("int").alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text")))
    return numbered.groupBy("video_id", "part").agg(F.substring(F.array_join(F.transform(ordered, lambda x: x["text"]), " "), 1, GROUP).alias("text"))


def summarise(rows: DataFrame, bullets: Model, synthesise: Model, size: int = GROUP_SIZE) -> DataFrame:
    """(video_id, summary_text): bullets of each group, then one text from all bullets (25000 characters at most).

    Groups follow one another by their names as text (group_10 before group_2); empty bullets are left out, and a
    video without any has no row.
    """
    said = summary_groups(rows, size).withColumn("b", F.trim(bullets(F.col("text")))).filter("b <> ''")
    named = F.struct(F.concat(F.lit("group_"), F.col("part").cast("string")).alias("name"), F.col("b"))
    joined = said.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(named)), lambda x: x["b"]), "\n\n").alias("all"))
    return joined.select("video_id", synthesise(F.substring("all", 1, REDUCE)).alias("summary_text"))


def corroborate(claims: DataFrame, counts: DataFrame) -> DataFrame:
    """Claims with the number of channels of their cluster (cluster_id, corroboration_count), zero without one."""
    return claims.drop("corroboration_count").join(counts, "cluster_id", "left").fillna(0, ["corroboration_count"])


def completion(videos: Column, stage: Column, found: int, stages: int) -> Column:
    """Percent of a scan: videos done and the share of the present one, 99.9 at most; 0 if nothing was found."""
    part = videos * 100.0 / max(found, 1) + stage / max(1, stages) * (100.0 / max(found, 1))
    return F.least(F.lit(99.9), part) if found else F.lit(0.0)


def reported_stage(index: Column) -> Column:
    """The name of a stage by its number from 0 in reports."""
    return F.coalesce(F.get(F.array(*[F.lit(s) for s in REPORTED]), index.cast("int")), F.concat(F.lit("STAGE_"), index.cast("string")))


def progress(metrics: DataFrame, found: int) -> DataFrame:
    """One row (summary): found, completed, throughput and time left, from metrics of stages; a completed video has any."""
    span = F.timestamp_diff("SECOND", F.min("started_at").cast("timestamp"), F.max("started_at").cast("timestamp"))
    total = metrics.agg(F.count_distinct("video_id").alias("n"), span.alias("span"))
    means = metrics.groupBy("stage").agg(F.avg("duration_seconds").alias("mean")).agg(F.coalesce(F.sum("mean"), F.lit(0.0)).alias("each"))
    rate = F.try_divide(F.col("n") * 3600.0, F.nullif(F.col("span"), F.lit(0)))
    left = F.floor((found - F.col("n")) * F.col("each") / 60).cast("long")
    text = F.concat_ws(" | ", F.concat(F.lit(f"Discovered: {found}"), F.lit("")), F.concat(F.lit("Completed: "), F.col("n").cast("string")), F.when(rate > 0, F.format_string("Throughput: %.1f videos/hour", rate)), F.when(F.col("each") > 0, F.concat(F.lit("ETA: ~"), left.cast("string"), F.lit("min"))))
    # two tables of one row
    return total.join(means).select(F.when(F.col("n") == 0, "ETA: Calculating...").otherwise(text).alias("summary"))
