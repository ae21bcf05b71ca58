"""Full-text, vector and hybrid search, with citations and confidence."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.cut import stored
from lodestone.functions.text import cosine_distance, deep_link, minutes_seconds

K1, B, RRF_K = 1.2, 0.75, 60
#: Letters with marks fold to their base letters by decomposition.
_MARKED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, marks folded."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), _MARKED, _PLAIN)
    return F.array_remove(F.split(folded, r"[^\p{L}\p{N}]+"), "")


def occurrences(doc: Column, phrase: list[str]) -> Column:
    """How often the tokens of a phrase follow one another in a document's tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(doc, lambda x: x == phrase[0]))
    lit = F.array(*[F.lit(p) for p in phrase])

    def count(d: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(d) - len(phrase) + 1, F.lit(1)))
        return F.size(F.filter(starts, lambda i: F.slice(d, i, len(phrase)) == lit))

    # the tokens are bound once: inside the lambda they would be made anew for each start
    return F.element_at(F.transform(F.array(doc), count), 1)


def query_tokens(spark, query: str) -> list[str]:
    """Tokens of a query by the same rules as documents'; one row."""
    return list(spark.range(1).select(tokens(F.lit(query.replace('"', "")))).first()[0])


def bm25(chunks: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """(chunk_id, video_id, score, f) of chunks (chunk_id, video_id, text) that hold the query as a phrase; less is better.

    Lengths count the tokens of the text and of both ids, as an index over the three columns does.
    Two passes, no shuffle of texts: one for counts, one for the hits.
    """
    phrase = query_tokens(chunks.sparkSession, query)
    if not phrase:
        return chunks.sparkSession.createDataFrame([], "chunk_id string, video_id string, score double, f int")
    t = tokens(F.col("text"))
    length = F.size(t) + F.size(tokens(F.col("chunk_id"))) + F.size(tokens(F.col("video_id")))
    rows = chunks.select("chunk_id", "video_id", length.alias("d"), occurrences(t, phrase).alias("f"))
    stats = rows.agg(F.count("*").alias("n"), F.count_if(F.col("f") > 0).alias("hits"), F.avg("d").alias("mean"))
    idf = F.ln((F.col("n") - F.col("hits") + 0.5) / (F.col("hits") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
    f = F.col("f").cast("double")
    score = -idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d") / F.col("mean")))
    out = rows.filter("f > 0").join(F.broadcast(stats)).select("chunk_id", "video_id", score.alias("score"), "f")  # one row
    return out if limit is None else out.orderBy("score", "chunk_id").limit(limit)


def search_videos(chunks: DataFrame, videos: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """(video_id, hits, best): videos by their best chunk, then hits, then date."""
    found = bm25(chunks, query, None).groupBy("video_id").agg(F.count("*").alias("hits"), F.min("score").alias("best"))
    return found.join(videos.select("video_id", "upload_date"), "video_id").orderBy("best", F.col("hits").desc(), F.col("upload_date").desc(), "video_id").limit(limit)


def snippet(text: Column, query: Column, width: int = 30) -> Column:
    """At most `width` words around the first hit, the hit in bold; any case."""
    w = F.split(text, r"\s+")
    first = F.array_position(F.transform(w, lambda x: F.contains(F.lower(x), F.lower(query))), True)
    start = F.greatest(first - width // 2, F.lit(1))
    part = F.array_join(F.slice(w, start.cast("int"), width), " ")
    marked = F.regexp_replace(part, F.concat(F.lit(r"(?i)(\Q"), query, F.lit(r"\E)")), F.lit("<b>$1</b>"))
    return F.concat(F.when(start > 1, "...").otherwise(""), marked, F.when(F.size(w) > start + width - 1, "...").otherwise(""))


#: Marks of a hit and of what is left out.
OPEN, CLOSE, GAP = "<b>", "</b>", "..."
_TOKEN = r"[\p{L}\p{N}]+"


def best_snippet(text: Column, phrases: list[list[str]], width: int = 30) -> Column:
    """The `width` tokens of a text that show most of the phrases (lists of tokens as query_tokens gives them), every hit in bold; null without a hit.

    A window begins at a hit and counts 1000 for each phrase that lies in it whole and one for each token of its hits; the first of the best is taken
    and moved so that its hits stand in the middle. Text between tokens stays as it is; hits side by side share their marks; `...` stands for what is left out.
    Positions are made once; a window looks at the next `width` hits of each phrase at most, so long texts with many hits take linear time.
    """
    phrases = [p for p in phrases if p]
    if not phrases:
        return F.lit(None).cast("string")
    raw = F.coalesce(text, F.lit(""))
    parts = F.struct(F.regexp_extract_all(raw, F.lit(_TOKEN), F.lit(0)).alias("t"), F.split(raw, _TOKEN, -1).alias("s"))

    def hits(d: Column) -> Column:
        """struct(start, size, phrase) in order, starts from 0."""
        norm = F.transform(d["t"], lambda x: F.translate(F.lower(x), _MARKED, _PLAIN))

        def found(n: Column) -> Column:
            every = []
            for k, phrase in enumerate(phrases):
                size = len(phrase)
                # tokens compared in place: a slice for each start would be an array for each token
                here = lambda i: reduce(Column.__and__, [F.get(n, i + j) == word for j, word in enumerate(phrase)])  # noqa: B023, E731
                at = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(n) - size, F.lit(0))), here), lambda i: i + 1)
                every.append(F.transform(at, lambda i: F.struct((i - 1).alias("start"), F.lit(size).alias("size"), F.lit(k).alias("phrase"))))  # noqa: B023
            return F.array_sort(F.concat(*every))

        return F.element_at(F.transform(F.array(norm), found), 1)

    def window(d: Column, h: Column) -> Column:
        """struct(score, -start, last) of the best window."""

        def scored(x: Column, j: Column) -> Column:
            inside = F.filter(F.slice(h, j + 1, width * len(phrases)), lambda y: (y["start"] + y["size"]) <= (x["start"] + width))
            kinds = F.size(F.array_distinct(F.transform(inside, lambda y: y["phrase"])))
            total = F.aggregate(inside, F.lit(0), lambda s, y: s + y["size"])
            last = F.aggregate(inside, x["start"], lambda s, y: F.greatest(s, y["start"] + y["size"]))
            return F.struct((kinds * 1000 + total).alias("score"), (-x["start"]).alias("back"), last.alias("last"))

        return F.array_max(F.transform(h, scored))

    def shown(d: Column, h: Column, w: Column) -> Column:
        n = F.size(d["t"])
        first = -w["back"]
        begin = F.greatest(F.least(first - F.floor((width - (w["last"] - first)) / 2).cast("int"), n - width), F.lit(0))
        end = F.least(begin + width, n)
        near = F.filter(h, lambda y: (y["start"] >= begin) & (y["start"] + y["size"] <= end))
        marked = F.array_distinct(F.flatten(F.transform(near, lambda y: F.sequence(y["start"], y["start"] + y["size"] - 1))))

        def piece(i: Column, m: Column) -> Column:
            on = F.array_contains(m, i)
            before = F.when(i > begin, F.get(d["s"], i)).otherwise(F.lit(""))
            opens = F.when(on & ~F.array_contains(m, i - 1), OPEN).otherwise("")
            closes = F.when(on & ~F.array_contains(m, i + 1), CLOSE).otherwise("")
            return F.concat(before, opens, F.get(d["t"], i), closes)

        body = F.element_at(F.transform(F.array(marked), lambda m: F.array_join(F.transform(F.sequence(begin, end - 1), lambda i: piece(i, m)), "")), 1)
        return F.concat(F.when(begin > 0, GAP).otherwise(F.get(d["s"], F.lit(0))), body, F.when(end < n, GAP).otherwise(F.get(d["s"], n)))

    def of(d: Column) -> Column:
        with_hits = F.transform(F.array(hits(d)), lambda h: F.transform(F.array(window(d, h)), lambda w: F.when(F.size(h) > 0, shown(d, h, w))))
        return F.element_at(F.element_at(with_hits, 1), 1)

    # each step's value is bound once by a one-element array: a lambda would make it anew for each use
    return F.element_at(F.transform(F.array(parts), of), 1)


def plain_snippet(text: str | None, phrases: list[list[str]], width: int = 30) -> str | None:
    """best_snippet in plain Python, for tests."""
    import re

    found = list(re.finditer(r"[^\W_]+", text or ""))
    norm = [m.group().lower().translate(str.maketrans(_MARKED, _PLAIN)) for m in found]
    hits = sorted((i, len(p), k) for k, p in enumerate(phrases) if p for i in range(len(norm) - len(p) + 1) if norm[i : i + len(p)] == p)
    if not hits:
        return None
    best = None
    for start, _, _ in hits:
        inside = [h for h in hits if h[0] >= start and h[0] + h[1] <= start + width]
        score = 1000 * len({h[2] for h in inside}) + sum(h[1] for h in inside)
        if best is None or score > best[0]:
            best = score, start, max([start, *(h[0] + h[1] for h in inside)])
    _, first, last = best
    begin = max(min(first - (width - (last - first)) // 2, len(norm) - width), 0)
    end = min(begin + width, len(norm))
    marked = {i for h in hits if h[0] >= begin and h[0] + h[1] <= end for i in range(h[0], h[0] + h[1])}
    out = GAP if begin else text[: found[0].start()]
    for i in range(begin, end):
        out += (text[found[i - 1].end() : found[i].start()] if i > begin else "") + (OPEN if i in marked and i - 1 not in marked else "") + found[i].group() + (CLOSE if i in marked and i + 1 not in marked else "")
    return out + (GAP if end < len(norm) else text[found[-1].end() :])


def search_transcript(chunks: DataFrame, video_id: str, query: str) -> DataFrame:
    """Chunks of one video by full text; where that finds none, by substring."""
    own = chunks.filter(F.col("video_id") == video_id)
    ranked = bm25(own, query, None).select("chunk_id", F.lit(0).alias("way"), "score")
    plain = own.filter(F.contains(F.lower("text"), F.lower(F.lit(query)))).select("chunk_id", F.lit(1).alias("way"), F.lit(0.0).alias("score"))
    both = ranked.unionByName(plain)
    least = both.agg(F.min("way").alias("way"))
    return both.join(F.broadcast(least), "way").join(own, "chunk_id").withColumn("snippet", snippet(F.col("text"), F.lit(query))).orderBy("score", "chunk_id")  # one row


def nearest(vectors: DataFrame, query: list[float], limit: int = 15, where: Column | None = None, text_has: str | None = None) -> DataFrame:
    """Exact nearest neighbours by cosine distance: filter, distance, top-k per partition, then of those. Rows that have a `distance` from the query keep it."""
    rows = vectors if where is None else vectors.filter(where)
    if text_has:
        rows = rows.filter(F.contains("text", F.lit(text_has)))
    wanted = F.array(*[F.lit(float(x)) for x in query])
    key = vectors.columns[0]
    if "distance" not in rows.columns:
        rows = rows.withColumn("distance", cosine_distance(F.col("embedding"), wanted))
    return rows.orderBy("distance", key).limit(limit)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Ranks from 0 of a short, limited list."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def fuse(vector_hits: DataFrame, text_hits: DataFrame, k: int = RRF_K, neutral: float = 0.5) -> DataFrame:
    """(chunk_id, distance, rrf, position) of two short lists (chunk_id, rank[, distance]) by reciprocal ranks; ties keep vector hits first."""
    v = vector_hits.select("chunk_id", F.col("rank").alias("v"), "distance")
    t = text_hits.select("chunk_id", F.col("rank").alias("t"))
    both = v.join(t, "chunk_id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c) + 1), F.lit(0.0))
    out = both.select("chunk_id", F.coalesce("distance", F.lit(neutral)).alias("distance"), (part("v") + part("t")).alias("rrf"), F.coalesce("v", F.lit(1_000_000) + F.col("t")).alias("tie"))
    return out.withColumn("position", F.row_number().over(Window.orderBy(F.col("rrf").desc(), "tie")) - 1).drop("tie")


def topic_boost(hits: DataFrame, videos: DataFrame, weight: float = 0.2) -> DataFrame:
    """Distances lowered by weight * relevance for hits in videos (video_id, relevance) on the topic, never under 0."""
    return hits.join(videos.groupBy("video_id").agg(F.max("relevance").alias("__r")), "video_id", "left").withColumn("distance", F.greatest(F.lit(0.0), F.col("distance") - weight * F.coalesce("__r", F.lit(0.0)))).drop("__r")


def heat_boost(hits: DataFrame, heat: DataFrame, threshold: float = 0.7, factor: float = 0.8) -> DataFrame:
    """Distances times 0.8 for hits (start, end) that overlap a hot interval (video_id, start, end, score)."""
    h = heat.select(F.col("video_id").alias("__v"), F.col("start").alias("__a"), F.col("end").alias("__b"), "score")
    peak = hits.join(h, (F.col("video_id") == F.col("__v")) & (F.col("__a") <= F.col("end")) & (F.col("__b") >= F.col("start"))).groupBy("chunk_id").agg(F.max("score").alias("__peak"))
    return hits.join(peak, "chunk_id", "left").withColumn("distance", F.col("distance") * F.when(F.col("__peak") >= threshold, factor).otherwise(1.0)).drop("__peak")


def drop_neighbours(hits: DataFrame) -> DataFrame:
    """Of neighbouring chunks of a video the nearer stays, in the order of position: greedy, per video over a short list."""
    schema = hits.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: dict[int, dict] = {}
        for row in pdf.sort_values("position").to_dict("records"):
            i = int(row["chunk_index"])
            near = next((j for j in (i - 1, i + 1) if j in kept), None)
            if near is not None:
                if row["distance"] < kept[near]["distance"]:
                    del kept[near]
                    kept[i] = row
            elif i not in kept or row["distance"] < kept[i]["distance"]:
                kept[i] = row
        return pd.DataFrame(list(kept.values()), columns=pdf.columns)

    return hits.groupBy("video_id").applyInPandas(run, schema)


def confidence(citations: DataFrame, terms: list[str]) -> DataFrame:
    """One row (diversity, relevance, coverage, overall) over citations (channel_name, distance, excerpt)."""
    terms = sorted({t.lower() for t in terms if len(t) > 2})
    met = [F.coalesce(F.max(F.contains(F.lower("excerpt"), F.lit(t)).cast("int")), F.lit(0)) for t in terms]
    coverage = sum(met, F.lit(0)) / F.lit(float(len(terms))) if terms else F.lit(0.0)
    n = F.count("*")
    out = citations.agg(
        F.coalesce(F.least(F.try_divide(F.count_distinct("channel_name").cast("double"), n), F.lit(1.0)), F.lit(0.0)).alias("diversity"),
        F.coalesce(F.least(F.greatest(1 - F.avg("distance"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("relevance"),
        coverage.alias("coverage"),
    )
    return out.withColumn("overall", 0.5 * F.col("diversity") + 0.3 * F.col("relevance") + 0.2 * F.col("coverage"))


def citations(hits: DataFrame, chunks: DataFrame, videos: DataFrame, channels: DataFrame, limit: int = 8) -> DataFrame:
    """The best hits (chunk_id, video_id, distance, position) as numbered citations with titles, links and excerpts."""
    best = hits.orderBy("distance", "position").limit(limit)
    full = best.join(chunks.select("chunk_id", "text", "start_timestamp"), "chunk_id").join(videos.select("video_id", "channel_id", "title"), "video_id", "left").join(channels.select("channel_id", F.col("name").alias("channel_name")), "channel_id", "left")
    numbered = full.withColumn("number", F.row_number().over(Window.orderBy("distance", "position")))
    start = F.coalesce("start_timestamp", F.lit(0.0))
    return numbered.select(F.concat(F.lit("source_"), F.col("number").cast("string")).alias("source_id"), "chunk_id", "video_id", F.coalesce("title", F.lit("Unknown")).alias("title"), F.coalesce("channel_name", F.lit("Unknown")).alias("channel_name"), minutes_seconds(start).alias("at"), deep_link(F.col("video_id"), start).alias("link"), F.substring("text", 1, 300).alias("excerpt"), "distance")


def hybrid(chunks: DataFrame, vectors: DataFrame, query: str, vector: list[float], where: Column | None = None, heat: DataFrame | None = None, topic_videos: DataFrame | None = None, top: int = 15) -> DataFrame:
    """(chunk_id, video_id, chunk_index, start, end, distance, position): both legs under one filter, fused, boosted, without neighbours."""
    kept = chunks if where is None else chunks.filter(where)
    v = nearest(vectors.join(kept.select("chunk_id"), "chunk_id", "left_semi"), vector, top)
    hits = fuse(ranked(v, F.col("distance"), F.col("chunk_id")), ranked(bm25(kept, query, top), F.col("score"), F.col("chunk_id")))
    facts = kept.select("chunk_id", "video_id", "chunk_index", F.col("start_timestamp").alias("start"), F.col("end_timestamp").alias("end"))
    hits = facts.join(F.broadcast(hits), "chunk_id").drop("rrf")  # at most 2 * top rows
    hits = stored(hits, "hits")  # few rows that took passes over all chunks and are read more than once
    if topic_videos is not None:
        hits = topic_boost(hits, topic_videos)
    hits = drop_neighbours(hits)
    return hits if heat is None else heat_boost(hits, heat)


def history(messages: DataFrame, limit: int = 6) -> DataFrame:
    """(session_id, context): the last messages of each session as 'role: content' lines in order."""
    w = Window.partitionBy("session_id").orderBy(F.col("message_id").desc())
    last = messages.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)
    return last.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_id", F.concat("role", F.lit(": "), "content").alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def merged_results(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """Keyword results, then semantic ones, one row for each video: (video_id, rank) both."""
    both = keyword.select("video_id", F.lit(0).alias("way"), "rank").unionByName(semantic.select("video_id", F.lit(1).alias("way"), "rank"))
    first = both.groupBy("video_id").agg(F.min(F.struct("way", "rank")).alias("best"))
    return first.select("video_id", "best.way", "best.rank").orderBy("way", "rank", "video_id")


def batches(texts: Iterator[str], size: int) -> Iterator[list[str]]:
    held: list[str] = []
    for text in texts:
        held.append(text)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
