"""Clusters of claims that different videos make alike, as a forest found by joins.

Claims in order of ids, those that have a cluster before all others, each look at their `neighbours` nearest claims of other
videos and take the cluster of the nearest that stands earlier, if it is alike enough; a claim without one opens
a cluster. Since each takes from one earlier claim, clusters are the trees of a forest:

* claims are written once; every distinct text gets a number, is embedded once and finds the texts within the cutoff
  through the cells of a vector index;
* of each text, and of what a text's neighbourhood holds, only claims that can be among the first `neighbours`
  of other videos for some video are kept: the first few of each of the first few videos, at most
  neighbours * (neighbours + 1), so no list grows with the number of claims alike;
* only claims kept can be taken from, so the forest is made of them alone: each picks its predecessor from its text's
  list, and roots are found by pointer doubling, in rounds that halve the depths;
* the lists name the clusters of what they hold, so every claim finds its own in one join with the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.cut import stored
from lodestone.plans import vector_index


def _foremost(rows: DataFrame, key: list[str], order: list[str], count: int) -> DataFrame:
    """Of each key the first `count` rows in order of each of the first count + 1 videos: the first `count` of all but any one video are among them."""
    each = Window.partitionBy(*key, "video").orderBy(*order)
    rows = rows.withColumn("__n", F.row_number().over(each)).filter(F.col("__n") <= count)
    first = rows.filter("__n = 1")
    videos = first.withColumn("__m", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("__m") <= count + 1).select(*key, "video")
    return rows.drop("__n").join(videos, [*key, "video"], "left_semi")


def _first(rows: DataFrame, key: str, order: list[str], count: int, name: str) -> DataFrame:
    """Rows among which are, for each key, the first `count` in order of all but any one video: at most count * (count + 1) of a key.

    Where the first count * (count + 1) rows of a key are of more than `count` videos, no later row is needed, so that tasks cut their rows before they
    are shuffled. Keys whose first rows are of fewer videos, and that have more rows, go the long way.
    """
    most = count * (count + 1)
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__n") <= most + 1)
    ranked = stored(ranked, name)
    crowded = ranked.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("__n") <= most, F.col("video"))).alias("videos"))
    crowded = stored(crowded.filter((F.col("n") > most) & (F.col("videos") <= count)).select(key), f"{name}_crowded")
    found = ranked.filter(F.col("__n") <= most).drop("__n")
    if crowded.isEmpty():
        return found
    rest = _foremost(rows.join(crowded, key, "left_semi"), [key], order, count)
    return found.join(crowded, key, "left_anti").unionByName(stored(rest, f"{name}_rest"))


def _earlier(neighbours: int) -> Column:
    """Of a claim's list `near`, those of the first `neighbours` of other videos from which the claim may take its cluster."""
    others = F.slice(F.filter("near", lambda x: x["video"] != F.col("video")), 1, neighbours)
    return F.filter(others, lambda x: ~x["late"] | (x["claim_id"] < F.col("claim_id")))


def _clustered(claims: DataFrame, embed: Callable[[list[str]], list[list[float]]], cutoff: float, neighbours: int, cells: int, by: str | None) -> DataFrame:
    """(claim_id, video_id, cluster_id) of every claim (claim_id, video_id, claim_text[, cluster_id])."""
    known = F.col("cluster_id") if "cluster_id" in claims.columns else F.lit(None)
    part = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    rows = stored(claims.select("claim_id", "video_id", F.coalesce("claim_text", F.lit("")).alias("text"), part.alias("part"), known.cast("string").alias("known")), "claims")
    # a place is a text in a part; a text is known by the least of its places
    places = stored(rows.select("text", "part").distinct().withColumn("place", F.monotonically_increasing_id()), "claim_places")
    texts = places.groupBy("text").agg(F.min("place").alias("key"))
    vectors = stored(vector_index.embedded(texts, "text", embed).select("key", "text", "vector"), "claim_texts")
    places = stored(places.join(vectors.select("key", "text"), "text"), "claim_places")
    index = vector_index.build(vectors.drop("text"), "key", "vector", cells=cells)
    # rounded, so that copies tie and ids decide
    pairs = vector_index.within(index, vectors.select(F.col("key").alias("query_id"), "vector"), 1 - cutoff).select("query_id", F.col("id").alias("key"), F.greatest(F.round("distance", 12), F.lit(0.0)).alias("distance"))
    said = rows.join(places, ["text", "part"]).select("place", F.coalesce("video_id", F.lit("")).alias("video"), "known", "claim_id")
    few = _first(said, "place", ["claim_id"], neighbours, "claims_of_texts")
    held = few.join(places.select("place", "key", "part"), "place").select("key", "part", "video", F.col("known").isNull().alias("late"), "claim_id")
    asked = places.select(F.col("key").alias("query_id"), "part", "place")
    near = stored(_first(pairs.join(asked, "query_id").join(held, ["key", "part"]).select("place", "video", "distance", "late", "claim_id"), "place", ["distance", "claim_id"], neighbours, "near_texts"), "near_texts")

    def lists(rows: DataFrame, *more: str) -> DataFrame:
        return rows.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("distance", "claim_id", "late", "video", *more))).alias("near"))

    links = few.join(lists(near), "place", "left").select("claim_id", F.when(F.col("known").isNull(), F.get(_earlier(neighbours), F.lit(0))["claim_id"]).alias("parent"))
    named = few.filter("known IS NOT NULL").select(F.col("claim_id").alias("root"), "known")
    heads = roots(links).join(named, "root", "left").select("claim_id", F.coalesce("known", _own("root")).alias("cluster"))
    shown = stored(places.join(lists(near.join(heads, "claim_id"), "cluster"), "place", "left").select("text", "part", "near"), "near_lists")
    found = rows.join(shown, ["text", "part"]).withColumn("video", F.coalesce("video_id", F.lit("")))
    # mostly the first of the list will do, without a walk through it
    head = F.get("near", F.lit(0))
    quick = (head["video"] != F.col("video")) & (~head["late"] | (head["claim_id"] < F.col("claim_id")))
    cluster = F.when(F.col("known").isNotNull(), F.col("known")).when(quick, head["cluster"]).otherwise(F.coalesce(F.get(_earlier(neighbours), F.lit(0))["cluster"], _own("claim_id")))
    return found.select("claim_id", "video_id", cluster.alias("cluster_id"))


def _own(claim: str) -> Column:
    return F.concat(F.lit("c"), F.col(claim).cast("string"))


def roots(links: DataFrame) -> DataFrame:
    """(claim_id, root): the end of each chain of links (claim_id, parent); parents' chains double in length each round."""
    up = stored(links.select("claim_id", "parent"), "links")
    inner = up.filter("parent IS NOT NULL").join(up.select(F.col("parent").alias("claim_id")).distinct(), "claim_id", "left_semi")
    inner = stored(inner, "inner_links")
    while True:
        above = inner.select(F.col("claim_id").alias("parent"), F.col("parent").alias("further"))
        inner = stored(inner.join(above, "parent", "left").select("claim_id", F.coalesce("further", "parent").alias("parent"), F.col("further").isNotNull().alias("moved")), "inner_links")
        if inner.filter("moved").isEmpty():
            break
        inner = inner.drop("moved")
    top = inner.select(F.col("claim_id").alias("parent"), F.col("parent").alias("further"))
    return up.join(top, "parent", "left").select("claim_id", F.coalesce("further", "parent", "claim_id").alias("root"))


def clusters(claims: DataFrame, embed: Callable[[list[str]], list[list[float]]], cutoff: float = 0.85, neighbours: int = 5, cells: int = 64, by: str | None = None) -> DataFrame:
    """(claim_id, cluster_id) of every claim; a new cluster is named after its first claim.

    by: a column (such as topic) whose values are clustered apart from one another.
    """
    return _clustered(claims, embed, cutoff, neighbours, cells, by).select("claim_id", "cluster_id")


def _counted(marked: DataFrame, videos: DataFrame) -> DataFrame:
    """marked (cluster_id, video_id, ...) with corroboration_count, the number of distinct channels of a claim's cluster."""
    counts = marked.select("cluster_id", "video_id").join(videos.select("video_id", "channel_id"), "video_id").groupBy("cluster_id").agg(F.count_distinct("channel_id").cast("int").alias("corroboration_count"))
    return marked.join(stored(counts, "channels_of_clusters"), "cluster_id", "left").fillna(0, ["corroboration_count"])


def corroborated(claims: DataFrame, found: DataFrame, videos: DataFrame) -> DataFrame:
    """claims with the clusters found and corroboration_count, the number of distinct channels of a claim's cluster."""
    return _counted(claims.drop("cluster_id", "corroboration_count").join(found, "claim_id", "left"), videos)


def corroboration(claims: DataFrame, embed: Callable[[list[str]], list[list[float]]], videos: DataFrame, cutoff: float = 0.85, neighbours: int = 5, cells: int = 64) -> DataFrame:
    """(claim_id, video_id, cluster_id, corroboration_count): corroborated over clusters, without a join by claims."""
    return _counted(stored(_clustered(claims, embed, cutoff, neighbours, cells, None), "clusters"), videos).select("claim_id", "video_id", "cluster_id", "corroboration_count")


def sequential(claims: list[tuple[int, str | None, str | None, str | None]], embed, cutoff: float = 0.85, neighbours: int = 5) -> dict[int, str]:
    """The same, claim by claim (claim_id, video_id, text, cluster_id): what the joins must equal."""
    import math

    vector = {t or "": embed([t or ""])[0] for _, _, t, _ in claims}

    def distance(a: str, b: str) -> float:
        x, y = vector[a], vector[b]
        norm = math.sqrt(sum(c * c for c in x)) * math.sqrt(sum(c * c for c in y))
        return max(0.0, round(1 - sum(c * d for c, d in zip(x, y)) / norm, 12)) if norm else 1.0

    cluster = {i: c for i, _, _, c in claims if c}
    for i, video, text, known in sorted(claims, key=lambda c: (c[3] is None, c[0])):
        if known:
            continue
        others = sorted((distance(text or "", t or ""), j) for j, v, t, _ in claims if (v or "") != (video or ""))[:neighbours]
        cluster[i] = next((cluster[j] for d, j in others if d <= 1 - cutoff + 1e-12 and j in cluster), f"c{i}")
    return cluster

