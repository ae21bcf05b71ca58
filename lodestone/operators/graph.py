"""Property-graph operators over tables of vertices, edges and memberships.

Pair operators aggregate to one row for each (entity, topic) before they join on the topic, so a
join's output is bounded by pairs of entities, not by pairs of mentions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.cut import stored
from lodestone.operators.aggregates import chunk_topics
from lodestone.vault import Vault


def channel_topics(vault: Vault) -> DataFrame:
    """(channel_id, name, n): videos of a channel that discuss a topic."""
    videos = chunk_topics(vault).select("video_id", "name").distinct()
    return videos.join(vault.videos.select("video_id", "channel_id"), "video_id").groupBy("channel_id", "name").agg(F.count("*").alias("n"))


def cross_channel_topics(vault: Vault, limit: int | None = 20) -> DataFrame:
    """(name, channel_a, channel_b, strength): pairs of channels on one topic, both orders."""
    a = channel_topics(vault)
    b = a.select("name", F.col("channel_id").alias("channel_b"), F.col("n").alias("m"))
    out = a.withColumnRenamed("channel_id", "channel_a").join(b, "name").filter("channel_a <> channel_b").select("name", "channel_a", "channel_b", (F.col("n") * F.col("m")).alias("strength"))
    out = out.orderBy(F.col("strength").desc(), "name", "channel_a", "channel_b")
    return out if limit is None else out.limit(limit)


def echo_chambers(vault: Vault, least: int = 3, limit: int | None = 5) -> DataFrame:
    """(channel_a, channel_b, shared): pairs of channels with at least `least` topics in common."""
    a = channel_topics(vault).select("channel_id", "name")
    b = a.select("name", F.col("channel_id").alias("channel_b"))
    out = a.withColumnRenamed("channel_id", "channel_a").join(b, "name").filter("channel_a < channel_b").groupBy("channel_a", "channel_b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
    out = out.orderBy(F.col("shared").desc(), "channel_a", "channel_b")
    return out if limit is None else out.limit(limit)


def guest_topics(vault: Vault, lists: DataFrame | None = None) -> DataFrame:
    """(guest_id, name, videos): topics of the videos in which a guest appears. lists: of aggregates.topic_lists(), where they are known."""
    seen = vault.guest_appearances.select("guest_id", "video_id").distinct()
    if lists is None:
        topics = seen.join(chunk_topics(vault).select("video_id", "name").distinct(), "video_id")
    else:
        topics = seen.join(lists.select("video_id", F.col("topics.name").alias("names")), "video_id").select("guest_id", F.explode("names").alias("name"))
    return topics.groupBy("guest_id", "name").agg(F.count("*").alias("videos"))


def guest_network(vault: Vault) -> DataFrame:
    """(guest_a, guest_b, topics, shared, same): guests with topics in common, by classes of guests that have the same topics.

    same: guest_b is a member of the class of guest_a, the least of its guests (a row for every guest with a topic, itself included; any two
    members share all its topics). Not same: guest_a and guest_b are the least guests of two classes that share topics, which holds for all
    their members alike. So every pair of guests follows from the rows, and copies are not multiplied out.
    """
    seen = vault.guest_appearances.select("guest_id", "video_id").distinct()
    topics = chunk_topics(vault).select("video_id", "name").filter("name IS NOT NULL").distinct()
    lists = seen.join(topics, "video_id").select("guest_id", "name").distinct().groupBy("guest_id").agg(F.sort_array(F.collect_list("name")).alias("names"))
    lists = stored(lists, "guest_topics")
    classes = lists.groupBy("names").agg(F.min("guest_id").alias("guest_a"))
    shown = lambda names: (F.array_join(names, ",").alias("topics"), F.size(names).cast("long").alias("shared"))
    members = lists.join(classes, "names").select("guest_a", F.col("guest_id").alias("guest_b"), *shown("names"), F.lit(True).alias("same"))
    a = classes.select("guest_a", F.explode("names").alias("name"))
    b = a.select("name", F.col("guest_a").alias("guest_b"))
    links = a.join(b, "name").filter("guest_a < guest_b").groupBy("guest_a", "guest_b").agg(F.sort_array(F.collect_list("name")).alias("names"))
    return members.unionByName(links.select("guest_a", "guest_b", *shown("names"), F.lit(False).alias("same")))


#: Guests of a row at least and rows of a class at most, as far as ranges of ids are even; pairs that a task makes.
MEMBERS, RANGES, TASK_PAIRS = 1_000, 100, 5_000_000


def guest_pairs(vault: Vault) -> DataFrame:
    """(guest_a, guest_b, topics, shared): every pair of guests with topics in common, guest_a the lesser.

    A pair's topics are those of the classes of guest_network, found once for each pair of classes. Members of a class stand in rows by ranges of their ids;
    pairs of such rows are dealt evenly to tasks, which make the pairs of guests. So no pair is shuffled, and a large class is shared out.
    """
    found = stored(guest_network(vault), "guest_classes")
    members = found.filter("same AND guest_b IS NOT NULL").select(F.col("guest_a").alias("x"), F.col("guest_b").alias("guest"))
    ranges = max(1, min(RANGES, -(-members.count() // MEMBERS)))
    dealt = members.repartitionByRange(ranges, "guest").withColumn("p", F.spark_partition_id())
    rows = stored(dealt.groupBy("x", "p").agg(F.sort_array(F.collect_list("guest")).alias("a")), "guest_rows")
    both = found.filter("NOT same OR guest_a = guest_b").select(F.col("guest_a").alias("x"), F.col("guest_b").alias("y"), "topics", "shared")
    met = both.join(rows, "x").join(rows.toDF("y", "q", "b"), "y").filter("x <> y OR p <= q")
    met = stored(met.select("topics", "shared", F.expr("x = y AND p = q").alias("twice"), "a", "b"), "guest_rows")
    pairs = met.agg(F.sum(F.size("a").cast("long") * F.size("b"))).first()[0] or 0
    tasks = max(int(vault.spark.conf.get("spark.sql.shuffle.partitions")), min(-(-pairs // TASK_PAIRS), 4_000))
    one = met.repartition(tasks).select("topics", "shared", "twice", F.explode("a").alias("g"), "b")
    pair = one.select("topics", "shared", "twice", "g", F.explode("b").alias("h")).filter("NOT twice OR g < h")
    return pair.select(F.least("g", "h").alias("guest_a"), F.greatest("g", "h").alias("guest_b"), "topics", "shared")


def topic_cooccurrence(vault: Vault) -> DataFrame:
    """(topic_a, topic_b, n): pairs of topics by the number of videos that discuss both. Pairs are made inside each set of topics, once for all videos that have it."""
    topics = chunk_topics(vault).select("video_id", "name").distinct()
    return _pairs(topics.groupBy("video_id").agg(F.array_sort(F.collect_list("name")).alias("t")))


def _pairs(sets: DataFrame) -> DataFrame:
    """topic_cooccurrence of videos' sorted sets of topics, t."""
    lists = sets.groupBy("t").agg(F.count("*").alias("m"))
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda b: F.struct(a.alias("topic_a"), b.alias("topic_b")))))
    return lists.select("m", F.inline(pairs)).groupBy("topic_a", "topic_b").agg(F.sum("m").alias("n"))


def topic_sets(vault: Vault, weights: bool = True) -> DataFrame:
    """(video_id, topics): a video's topics as an array of (name, w), w the greatest relevance, or of (name) without weights; by name, written once. Rows meet by video in one shuffle."""
    n = 4 * max(1, int(vault.spark.conf.get("spark.sql.shuffle.partitions")))
    said = chunk_topics(vault).select("video_id", "name", *(["relevance"] if weights else [])).repartition(n, "video_id")
    if weights:
        sets = said.groupBy("video_id", "name").agg(F.max("relevance").alias("w")).groupBy("video_id").agg(F.collect_list(F.struct("name", "w")).alias("topics"))
    else:
        sets = said.groupBy("video_id").agg(F.collect_set(F.struct("name")).alias("topics"))  # a set of names alone would lack null
    return stored(sets.select("video_id", F.array_sort("topics").alias("topics")), "topic_sets")


def _named(sets: DataFrame) -> DataFrame:
    return sets.select(F.filter("topics.name", lambda x: x.isNotNull()).alias("t"))


def central_authorities(vault: Vault, limit: int | None = 10) -> DataFrame:
    """(channel_id, topics): channels by the number of their topics, none included."""
    counts = channel_topics(vault).groupBy("channel_id").agg(F.count("*").alias("topics"))
    out = vault.channels.select("channel_id").join(counts, "channel_id", "left").fillna(0, ["topics"]).orderBy(F.col("topics").desc(), "channel_id")
    return out if limit is None else out.limit(limit)


def topic_authorities(vault: Vault, topic: str, limit: int = 5) -> DataFrame:
    """(kind, id, n): the channels and the guests with most videos on topics that contain the text."""
    hit = F.contains(F.lower("name"), F.lower(F.lit(topic)))
    channels = channel_topics(vault).filter(hit).groupBy("channel_id").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "channel_id").limit(limit)
    guests = guest_topics(vault).filter(hit).groupBy("guest_id").agg(F.sum("videos").alias("n")).orderBy(F.col("n").desc(), "guest_id").limit(limit)
    return channels.select(F.lit("Channel").alias("kind"), F.col("channel_id").alias("id"), "n").unionByName(guests.select(F.lit("Guest").alias("kind"), F.col("guest_id").cast("string").alias("id"), "n"))


def guest_evolution(vault: Vault, guest_id: int) -> DataFrame:
    seen = vault.guest_appearances.filter(F.col("guest_id") == guest_id).select("video_id").distinct()
    return seen.join(vault.videos.select("video_id", "upload_date"), "video_id").join(chunk_topics(vault).select("video_id", "name").distinct(), "video_id").orderBy("upload_date", "video_id", "name")


def guest_appearance_list(vault: Vault, guest_id: int) -> DataFrame:
    seen = vault.guest_appearances.filter(F.col("guest_id") == guest_id).select("video_id").distinct()
    return seen.join(vault.videos.select("video_id", "title", "channel_id", "upload_date"), "video_id").join(vault.channels.select("channel_id", F.col("name").alias("channel_name")), "channel_id", "left").orderBy(F.col("upload_date").desc(), "video_id")


def shared_videos(vault: Vault, video_id: str, limit: int = 10) -> DataFrame:
    """(video_id, shared, labels): other videos that share topics or guests with one video."""
    topics = chunk_topics(vault).select("video_id", F.concat(F.lit("topic:"), "name").alias("label"))
    guests = vault.guest_appearances.select("video_id", F.concat(F.lit("guest:"), F.col("guest_id").cast("string")).alias("label"))
    labels = topics.union(guests).distinct()
    own = labels.filter(F.col("video_id") == video_id).select("label")
    return labels.filter(F.col("video_id") != video_id).join(own, "label").groupBy("video_id").agg(F.count("*").alias("shared"), F.array_sort(F.collect_set("label")).alias("labels")).orderBy(F.col("shared").desc(), "video_id").limit(limit)


def edges_of(vault: Vault) -> DataFrame:
    """The vault's edges from its tables: published, appeared in, discusses, related to. Topics are grouped by video once and written."""
    topic = lambda c: F.concat(F.lit("topic:"), c)
    video = lambda c: F.concat(F.lit("video:"), c)
    sets = topic_sets(vault)
    published = vault.videos.select(F.concat(F.lit("channel:"), "channel_id").alias("src"), video(F.col("video_id")).alias("dst"), F.lit("PUBLISHED").alias("type"), F.lit(1.0).alias("weight"))
    seen = vault.guest_appearances.select("guest_id", "video_id").distinct()
    appeared = seen.select(F.concat(F.lit("guest:"), F.col("guest_id").cast("string")), video(F.col("video_id")), F.lit("APPEARED_IN"), F.lit(1.0))
    discusses = sets.select("video_id", F.inline("topics")).select(video(F.col("video_id")), topic(F.col("name")), F.lit("DISCUSSES"), F.col("w"))
    related = stored(_pairs(_named(sets)), "related").select(topic(F.col("topic_a")), topic(F.col("topic_b")), F.lit("RELATED_TO"), F.col("n").cast("double"))
    return published.union(appeared).union(discusses).union(related)


def links_of(vault: Vault) -> DataFrame:
    """(src, dst) of the edges of edges_of, without their weights; a link may come more than once, which spares the shuffles that count it once."""
    topic = lambda c: F.concat(F.lit("topic:"), c)
    video = lambda c: F.concat(F.lit("video:"), c)
    published = vault.videos.select(F.concat(F.lit("channel:"), "channel_id").alias("src"), video(F.col("video_id")).alias("dst"))
    appeared = vault.guest_appearances.select(F.concat(F.lit("guest:"), F.col("guest_id").cast("string")), video(F.col("video_id")))
    discusses = chunk_topics(vault).select(video(F.col("video_id")), topic(F.col("name")))
    related = topic_cooccurrence(vault).select(topic(F.col("topic_a")), topic(F.col("topic_b")))
    return published.union(appeared).union(discusses).union(related)


def graph_stats(edges: DataFrame) -> DataFrame:
    """(label, n): vertices by label and edges by type."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return ends.groupBy(F.split_part("id", F.lit(":"), F.lit(1)).alias("label")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n")))


def vault_stats(vault: Vault) -> DataFrame:
    """graph_stats() of edges_of(), counted in the tables: no edge is built, and a table's nodes are told apart before they meet those of others."""
    sets = topic_sets(vault, False)
    seen, videos = vault.guest_appearances, vault.videos

    def nodes(df: DataFrame, label: str, column: str) -> DataFrame:
        return df.select(F.col(column).cast("string").alias("key")).distinct().select(F.when(F.col("key").isNotNull(), label).alias("label"), "key")

    names = sets.select(F.explode("topics.name").alias("name"))
    found = nodes(videos, "channel", "channel_id").union(nodes(seen, "guest", "guest_id")).union(nodes(names, "topic", "name"))
    for df in (videos, seen, sets):
        found = found.union(nodes(df, "video", "video_id"))
    out = found.distinct().groupBy("label").agg(F.count("*").alias("n"))
    edges = {
        "PUBLISHED": videos.agg(F.count("*").alias("n")),
        "APPEARED_IN": seen.select("guest_id", "video_id").distinct().agg(F.count("*").alias("n")),
        "DISCUSSES": sets.agg(F.coalesce(F.sum(F.size("topics").cast("long")), F.lit(0)).alias("n")),
        "RELATED_TO": _pairs(_named(sets)).agg(F.count("*").alias("n")),
    }
    for label, count in edges.items():
        out = out.unionByName(count.filter("n > 0").select(F.lit(label).alias("label"), "n"))
    return out


def videos_of(vault: Vault) -> DataFrame:
    """(video_id) of the video nodes of edges_of, from the tables that link videos to something."""
    found = vault.videos.select("video_id").distinct()
    for df in (vault.guest_appearances, chunk_topics(vault)):
        found = found.union(df.select("video_id").distinct())
    return found.distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).groupBy("id").agg(F.count("*").alias("degree"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def neighbourhood(edges: DataFrame, node: str, limit: int | None = 50) -> DataFrame:
    """(dst, type, weight) of a node's edges either way, the strongest `limit` or, without one, all in no order."""
    near = undirected(edges).filter(F.col("src") == node).select("dst", "type", "weight").distinct()
    return near if limit is None else near.orderBy(F.col("weight").desc(), "dst", "type").limit(limit)


def contradictions(edges: DataFrame) -> DataFrame:
    """RELATED_TO edges marked as contradictions, seen from both ends, strongest first."""
    return undirected(edges.filter((F.col("type") == "RELATED_TO") & (F.col("relationship") == "CONTRADICTION"))).orderBy(F.col("weight").desc(), "src", "dst")


def taxonomy_context(edges: DataFrame, topic: str) -> DataFrame:
    """One row: the parents and the children of a topic along SUBTOPIC_OF."""
    sub = edges.filter(F.col("type") == "SUBTOPIC_OF")
    return sub.agg(F.array_sort(F.collect_set(F.when(F.col("src") == topic, F.col("dst")))).alias("parents"), F.array_sort(F.collect_set(F.when(F.col("dst") == topic, F.col("src")))).alias("children"))


def distances(edges: DataFrame, start: str, depth: int = 3, until: str | None = None) -> DataFrame:
    """(id, distance, before) of nodes within `depth` undirected steps of one node: a frontier that only meets new nodes.

    until: no step follows the one that reaches this node. Edges are written once, in one direction, and read both ways; each frontier is written too,
    so a step's plan doesn't hold those before it.
    """
    links = stored(edges.select("src", "dst"), "links")
    spark = edges.sparkSession
    found = spark.createDataFrame([(start, 0, None)], "id string, distance int, before string")
    frontier = found
    for step in range(1, depth + 1):
        if until is not None and not frontier.filter(F.col("id") == until).isEmpty():
            break
        ends = [links.join(frontier.select(F.col("id").alias(a)), a).select(F.col(b).alias("id"), F.col(a).alias("before")) for a, b in (("src", "dst"), ("dst", "src"))]
        near = ends[0].unionByName(ends[1]).groupBy("id").agg(F.min("before").alias("before"))
        frontier = stored(near.join(found.select("id"), "id", "left_anti").select("id", F.lit(step).alias("distance"), "before"), "frontier")
        found = found.unionByName(frontier)
    return found


def shortest_path(edges: DataFrame, start: str, end: str, depth: int = 3) -> DataFrame:
    """One row (path, length) of a shortest undirected path, the least by names of the nodes before, or none."""
    found = distances(edges, start, depth, end)
    path = found.filter(F.col("id") == end).select(F.array("id").alias("path"), F.col("before").alias("at"), F.col("distance").alias("length"))
    for _ in range(depth):
        back = found.select(F.col("id").alias("at"), F.col("before").alias("next"))
        path = path.join(back, "at", "left").select(F.when(F.col("at").isNotNull(), F.concat(F.array("at"), "path")).otherwise(F.col("path")).alias("path"), F.col("next").alias("at"), "length")
    return path.select("path", "length")


def merge_vertices(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends renamed by mapping (id, survivor); parallel edges add up, loops that arise go."""
    for end in ("src", "dst"):
        m = mapping.select(F.col("id").alias(end), F.col("survivor").alias("__to"))
        edges = edges.join(m, end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
    return edges.filter("src <> dst").groupBy("src", "dst", "type").agg(F.sum("weight").alias("weight"))
