"""A taxonomy of topics: batches for a model, edges that close no cycle, ancestors and descendants.

An edge (child, parent) says that child is a subtopic of parent; its type among the graph's edges is SUBTOPIC_OF.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.cut import stored
from lodestone.functions.text import fenced
from lodestone.ship import ship

#: Topics of a prompt, and how few topics make no taxonomy.
BATCH, LEAST = 50, 5


def numbered(names: DataFrame, column: str = "name") -> DataFrame:
    """(name, number): distinct names with their places from 0 in order.

    Names are dealt out by ranges and numbered within them; the driver holds a count for each range.
    """
    spark = names.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = names.select(F.col(column).alias("name")).filter("name IS NOT NULL").distinct().repartitionByRange(n, "name")
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()), "names")
    counts = sorted((r.part, r["count"]) for r in dealt.groupBy("part").count().collect())
    starts, total = {}, 0
    for part, count in counts:
        starts[part], total = total, total + count
    if not starts:
        return dealt.select("name", F.lit(0).cast("long").alias("number"))
    start = F.create_map(*[F.lit(x) for p, s in starts.items() for x in (p, s)])[F.col("part")]
    place = F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1
    return dealt.select("name", (start + place).cast("long").alias("number"))


def batches(topics: DataFrame, size: int = BATCH) -> DataFrame:
    """(batch, names): topics (name) in order, `size` to a batch."""
    return numbered(topics).groupBy(F.floor(F.col("number") / size).alias("batch")).agg(F.array_sort(F.collect_list("name")).alias("names"))


def proposed(topics: DataFrame, model: Callable[[list[str]], str], size: int = BATCH) -> DataFrame:
    """(batch, child, parent): what a model replies to each batch of topics, as JSON [{"child": .., "parent": ..}], perhaps in a code fence.

    Lower case, trimmed. A call that fails, or a reply that is no such list, gives a row of nulls for its batch instead.
    """
    ship(topics.sparkSession)

    @F.pandas_udf("string")
    def asked(names: pd.Series) -> pd.Series:
        out = []
        for batch in names:
            try:
                out.append(model(list(batch)))
            except Exception:
                out.append(None)
        return pd.Series(out, dtype=object)

    reply = batches(topics, size).select("batch", fenced(asked("names")).alias("reply"))
    listed = F.from_json("reply", "array<struct<child:string,parent:string>>")
    pairs = reply.select("batch", F.explode_outer(F.when(F.startswith("reply", F.lit("[")), F.filter(listed, lambda x: x["child"].isNotNull() & x["parent"].isNotNull()))).alias("x"))
    return pairs.select("batch", F.lower(F.trim("x.child")).alias("child"), F.lower(F.trim("x.parent")).alias("parent"))


def reached(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node, depth): all nodes that lead from each start (start, node) by edges (src, dst), with the least number of steps.

    A round takes one step from what the last one added, so cycles end; most: rounds at most.
    """
    known = front = stored(starts.select("start", "node").distinct().withColumn("depth", F.lit(0)), "reached")
    links = edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).distinct()
    depth = 0
    while most is None or depth < most:
        depth += 1
        further = front.join(links, "node").select("start", F.col("to").alias("node")).distinct()
        front = stored(further.join(known, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def ancestors(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(topic, ancestor, depth) along edges (child, parent); depth from 1."""
    starts = edges.select(F.col("child").alias("start"), F.col("child").alias("node"))
    up = reached(starts, edges.select(F.col("child").alias("src"), F.col("parent").alias("dst")), most)
    return up.filter("depth > 0").select(F.col("start").alias("topic"), F.col("node").alias("ancestor"), "depth")


def descendants(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(topic, descendant, depth) along edges (child, parent) downwards; depth from 1."""
    turned = edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return ancestors(turned, most).withColumnRenamed("ancestor", "descendant")


def on_cycles(new: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of new (child, parent) that lie on a cycle of new and edges together: contradictory replies, all of them."""
    both = edges.select("child", "parent").unionByName(new.select("child", "parent"))
    starts = new.select(F.col("parent").alias("start"), F.col("parent").alias("node")).distinct()
    up = reached(starts, both.select(F.col("child").alias("src"), F.col("parent").alias("dst")))
    return new.join(up.select(F.col("start").alias("parent"), F.col("node").alias("child")).distinct(), ["parent", "child"], "left_semi").select("child", "parent")


def build(topics: DataFrame, edges: DataFrame, model: Callable[[list[str]], str], size: int = BATCH, least: int = LEAST) -> DataFrame:
    """edges (child, parent) with those that the model adds: between known topics, not of a topic with itself, none on a cycle, one of each.

    Fewer than `least` topics leave the edges as they are. Edges that were there stay.
    """
    names = topics.select("name").filter("name IS NOT NULL").distinct()
    edges = edges.select("child", "parent").distinct()
    if names.limit(least).count() < least:
        return edges
    found = stored(proposed(names, model, size), "proposed").select("child", "parent").filter("child <> parent AND child <> '' AND parent <> ''").distinct()
    for end in ("child", "parent"):
        found = found.join(names.withColumnRenamed("name", end), end, "left_semi")
    new = stored(found.select("child", "parent").join(edges, ["child", "parent"], "left_anti"), "new_edges")
    return edges.unionByName(new.join(on_cycles(new, edges), ["child", "parent"], "left_anti").select("child", "parent"))
