"""Guests and claims: noise, fuzzy duplicates, merges, claim clusters."""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.cut import stored
from lodestone.operators import corroboration, names as N
from lodestone.operators.names import similarity
from lodestone.ship import ship
from lodestone.vault import Vault

#: Names that are no guests, compared as they are written.
NOISE = [
    "NVIDIA", "Open AI", "US", "Nazi", "North Korea", "Taiwan", "Ukraine",
    "monkey", "myself", "you", "yourself", "the speaker", "speaker",
    "Unknown American", "Unknown Japanese", "No person mentioned", "None",
    "a minister", "the president", "human populations", "infant", "mathematical logic",
]


def resolve(names: DataFrame, guests: DataFrame) -> DataFrame:
    """(name, guest_id, canonical_name): names that aren't noise with their guest by name or alias, if known."""
    clean = names.select(F.trim("name").alias("name")).filter((F.col("name") != "") & ~F.col("name").isin(NOISE)).distinct()
    known = guests.select("guest_id", "canonical_name", F.col("canonical_name").alias("name"), F.lit(0).alias("way"))
    alias = guests.select("guest_id", "canonical_name", F.explode(F.coalesce("aliases", F.array().cast("array<string>"))).alias("name"), F.lit(1).alias("way"))
    best = known.unionByName(alias).groupBy("name").agg(F.min(F.struct("way", "guest_id", "canonical_name")).alias("best"))
    return clean.join(best, "name", "left").select("name", "best.guest_id", "best.canonical_name")


def purge_noise(vault: Vault) -> Vault:
    """Without guests of noise names or of under two characters, nor their appearances."""
    bad = vault.guests.filter(F.trim("canonical_name").isin(NOISE) | (F.length(F.trim("canonical_name")) < 2)).select("guest_id")
    return vault.delete("guests", bad).delete("guest_appearances", bad)


def _occurrences(name: str) -> list[str]:
    """Pairs of neighbouring characters, each with how often it stood before."""
    seen: dict[str, int] = {}
    out = []
    for gram in map(str.__add__, name, name[1:]):
        seen[gram] = seen.get(gram, 0) + 1
        out.append(f"{gram}{seen[gram]}")
    return out


def fuzzy_pairs(guests: DataFrame, cutoff: float = 0.85) -> DataFrame:
    """(guest_id, other_id, ratio): guests with names alike, the more mentioned first; 'Last, First' counts as 'First Last'.

    No pair is lost: names whose lengths add up to s and that have a ratio of at least c share M >= c * s / 2 characters
    in at most s - 2M + 1 blocks, hence at least (1.5c - 1) * s - 1 pairs of neighbouring letters (bigrams, counted as
    often as they occur). So they share one of the first of either's bigrams, rarest first; pairs are made by joins on
    those, names too short for the bound meet one another by an empty key, and only pairs that keep the bounds are compared.
    """
    ship(guests.sparkSession)
    flipped = F.regexp_replace("canonical_name", r"^([^,]+),\s*(.+)$", "$2 $1")
    names = guests.select("guest_id", "mention_count", F.lower(F.trim(flipped)).alias("n")).filter("n is not null").withColumn("l", F.length("n"))

    @F.pandas_udf("array<string>")
    def grams(names: pd.Series) -> pd.Series:
        return names.map(_occurrences)

    named = names.withColumn("grams", grams("n"))
    slope = 1.5 * cutoff - 1
    least = F.ceil(F.lit(slope * 2 / (2 - cutoff)) * F.col("l") - 1 - 1e-9)
    # up to this length a name has no bound, and its partners are at most (2 - c) / c times as long
    tiny = (2 - cutoff) / (2 * slope) if slope > 0 else float("inf")
    counts = named.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("count"))
    ranked = named.select("guest_id", "mention_count", "n", F.explode("grams").alias("gram")).join(counts, "gram").groupBy("guest_id", "mention_count", "n").agg(F.array_sort(F.collect_set(F.struct("count", "gram")))["gram"].alias("ranked"))
    empty = F.array().cast("array<string>")
    filed = named.join(ranked, ["guest_id", "mention_count", "n"], "left")
    first = F.when(least >= 1, F.slice(F.coalesce("ranked", empty), 1, F.greatest(F.col("l") - least, F.lit(0)).cast("int"))).otherwise(empty)
    short = F.when(F.col("l") <= F.lit(tiny * (2 - cutoff) / cutoff + 1e-6), F.array(F.lit(""))).otherwise(empty)
    filed = filed.select("guest_id", "mention_count", "n", "l", "grams", F.concat(short, first).alias("keys")).withColumn("k", F.explode("keys"))
    other = filed.select(*[F.col(c).alias(o) for c, o in (("guest_id", "other_id"), ("mention_count", "m2"), ("n", "n2"), ("l", "l2"), ("grams", "grams2"), ("keys", "keys2"), ("k", "k"))])
    before = (F.col("mention_count") > F.col("m2")) | ((F.col("mention_count") == F.col("m2")) & (F.col("guest_id") < F.col("other_id")))
    both = F.col("l") + F.col("l2")
    fits = 2 * F.least("l", "l2") >= cutoff * both - 1e-9
    shared = F.size(F.array_intersect("grams", "grams2")) >= slope * both - 1 - 1e-9
    once = F.array_intersect("keys", "keys2")[0] == F.col("k")
    pairs = filed.join(other, "k").filter(before & fits).filter(once).filter(shared).select("guest_id", "mention_count", "n", "other_id", "n2")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) for x, y in zip(a, b)])

    return pairs.withColumn("ratio", ratio("n", "n2")).filter(F.col("ratio") >= cutoff).select("guest_id", "mention_count", "other_id", "ratio")


#: Names of a block at least, and blocks at most: each block meets all others, so that names move as often as there are blocks.
BLOCK, BLOCKS = 1_000, 24


def components(links: DataFrame) -> DataFrame:
    """(id, root): ids on links (id, other) with the least id that they reach, by large and small stars until nothing changes."""
    arcs = stored(links.filter("id <> other").select(F.greatest("id", "other").alias("id"), F.least("id", "other").alias("other")).distinct(), "arcs")
    while True:
        both = arcs.unionByName(arcs.select(F.col("other").alias("id"), F.col("id").alias("other")))
        low = both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("low"))
        large = stored(both.join(low, "id").filter("other > id").select(F.col("other").alias("id"), F.col("low").alias("other")).distinct(), "arcs")
        least = large.groupBy("id").agg(F.min("other").alias("low"))
        down = large.join(least, "id")
        small = down.filter("other <> low").select(F.col("other").alias("id"), F.col("low").alias("other")).unionByName(least.select("id", F.col("low").alias("other")))
        small = stored(small.distinct(), "arcs")
        changed = not small.exceptAll(arcs).isEmpty() or not arcs.exceptAll(small).isEmpty()
        arcs = small
        if not changed:
            return arcs.select("id", F.col("other").alias("root")).unionByName(arcs.select(F.col("other").alias("id"), F.col("other").alias("root")).distinct())


def fuzzy_links(guests: DataFrame, cutoff: float = 0.85) -> DataFrame:
    """(guest_id, class_id, links): of every guest with a name the least guest that it reaches over names alike, and how many others its name is alike to.

    The pairs are those of fuzzy_pairs, counted instead of listed; a name that several guests have is compared once, in the place of its first guest
    (the most mentioned, then by id), and all of them link to one another. Names are dealt to blocks by their order, BLOCKS at most, so that none moves more often
    than that; each pair of blocks is a group of its own, which `names.linked` compares. No link is lost. A group sends sums on, and for each name the least
    guest that it reaches there, never pairs. The time is quadratic in the distinct names; where many have their beginnings in common it is so in groups of them.
    """
    spark = ship(guests.sparkSession)
    flipped = F.regexp_replace("canonical_name", r"^([^,]+),\s*(.+)$", "$2 $1")
    clean = guests.select("guest_id", F.coalesce("mention_count", F.lit(0)).cast("long").alias("mentions"), F.lower(F.trim(flipped)).alias("n")).filter("n IS NOT NULL")
    named = stored(clean.groupBy("n").agg(F.min("guest_id").alias("id"), F.min(F.struct((-F.col("mentions")).alias("m"), F.col("guest_id").alias("g"))).alias("place"), F.count("*").alias("weight")), "names")
    blocks = max(1, min(BLOCKS, -(-named.count() // BLOCK)))
    dealt = named.repartitionByRange(blocks, "n").withColumn("own", F.spark_partition_id() % blocks)
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("n", "id", F.col("place.m").alias("m"), F.col("place.g").alias("g"), "weight", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    key = named.schema["id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["m", "g"], kind="stable").reset_index(drop=True)
        own, i, j = pdf["own"].to_numpy(), pdf["i"].iloc[0], pdf["j"].iloc[0]
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        sums, low = N.linked(pdf["n"].tolist(), left, right, pdf["weight"].to_numpy(), cutoff)
        out = pd.DataFrame({"id": pdf["id"], "other": pdf["id"].groupby(low).transform("min"), "links": sums.astype(np.int64)})
        return out[sums > 0]

    # few rows but much work: a stated number of partitions isn't merged by size
    dealt = dealt.repartition(2 * blocks * (blocks + 1), "i", "j")
    met = stored(dealt.groupBy("i", "j").applyInPandas(run, f"id {key}, other {key}, links long"), "name_links")
    found = stored(met.groupBy("id").agg(F.sum("links").alias("links"), F.collect_set("other").alias("others")).withColumn("lead", F.array_min("others")), "name_sums")
    # names of one lead are one class; what else they reach links leads, which are few where names reach far
    roots = components(found.select(F.explode("others").alias("id"), F.col("lead").alias("other"))).toDF("lead", "root")
    out = named.join(found.drop("others"), "id", "left").join(roots, "lead", "left")
    known = out.select("n", F.coalesce("root", "lead", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    return clean.join(known, "n").select("guest_id", "class_id", "links")


def merge_plan(guests: DataFrame, pairs: DataFrame, most: int = 4) -> DataFrame:
    """(id, survivor): what merging guests one by one in order (guest_id, mention_count; most mentioned first, then by id) leaves.

    In that order each guest that is still there takes in those still there among its `most` best partners
    (guest_id, other_id, ratio), either way round, ties by id. So a guest stays unless an earlier one that stays lists it, and goes to the
    first that does: the lexicographically first independent set. It is found in rounds: guests all of whose earlier listers are decided get
    decided, so there are as many rounds as the longest chain of undecided listers, and only links among undecided guests are kept.
    """
    order = guests.select("guest_id", F.struct(-F.coalesce("mention_count", F.lit(0)), F.col("guest_id")).alias("place"))
    both = pairs.select("guest_id", "other_id", "ratio").unionByName(pairs.select(F.col("other_id").alias("guest_id"), F.col("guest_id").alias("other_id"), "ratio")).filter("guest_id <> other_id")
    both = both.groupBy("guest_id", "other_id").agg(F.max("ratio").alias("ratio"))
    best = both.withColumn("__n", F.row_number().over(Window.partitionBy("guest_id").orderBy(F.desc("ratio"), "other_id"))).filter(F.col("__n") <= most)
    listed = best.join(order, "guest_id").join(order.select(F.col("guest_id").alias("other_id"), F.col("place").alias("other_place")), "other_id")
    links = stored(listed.filter("place < other_place").select("guest_id", "other_id", "place"), "merge_links")
    open_links, decided = links, None
    while not open_links.isEmpty():
        later = open_links.select(F.col("other_id").alias("guest_id")).distinct()
        # those that no undecided guest lists stay; whom they list goes
        stays = open_links.select("guest_id").distinct().join(later, "guest_id", "left_anti")
        goes = open_links.join(stays, "guest_id", "left_semi").select(F.col("other_id").alias("guest_id")).distinct()
        found = stored(stays.withColumn("stays", F.lit(True)).unionByName(goes.withColumn("stays", F.lit(False))), "merge_round")
        decided = found if decided is None else decided.unionByName(found)
        done = found.select("guest_id")
        open_links = stored(open_links.join(done, "guest_id", "left_anti").join(done.withColumnRenamed("guest_id", "other_id"), "other_id", "left_anti"), "merge_links")
    if decided is None:
        return links.select(F.col("other_id").alias("id"), F.col("guest_id").alias("survivor"))
    # a guest that goes is in nobody's way; what it listed may stay after all, so guests without a decision stay
    gone = decided.filter("NOT stays").select("guest_id").distinct()
    firm = links.join(gone, "guest_id", "left_anti").join(gone.withColumnRenamed("guest_id", "other_id"), "other_id", "left_semi")
    return firm.groupBy("other_id").agg(F.min_by("guest_id", "place").alias("survivor")).select(F.col("other_id").alias("id"), "survivor")


def sequential_plan(guests: list[tuple[int, int]], pairs: list[tuple[int, int, float]], most: int = 4) -> dict[int, int]:
    """The same, guest by guest (guest_id, mention_count): what merge_plan must equal."""
    ratio: dict[int, dict[int, float]] = {}
    for a, b, r in pairs:
        for x, y in ((a, b), (b, a)):
            if x != y:
                ratio.setdefault(x, {})[y] = max(r, ratio.get(x, {}).get(y, r))
    there, out = {g for g, _ in guests}, {}
    merged: set[int] = set()
    for guest, _ in sorted(guests, key=lambda g: (-g[1], g[0])):
        if guest in merged:
            continue
        there.discard(guest)
        for other in sorted(ratio.get(guest, {}), key=lambda o: (-ratio[guest][o], o))[:most]:
            if other in there and other not in merged:
                merged.add(other)
                out[other] = guest
    return out


def fuzzy_merge_plan(guests: DataFrame, cutoff: float = 0.85, most: int = 4) -> DataFrame:
    """merge_plan over guests whose names are alike."""
    return merge_plan(guests, fuzzy_pairs(guests, cutoff), most)


def merge_guests(vault: Vault, plan: DataFrame) -> Vault:
    """Appearances move to survivors (one of each), mentions add up, names and aliases of the merged become aliases."""
    guests = vault.guests.join(plan.select(F.col("id").alias("guest_id"), "survivor"), "guest_id", "left").withColumn("to", F.coalesce("survivor", "guest_id"))
    own = F.col("guest_id") == F.col("to")
    empty = F.array().cast("array<string>")
    merged = guests.groupBy("to").agg(
        *[F.max(F.when(own, F.col(c))).alias(c) for c in ("canonical_name", "entity_type")],
        F.sum("mention_count").alias("mention_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.coalesce("aliases", empty), F.when(~own, F.array("canonical_name")).otherwise(empty)))))).alias("aliases"),
        *[f(c).alias(c) for f, c in ((F.min, "first_seen"), (F.max, "last_seen")) if c in vault.guests.columns],
    )
    merged = merged.withColumnRenamed("to", "guest_id").select(*vault.guests.columns)
    seen = vault.guest_appearances.join(plan.select(F.col("id").alias("guest_id"), "survivor"), "guest_id", "left").withColumn("guest_id", F.coalesce("survivor", "guest_id")).drop("survivor")
    keys = [c for c in ("guest_id", "video_id", "start_timestamp") if c in seen.columns]
    return vault.having(guests=merged, guest_appearances=seen.select(*vault.guest_appearances.columns).dropDuplicates(keys))


def claim_clusters(claims: DataFrame, embed: Callable[[list[str]], list[list[float]]], cutoff: float = 0.85, neighbours: int = 5) -> DataFrame:
    """(claim_id, cluster_id): clusters of `corroboration`, each topic by itself."""
    return corroboration.clusters(claims.drop("cluster_id"), embed, cutoff, neighbours, by="topic")


#: Cells that a category's topics are dealt to by the first two hexadecimal digits of their names' MD5.
_CELL = 2


def drawn(total: int, count: int, seed: int) -> list[int]:
    """`count` different numbers below total (all, if fewer), each as likely: the first values of a hash of seed and turn."""
    import hashlib

    if total <= count:
        return list(range(total))
    found: dict[int, None] = {}
    turn = 0
    while len(found) < count:
        found.setdefault(int(hashlib.md5(f"{seed}:{turn}".encode()).hexdigest()[:15], 16) % total)
        turn += 1
    return list(found)


def bridge_pairs(topics: DataFrame, seed: int = 0, limit: int = 5) -> DataFrame:
    """(topic_a, category_a, topic_b, category_b): pairs of topics (category, name) of different categories, every such pair as likely.

    Pairs are numbered without being built. Topics stand in order of category, then of cell and name; those of category c make
    n_c * (topics of later categories) pairs with what follows. So from counts by category and cell (at most 256 a category; all that the driver holds) a
    number gives both places, and only the cells that hold drawn places are ranked. Four times `limit` pairs are drawn; pairs of one name, and
    pairs of names that came before, are passed over.
    """
    known = topics.filter(F.col("category").isNotNull() & (F.col("category") != "UNCLASSIFIED") & F.col("name").isNotNull()).select("category", "name").distinct()
    known = known.withColumn("cell", F.substring(F.md5(F.col("name").cast("binary")), 1, _CELL))
    counts = sorted((r.category, r.cell, r.n) for r in known.groupBy("category", "cell").agg(F.count("*").alias("n")).collect())
    sizes: dict[str, int] = {}
    for category, _, n in counts:
        sizes[category] = sizes.get(category, 0) + n
    names, left = list(sizes), sum(sizes.values())
    blocks = []  # (first number, first place, place after, topics after) of each category
    number = place = 0
    for c in names:
        left -= sizes[c]
        blocks.append((number, place, place + sizes[c], left))
        number, place = number + sizes[c] * left, place + sizes[c]
    starts, at = [], 0
    for category, cell, n in counts:
        starts.append((at, category, cell))
        at += n

    def spot(position: int) -> tuple[str, str, int]:
        first, category, cell = starts[bisect.bisect_right(starts, (position, chr(0x10FFFF))) - 1]
        return category, cell, position - first + 1

    rows = []
    for turn, value in enumerate(drawn(number, 4 * limit, seed)):
        first, begin, after, rest = next(b for b in reversed(blocks) if b[0] <= value and b[3])
        one, two = divmod(value - first, rest)
        rows += [(turn, side, *spot(p)) for side, p in (("a", begin + one), ("b", after + two))]
    spark = topics.sparkSession
    wanted = spark.createDataFrame(rows, "turn int, side string, category string, cell string, n int")
    picked = known.join(F.broadcast(wanted.select("category", "cell").distinct()), ["category", "cell"])  # at most 8 * limit cells
    ranked = picked.withColumn("n", F.row_number().over(Window.partitionBy("category", "cell").orderBy("name")))
    found = ranked.join(F.broadcast(wanted), ["category", "cell", "n"])
    one = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    pairs = found.groupBy("turn").agg(*[one(s, c).alias(f"{o}_{s}") for s in "ab" for c, o in (("name", "topic"), ("category", "category"))]).filter("topic_a <> topic_b")
    again = Window.partitionBy(F.least("topic_a", "topic_b"), F.greatest("topic_a", "topic_b")).orderBy("turn")
    return pairs.withColumn("__n", F.row_number().over(again)).filter("__n = 1").orderBy("turn").limit(limit).drop("turn", "__n")
