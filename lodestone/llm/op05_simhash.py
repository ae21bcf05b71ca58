"""SimHash near-dedup with pigeonring filtering.

Fingerprints of 64 bits come from word shingles. Equal fingerprints are one node from then on.
Two fingerprints that differ in at most `distance` bits have, on a ring of distance + 1
segments, a first segment from which every chain of l segments differs in at most
l * distance / segments bits. Chains of one segment (no difference) and two segments (at most
one) are found by equal keys: each fingerprint is filed under its own pair of segments and looks
up that pair and the pairs one bit away. Longer chains are checked on each candidate, and only
candidates that keep all budgets reach the full Hamming check.

Links leave a bucket as a spanning forest, never as all pairs of a group; a long run of equal
keys is searched breadth first, so that fingerprints already in a component are compared no more.
Keys with over `hot` fingerprints are split over several buckets.

Defined results: a text without words has fingerprint zero and links as any other; a text of
fewer words than a shingle is one shingle; repeated rows have equal fingerprints; a null id gets
a fingerprint and the component of its fingerprint's other rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import shared
from lodestone.llm.words import U, Words, mix, xxh64
from lodestone.ship import ship

SHINGLE, DISTANCE, HOT = 4, 4, 50_000
#: For similar texts: least similarity of their shingles; words a shingle and bits apart of candidates' SimHashes.
SIMILARITY, FEATURES, WIDE = 0.8, 2, 7
#: Partners that a text proposes for a key, and that are verified for it, in the first round of the prefix search; GROWTH
#: times as many in each next one.
PARTNERS, GROWTH = 2, 16


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    words = Words(texts, lower=True)
    n = np.diff(words.first)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    begin = np.cumsum(count) - count
    which = np.repeat(np.arange(len(texts)), count)
    start = words.first[which] + np.arange(int(count.sum())) - begin[which]
    end = np.minimum(start + shingle, words.first[which + 1]) - 1
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    hashes = xxh64(words.data, words.starts[start], words.ends[end])
    for bit in range(64):
        ones = np.add.reduceat(((hashes >> U(bit)) & U(1)).astype(np.int32), begin[some])
        out[some] |= (ones * 2 > count[some]).astype(np.uint64) << U(bit)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint long) of each row."""
    ship(docs.sparkSession)
    named = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for table in shared._sliced(batches, 2 << 20):
            found = fingerprints_of(table["text"].cast(pa.binary()).fill_null(b"").to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return named.mapInArrow(run, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, fingerprint long")


class Ring:
    """distance + 1 segments of 64 bits on a ring."""

    def __init__(self, distance: int):
        if not 1 <= distance <= 15:
            raise ValueError("a distance from 1 to 15 bits is asked for")
        self.distance, self.n = distance, distance + 1
        edges = [i * 64 // self.n for i in range(self.n + 1)]
        self.low = edges[:-1]
        self.width = [b - a for a, b in zip(edges, edges[1:])]
        self.masks = [U(((1 << w) - 1) << a) for a, w in zip(self.low, self.width)]
        self.budgets = [(length * distance) // self.n for length in range(1, self.n + 1)]

    def keys(self, prints: np.ndarray, i: int) -> np.ndarray:
        j = (i + 1) % self.n
        first = (prints >> U(self.low[i])) & U((1 << self.width[i]) - 1)
        second = (prints >> U(self.low[j])) & U((1 << self.width[j]) - 1)
        return (U(i) << U(58)) | (first << U(self.width[j])) | second

    def near(self, prints: np.ndarray, i: int) -> Iterator[np.ndarray]:
        """Keys within the budget of two segments: one differing bit in the second."""
        own = self.keys(prints, i)
        yield own
        if self.budgets[1] >= 1:
            for bit in range(self.width[(i + 1) % self.n]):
                yield own ^ U(1 << bit)

    def chained(self, xor: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Which differences keep the budget of every chain from segment i on."""
        parts = np.stack([np.bitwise_count(xor & m) for m in self.masks], 1).astype(np.int32)
        row, total, good = np.arange(len(xor)), np.zeros(len(xor), np.int32), np.ones(len(xor), bool)
        for length, budget in enumerate(self.budgets):
            total = total + parts[row, (i + length) % self.n]
            good &= total <= budget
        return good


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a-b: (member, least member)."""
    nodes, back = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = back[: len(a)], back[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _breadth(values: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join all fingerprints of a run which are near: each is compared with those not yet reached."""
    left = np.unique(values)
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = np.bitwise_count(left ^ at) <= distance
            if hit.any():
                reached, left = left[hit], left[~hit]
                a.append(np.full(len(reached), at))
                b.append(reached)
                queue.extend(reached)
    return a, b


def _links(ring: Ring, keys: np.ndarray, prints: np.ndarray, probe: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((probe, keys))
    keys, prints, probe = keys[order], prints[order], probe[order]
    cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
    filed = np.add.reduceat((~probe).astype(np.int64), cuts[:-1])
    asked = np.diff(cuts) - filed
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    small = np.flatnonzero((filed > 0) & (asked > 0) & (filed * asked <= 4096))
    step = max(1, 1_000_000 // 4096)
    sizes = np.cumsum(filed[small] * asked[small])
    at = 0
    while at < len(small):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + step * 4096)))
        runs = small[at:stop]
        rows = np.repeat(runs, filed[runs] * asked[runs])
        n = filed[runs] * asked[runs]
        k = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        left = prints[cuts[rows] + k % filed[rows]]
        right = prints[cuts[rows] + filed[rows] + k // filed[rows]]
        xor = left ^ right
        start = (keys[cuts[rows]] >> U(58)).astype(np.int64)
        some = np.flatnonzero(xor)
        some = some[ring.chained(xor[some], start[some])]
        good = some[np.bitwise_count(xor[some]) <= ring.distance]
        a.append(left[good])
        b.append(right[good])
        at = stop
    for run in np.flatnonzero((filed > 0) & (asked > 0) & (filed * asked > 4096)):
        x, y = _breadth(prints[cuts[run] : cuts[run + 1]], ring.distance)
        a += x
        b += y
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    u, v = np.concatenate(a), np.concatenate(b)
    if pairs:
        both = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v)), 1), axis=0)
        return both[:, 0], both[:, 1]
    return forest(u, v)


def near_links(prints: DataFrame, distance: int = DISTANCE, hot: int = HOT, pairs: bool = False) -> DataFrame:
    """(u, v) links whose components are those of fingerprints at most `distance` bits apart. prints: distinct fingerprints.

    With pairs, links are pairs at most `distance` apart: all of them, but for runs of many equal keys, which give a
    pair for each fingerprint that a breadth-first search reaches.
    """
    spark = ship(prints.sparkSession)
    ring = Ring(distance)
    buckets = 4 * shared.partitions(spark)

    # how many buckets a key with very many fingerprints needs; there are at most segments * rows / hot such keys
    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch[0].to_numpy(zero_copy_only=False).view(np.uint64)
            keys, counts = np.unique(np.concatenate([ring.keys(values, i) for i in range(ring.n)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])

    crowded = prints.select("fingerprint").mapInArrow(filed, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > hot)
    splits = {int(np.int64(r.key).view(np.uint64)): -(-r.n // hot) for r in crowded.toLocalIterator()}
    crowd = np.array(sorted(splits), np.uint64)
    shares = np.array([splits[int(k)] for k in crowd], np.int64)

    def spread(keys: np.ndarray, values: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket, key and fingerprint; in a split key, filed rows go to one share and probes to all."""
        bucket = mix(keys)
        if len(crowd):
            place = np.minimum(np.searchsorted(crowd, keys), len(crowd) - 1)
            share = np.where(crowd[place] == keys, shares[place], 1)
            if probe:
                rows = np.repeat(np.arange(len(keys)), share)
                offset = np.arange(len(rows)) - np.repeat(np.cumsum(share) - share, share)
                keys, values, bucket = keys[rows], values[rows], mix(keys[rows] + mix(offset.astype(np.uint64)))
            else:
                offset = (mix(values) % share.astype(np.uint64)).astype(np.uint64)
                bucket = mix(keys + mix(offset))
        return (bucket % U(buckets)).astype(np.int64), keys, values

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                values = whole[0].slice(at, 20_000).to_numpy(zero_copy_only=False).view(np.uint64)
                rows = [spread(ring.keys(values, i), values, False) for i in range(ring.n)]
                n = sum(len(r[0]) for r in rows)
                rows += [spread(k, values, True) for i in range(ring.n) for k in ring.near(values, i)]
                bucket, keys, prints_ = (np.concatenate(c) for c in zip(*rows))
                probe = np.arange(len(bucket)) >= n
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out = [(k, order[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                packed = [shared.join_parts(keys[r].tobytes(), prints_[r].tobytes(), np.packbits(probe[r]).tobytes()) for _, r in out]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array(packed, pa.binary())], ["bucket", "message"])

    def link(table: pa.Table) -> pa.Table:
        keys, values, probe = [], [], []
        for message in table["message"].to_pylist():
            k, p, q = shared.split_parts(message)
            keys.append(np.frombuffer(k, "<u8"))
            values.append(np.frombuffer(p, "<u8"))
            probe.append(np.unpackbits(np.frombuffer(q, np.uint8), count=len(keys[-1])).astype(bool))
        u, v = _links(ring, np.concatenate(keys), np.concatenate(values), np.concatenate(probe), pairs)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return prints.select("fingerprint").mapInArrow(emit, "bucket int, message binary").groupBy("bucket").applyInArrow(link, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the least node that links u-v reach, by large and small stars until nothing moves.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest chain.
    """
    edges = shared.written(links.filter("u <> v").distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("low"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(least.select("u", F.col("low").alias("v")))
        edges = shared.written(small.filter("u <> v").distinct(), "stars")
        new = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if new == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 hexadecimal digits, component_id) of each row."""
    found = shared.written(fingerprints(docs, shingle, id_column, text_column), "fingerprints")
    nodes = found.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    joined = components(near_links(nodes, distance))
    members = nodes.join(joined, nodes["fingerprint"] == joined["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    members = shared.written(members, "members")
    roots = members.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = members.join(roots, "root").select("fingerprint", "component_id")
    return found.join(classes, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles, A-Z in lower case; a shorter text is one shingle."""
    words = Words(texts, lower=True)
    values = words.hashes()
    out = []
    for a, b in zip(words.first.tolist(), words.first[1:].tolist()):
        n = min(shingle, b - a)
        hashed = np.zeros(b - a - n + 1 if n else 0, np.uint64)
        for k in range(n):
            hashed = mix(hashed * U(31) + values[a + k : a + k + len(hashed)] + U(1))
        out.append(np.unique(hashed))
    return out


def bounded(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df, to be broadcast if it has at most that many rows (of a few numbers each)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def prefix(values: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first of a set's sorted shingles, in one order for all sets: two sets at least that similar share one of them.

    Sets with Jaccard similarity t share t * n of the n shingles of either, so that the first n - ceil(t * n) + 1 of
    both cannot be disjoint. Common shingles come last, so that few sets meet by chance; empty sets share the key 0.
    """
    n = len(values)
    if not n:
        return np.zeros(1, np.uint64)
    if len(common):
        place = np.minimum(np.searchsorted(common, values), len(common) - 1)
        hit = common[place] == values
        values = np.concatenate((values[~hit], values[hit][np.argsort(rank[place[hit]])]))
    return values[: n - math.ceil(similarity * n - 1e-9) + 1]


def parity(values: np.ndarray) -> bytes:
    """512 bits: of two sets, those that differ are at most as many as the shingles that only one set has."""
    return np.packbits((np.bincount((values >> U(55)).astype(np.int64), minlength=512) & 1).astype(np.uint8)).tobytes()


def wide_parity(values: np.ndarray) -> np.ndarray:
    """As parity(), with as many bits as shingles or up to twice that, as numbers of 64 bits: long texts fill 512 bits."""
    bits = 64
    while bits < len(values):
        bits *= 2
    odd = np.bincount((values & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def differing(a: Column, b: Column) -> Column:
    """Bits that two wide_parity() differ in, the one of twice the other's length folded."""

    def folded(x: Column, other: Column) -> Column:
        half = F.greatest(F.lit(1), F.floor(F.size(x) / 2).cast("int"))
        return F.when(F.size(x) > F.size(other), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    return F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, x: n + x)


def prefix_pairs(keys: np.ndarray, nodes: np.ndarray, labels: np.ndarray, sizes: np.ndarray, bits: np.ndarray, similarity: float, partners: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of nodes with one key and two labels that sizes and parity bits (rows of 8 words) don't show to be less similar.

    A node gives at most that many for a key; the last value tells whether any has more.
    """
    order = np.lexsort((nodes, sizes, keys))
    keys, nodes, labels, sizes, bits = keys[order], nodes[order], labels[order], sizes[order], bits[order]
    later = np.searchsorted(keys, keys, side="right") - np.arange(len(keys)) - 1
    total = np.cumsum(later)
    odd = (1 - similarity) / (1 + similarity)
    a, b, at, more = [], [], 0, False
    while at < len(keys):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 500_000, side="right")))
        n = later[at:stop]
        x = np.repeat(np.arange(at, stop), n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        some = (labels[x] != labels[y]) & (sizes[x] >= similarity * sizes[y] - 1e-6)
        x, y = x[some], y[some]
        good = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= odd * (sizes[x] + sizes[y]) + 1e-6
        x, y = x[good], y[good]
        first = np.arange(len(x)) - np.searchsorted(x, x) < partners
        more = more or not first.all()
        a.append(nodes[x[first]])
        b.append(nodes[y[first]])
        at = stop
    u, v = np.concatenate(a), np.concatenate(b)
    both = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v)), 1), axis=0)
    return both[:, 0], both[:, 1], more


def shingled(docs: DataFrame, shingle: int, key: str = "doc_id", whole: bool = True) -> DataFrame:
    """(key, set, size, bits, wide) of each row: the hashes of its shingles (unless not whole), their number and parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  pa.compute is a module of its own

        for part in shared._sliced(batches, 1 << 20):
            sets = shingle_sets(part["text"].cast(pa.binary()).to_pylist(), shingle)
            columns = {key: part[key].combine_chunks()}
            if whole:
                columns["set"] = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
            columns |= {"size": pa.array([len(x) for x in sets], pa.int32()), "bits": pa.array([parity(x) for x in sets], pa.binary())}
            columns["wide"] = pa.array([wide_parity(x) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, {'set array<long>, ' * whole}size int, bits binary, wide array<long>")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float, key: str = "doc_id") -> DataFrame:
    """The pairs (u, v) whose sets are at least that similar."""
    side = lambda c: sets.select(F.col(key).alias(c), F.col("set").alias(f"{c}_set"))
    common = F.size(F.array_intersect("u_set", "v_set"))
    union = F.size("u_set") + F.size("v_set") - common
    return pairs.join(side("u"), "u").join(side("v"), "v").filter((union == 0) | (common >= similarity * union)).select("u", "v")


def verified(found: DataFrame, pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    wanted = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()
    sets = shared.written(shingled(found.join(bounded(wanted), "doc_id", "left_semi"), shingle).dropDuplicates(["doc_id"]), "sets")
    return alike(pairs, sets, similarity)


def common_shingles(found: DataFrame, names: DataFrame, shingle: int, sample: int = 20_000, least: int = 3, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that a sample of texts often holds, and their ranks. They order prefixes only and change no result."""
    share = min(1.0, sample / max(1, names.count()))
    drawn = names.select(F.col("doc").alias("doc_id")).sample(share, 5)
    sets = shingled(found.join(bounded(drawn), "doc_id", "left_semi"), shingle)
    counted = sets.select(F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    table = counted.orderBy(F.desc("n"), "s").limit(most).toArrow()
    values = table["s"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], -order


def _meeting(similarity: float, partners: int) -> Callable[[pa.Table], pa.Table]:
    def pair(table: pa.Table) -> pa.Table:
        key, node, label, size = (table[c].to_numpy() for c in ("key", "node", "label", "size"))
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(-1, 8)
        u, v, more = prefix_pairs(key, node, label, size.astype(np.int64), bits, similarity, partners)
        return pa.table({"u": u, "v": v, "more": np.full(len(u), bool(more))})

    return pair


def _mixed(table: pa.Table) -> pa.Table:
    """The rows of keys whose nodes have several labels."""
    key, label = table["key"].to_numpy(), table["label"].to_numpy()
    order = np.lexsort((label, key))
    key, label = key[order], label[order]
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.append(begins[1:], len(key)) - 1
    several = np.repeat(label[begins] != label[ends], ends - begins + 1)
    return table.take(pa.array(order[several]))


def prefix_links(found: DataFrame, names: DataFrame, front: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """front with links (u, v) of similar texts that it leaves in two components: the components are those of all similar pairs.

    found: (doc_id, text); names: (node, doc), the hash of each distinct text and its first document. Every text is
    filed under its prefix; keys of several texts are kept, and pairs of texts of two components that pass the exact
    bounds of sizes and parity bits are verified. In a crowd of near copies these would be nearly all pairs, so each
    text proposes a few partners first; components grow by those that are similar, and rounds with more partners
    follow until no text of a key has any left in another component that it did not propose.
    """
    spark = ship(found.sparkSession)
    buckets = 4 * shared.partitions(spark)
    common, rank = common_shingles(found, names, shingle)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  pa.compute is a module of its own

        def kept() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for part in shared._sliced(batches, 1 << 20):
                ids, first = np.unique(part["node"].to_numpy(), return_index=True)
                texts = part["text"].combine_chunks().cast(pa.binary()).take(pa.array(first)).to_pylist()
                held = [prefix(x, similarity, common, rank) for x in shingle_sets(texts, shingle)]
                yield np.concatenate(held), np.repeat(ids, [len(x) for x in held])

        def joined() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            rows, n = [], 0
            for keys, nodes in kept():
                rows.append((keys, nodes))
                n += len(keys)
                if n >= 1 << 20:
                    yield np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows])
                    rows, n = [], 0
            if rows:
                yield np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows])

        for keys, nodes in joined():
            bucket = (mix(keys) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = [(k, order[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            packed = [shared.join_parts(keys[r].tobytes(), nodes[r].tobytes()) for _, r in out]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array(packed, pa.binary())], ["bucket", "message"])

    def meet(table: pa.Table) -> pa.Table:
        parts = [shared.split_parts(m) for m in table["message"].to_pylist()]
        keys, nodes = (np.concatenate([np.frombuffer(p[k], "<i8") for p in parts]) for k in (0, 1))
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])))
        keys, nodes = keys[new], nodes[new]
        again = keys[1:] == keys[:-1]
        several = np.concatenate(([False], again)) | np.concatenate((again, [False]))
        return pa.table({"key": keys[several], "node": nodes[several]})

    hashed = found.select(F.xxhash64("text").alias("node"), "doc_id", "text")
    runs = shared.written(hashed.select("node", "text").mapInArrow(emit, "bucket int, message binary").groupBy("bucket").applyInArrow(meet, "key long, node long"), "runs")
    label = F.xxhash64(F.coalesce("root", "doc")).alias("label")
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    doc = lambda c: names.select(F.col("node").alias(c), F.col("doc").alias(f"{c}_doc"))

    def firsts(nodes: DataFrame) -> DataFrame:
        """(node, text) of the first document of each of the nodes."""
        wanted = names.join(nodes, "node", "left_semi").select("node", F.col("doc").alias("doc_id"))
        return hashed.join(bounded(wanted), ["node", "doc_id"], "left_semi").select("node", "text")

    links, partners, sketches = front, PARTNERS, None
    while True:
        joined = components(links)
        labels = names.join(joined, names["doc"] == joined["node"], "left").select(names["node"], label)
        labelled = runs.join(bounded(labels), "node").select(bucket, "key", "node", "label")
        active = shared.written(labelled.groupBy("bucket").applyInArrow(_mixed, "bucket long, key long, node long, label long"), "active")
        if sketches is None:  # later rounds have no other texts
            sketches = shared.written(shingled(firsts(active.select("node").distinct()), shingle, "node", whole=False).dropDuplicates(["node"]), "sketches")
        rows = active.join(bounded(sketches.select("node", "size", "bits"), 250_000), "node").select("bucket", "key", "node", "label", "size", "bits")
        near = shared.written(rows.groupBy("bucket").applyInArrow(_meeting(similarity, partners), "u long, v long, more boolean"), "near")
        # of those that a wider parity leaves, each text's nearest ones first
        side = lambda c: sketches.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("wide").alias(f"{c}_wide"))
        apart = near.select("u", "v").distinct().join(side("u"), "u").join(side("v"), "v").withColumn("d", differing(F.col("u_wide"), F.col("v_wide")))
        apart = apart.filter(F.col("d") <= (1 - similarity) / (1 + similarity) * (F.col("u_size") + F.col("v_size")) + 1e-6)
        ranked = shared.written(apart.select("u", "v", F.row_number().over(Window.partitionBy("v").orderBy("d", "u")).alias("rank")), "ranked")
        pairs = ranked.filter(F.col("rank") <= partners).select("u", "v")
        ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        sets = shared.written(shingled(firsts(ends), shingle, "node").dropDuplicates(["node"]), "prefix_sets")
        good = alike(pairs, sets, similarity, "node").join(bounded(doc("u")), "u").join(bounded(doc("v")), "v").select(F.col("u_doc").alias("u"), F.col("v_doc").alias("v"))
        links = links.union(shared.written(good, "prefix_links"))
        again = not near.filter("more").isEmpty() or not ranked.filter(F.col("rank") > partners).isEmpty()
        shared.dropped(active, near, ranked, sets)  # what is left of them is in links
        if not again:
            shared.dropped(runs, sketches)
            return links
        partners *= GROWTH


def similar_links(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = 5, features: int = FEATURES, distance: int = WIDE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, least) of texts that some document before them has too, and (u, v) links of documents whose sets of shingles are similar.

    SimHashes of two-word shingles at most `distance` bits apart come first: they join most copies at little cost, but
    miss some (above all added or cut passages) and pass over pairs of crowded keys. prefix_links then finds every
    similar pair that they left in two components. The exact similarity of the sets decides on both.
    """
    spark = ship(docs.sparkSession)
    found = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed = found.select(F.struct("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")).alias("doc_id"), "text")
    prints = shared.written(fingerprints(hashed, features).select("doc_id.*", "fingerprint"), "texts")
    texts = shared.written(prints.groupBy("fingerprint", "h", "n").agg(F.min("doc_id").alias("least")), "distinct")
    same = prints.join(texts, ["fingerprint", "h", "n"]).filter("doc_id <> least").select("doc_id", "least")
    nodes = texts.groupBy("fingerprint").agg(F.min("least").alias("head"))
    inside = texts.join(nodes, "fingerprint").filter("least <> head").select(F.col("head").alias("u"), F.col("least").alias("v"))
    near = near_links(nodes, distance, pairs=True).filter("u <> v").distinct()
    head = lambda c: nodes.select(F.col("fingerprint").alias(c), F.col("head").alias(f"{c}_doc"))
    across = near.join(head("u"), "u").join(head("v"), "v").select(F.col("u_doc").alias("u"), F.col("v_doc").alias("v"))
    pairs = shared.written(inside.union(across), "candidates")
    front = shared.written(verified(found, pairs, similarity, shingle), "front")
    names = shared.written(texts.groupBy(F.col("h").alias("node")).agg(F.min("least").alias("doc")), "names")
    return same, prefix_links(found, names, front, similarity, shingle)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = 5, features: int = FEATURES, distance: int = WIDE) -> DataFrame:
    """The rows of docs that stay: of each component of similar documents the row with the least doc_id (one of its repeated rows).

    A row with a null id stays. Texts without words are similar to one another.
    """
    same, links = similar_links(docs, similarity, shingle, features, distance)
    joined = components(links)
    # equal texts follow the first of them; what isn't the least of its component goes
    gone = joined.select(F.col("node").alias("doc_id")).union(same.select("doc_id")).distinct()
    gone = shared.written(gone, "gone")
    left = docs.join(bounded(gone), "doc_id", "left_anti")
    repeated = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if not repeated.isEmpty():
        twice = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        left = left.join(repeated, "doc_id", "left_anti").unionByName(twice)
    return left.select(*docs.columns)
