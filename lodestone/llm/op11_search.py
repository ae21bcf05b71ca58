"""Ranked lexical search over whole texts.

Terms are the runs of ASCII letters, ASCII digits and characters from U+0080 on, A-Z in lower case. The
index is a table of postings bucketed by term: a row is a term with the places and counts of the documents
of one block (a bounded batch of documents) that hold it, and each block has one row of its documents' ids
and lengths. A search joins the terms of the items to the postings in place, scores each match with
integers, sums by item and document within a block (all of a document's terms are in its block, so sums
need no further exchange), keeps the k best of each item and block, and ranks those with a window.

With N documents that hold a term, L terms in all, n terms in the document and df documents holding a term,
its weight is w = floor(1000 ln((2N + 2) / (2df + 1))), m = 50 + (50 n N) div L and a match of tf occurrences
scores w ((10^9 tf) div (1000 tf + 20 m)).

A frequent word has one row a block, so that no term is gathered in one place; blocks and blocks of items
bound the memory of a task, and a very long text is a block by itself.

Defined results: a null or empty text holds no term and is neither ranked nor counted; an item without
terms has no rows; a term counts once an item; repeated rows are documents (items) of their own, ranked
(answered) each; equal scores by ascending id, a null id first; empty tables give an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import shared
from lodestone.ship import ship

#: Items of a block: their sums over a block of documents are held at once.
ITEMS = 256
_BREAK = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: The same terms in UTF-8, where every byte of a character from U+0080 on is over 7F.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
POSTINGS = "term string, block long, n_docs int, docs array<int>, counts array<int>, ids array<long>, lengths array<long>"
#: A text over this size is counted match by match, without a list of its terms.
_LONG = 8 << 20


def terms(text: Column) -> Column:
    """Distinct terms of a text in order of first place."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_distinct(F.array_remove(F.split(lowered, _BREAK), ""))


def _counts(text: bytes) -> Counter:
    text = text.lower()  # bytes: A-Z alone
    return Counter(_TERM.findall(text) if len(text) < _LONG else (found.group() for found in _TERM.finditer(text)))


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


def _block(number: int, ids: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
    """Rows of the index for one block of documents, which stand in ascending order of ids, null first."""
    vocabulary: dict[bytes, int] = {}
    place = vocabulary.setdefault
    codes, docs, counts, lengths = [], [], [], np.zeros(len(texts), np.int64)
    for d, text in enumerate(texts):
        if text:
            found = _counts(text)
            lengths[d] = found.total()
            codes.append(np.fromiter((place(t, len(vocabulary)) for t in found), np.int64, len(found)))
            counts.append(np.fromiter(found.values(), np.int64, len(found)))
            docs.append(np.full(len(found), d, np.int64))
    code, doc, count = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (codes, docs, counts))
    order = np.argsort(code, kind="stable")
    sizes = np.bincount(code, minlength=len(vocabulary))
    # the block's own row stands under a term that no text holds, so that such rows spread over the buckets
    names = pa.concat_arrays([pa.array(list(vocabulary), pa.binary()).cast(pa.string()), pa.array([f"\0{number}"], pa.string())])
    rows, none = len(vocabulary) + 1, pa.nulls(len(vocabulary), pa.list_(pa.int64()))
    ends = np.concatenate([np.cumsum(sizes), [len(code)]])
    head = lambda values: pa.concat_arrays([none, pa.array([values], pa.list_(pa.int64()))])
    columns = [names, pa.array(np.full(rows, number), pa.int64()), pa.array(np.append(sizes, 0), pa.int32()), _lists(doc[order], ends, pa.int32()), _lists(count[order], ends, pa.int32()), head(ids.to_pylist()), head(lengths.tolist())]
    return pa.RecordBatch.from_arrays(columns, ["term", "block", "n_docs", "docs", "counts", "ids", "lengths"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    first = TaskContext.get().partitionId() << 24
    for n, batch in enumerate(batches):
        if batch.num_rows:
            batch = batch.take(pc.sort_indices(batch, [("id", "ascending")], null_placement="at_start"))
            yield _block(first + n, batch["id"], batch["text"].to_pylist())


@dataclass(frozen=True)
class Index:
    """Postings bucketed by term, their number of documents with a term (N) and of terms (L)."""

    postings: DataFrame
    n_docs: int
    n_terms: int
    table: str
    path: str

    def drop(self) -> None:
        """Removes the index with its files."""
        spark = self.postings.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        shared.deleted(spark, self.path)


def build(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Index:
    """Indexes every document; one exchange of postings by term."""
    spark = ship(docs.sparkSession)
    n, table, path = shared.partitions(spark), f"lodestone_postings_{uuid.uuid4().hex[:12]}", shared.scratch(spark, "postings")
    texts = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].cast("string").cast("binary").alias("text"))
    postings = texts.mapInArrow(_indexed, POSTINGS).repartition(n, "term")
    postings.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, "term").saveAsTable(table)
    postings = spark.table(table)
    held = postings.filter("ids IS NOT NULL").select(F.explode("lengths").alias("n")).filter("n > 0")
    total = held.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    return Index(postings, total.n, total.l or 0, table, path)


def search(index: Index, items: DataFrame, k: int = 50, id_column: str = "item_id", text_column: str = "text", per_block: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    n_docs, n_terms = index.n_docs, index.n_terms
    asked = shared.written(items.select(F.monotonically_increasing_id().alias("item"), items[id_column].alias("item_id"), terms(items[text_column]).alias("terms")), "items")
    blocks = max(1, math.ceil(asked.count() / per_block))
    pairs = asked.select("item", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("part"), F.explode("terms").alias("term"))
    held = index.postings.select("term", "n_docs").join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long").alias("w")
    wanted = pairs.groupBy("part", "term").agg(F.collect_list("item").alias("items")).join(held.select("term", weight), "term")
    matches = index.postings.select("term", "block", "docs", "counts").join(wanted, "term").select("part", "block", "w", "items", "docs", "counts")
    heads = index.postings.filter("ids IS NOT NULL").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), F.col("block").alias("at"), "ids", "lengths")

    def best(head: pa.Table, found: pa.Table) -> pa.Table:
        kept: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
        if head.num_rows and found.num_rows:
            kept += _best(head, found.combine_chunks(), n_docs, n_terms, k)
            ids = head["ids"][0].values
            item, doc, score = (np.concatenate(x) for x in zip(*kept))
            return pa.table({"item": item, "doc_id": ids.take(pa.array(doc)), "score": score})
        return pa.table({"item": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    partial = heads.groupBy("part", "at").cogroup(matches.groupBy("part", "block")).applyInArrow(best, "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))).alias("rank")
    ranked = partial.select("item", rank, "doc_id", "score").filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _best(head: pa.Table, found: pa.Table, n_docs: int, n_terms: int, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, place, score) of the k best of each item in one block; places ascend with ids."""
    column = lambda name: found[name].chunk(0)
    flat = lambda name: column(name).flatten().to_numpy(zero_copy_only=False)
    ends = lambda name: np.cumsum(column(name).value_lengths().to_numpy(zero_copy_only=False))
    lengths = head["lengths"][0].values.to_numpy()
    m = 50 + 50 * lengths * n_docs // n_terms
    docs, tf, bound = flat("docs").astype(np.int64), flat("counts").astype(np.int64), ends("docs")
    w = np.repeat(column("w").to_numpy(), np.diff(bound, prepend=0))
    points = w * (10**9 * tf // (1000 * tf + 20 * m[docs]))
    items, place = np.unique(flat("items"), return_inverse=True)
    sums = np.zeros((len(items), len(lengths)), np.int64)
    a = b = 0
    for to, upto in zip(bound.tolist(), ends("items").tolist()):
        at, gain = docs[a:to], points[a:to]
        for i in place[b:upto]:
            sums[i, at] += gain  # a term's documents differ, so no place is met twice
        a, b = to, upto
    out = []
    for i, item in enumerate(items):
        row = sums[i]
        least = max(1, np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else 1
        at = np.flatnonzero(row >= least)
        at = at[np.argsort(-row[at], kind="stable")][:k]
        out.append((np.full(len(at), item), at, row[at]))
    return out


def brute_force(docs: list[tuple[int | None, str | None]], items: list[str | None], k: int = 50) -> list[list[tuple[int | None, int]]]:
    """The rankings of the items, document by document."""
    split = lambda text: [w for w in re.split(_BREAK, (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) if w]
    counted = [(i, Counter(split(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item in items:
        scored = []
        for i, c, n in counted:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(split(item)) if t in c)
            scored += [(i, s)] * (s > 0)
        out.append(sorted(scored, key=lambda x: (-x[1], x[0] is not None, x[0] or 0))[:k])
    return out
