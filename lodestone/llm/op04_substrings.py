"""Substring dedup: Rabin-Karp hashes of every window of `size` words, counted in Spark.

Each block sends the sorted distinct hashes of its windows to buckets (ranges of the hash),
a bucket counts them over all blocks, and a reply holds one bit for each hash it was sent:
whether that window starts more than once. Repeated windows merge into maximal intervals,
whose words go. Two different windows share one of 2**64 hashes with a chance of about
n**2 / 2**65 among n windows.

Defined results: a null text has no words; a text shorter than a window keeps all words;
repeated rows are documents of their own, so their windows repeat; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import shared
from lodestone.llm.words import Words, covered, windows

WINDOW = 35


def _texts(table: pa.Table) -> list[bytes]:
    return table["text"].cast(pa.binary()).fill_null(b"").to_pylist()


def _counted(blocks: list[int], messages: list[bytes]) -> list[bytes]:
    parts = [shared.split_parts(m) for m in messages]
    hashes = [shared.unsqueeze_sorted(p[0]) for p in parts]
    twice = [np.unpackbits(np.frombuffer(p[1], np.uint8), count=len(h)).astype(bool) for p, h in zip(parts, hashes)]
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    same = ranked[1:] == ranked[:-1]
    repeated = np.concatenate(twice)
    flags = repeated[order]
    # a hash that one block saw twice is repeated for every block
    groups = np.cumsum(np.concatenate(([0], ~same))) if len(ranked) else np.zeros(0, np.int64)
    seen = np.zeros(int(groups[-1]) + 1 if len(ranked) else 0, bool)
    np.logical_or.at(seen, groups[flags], True)
    seen |= np.bincount(groups, minlength=len(seen)) > 1
    answer = np.empty(len(every), bool)
    answer[order] = seen[groups]
    cuts = np.cumsum([len(h) for h in hashes])[:-1]
    return [np.packbits(a).tobytes() for a in np.split(answer, cuts)]


def dedup_substrings(docs: DataFrame, size: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed): removed lists maximal word intervals [start, end) that go."""
    if size < 1:
        raise ValueError("a window has one word at least")
    named = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))
    spark: SparkSession = docs.sparkSession
    buckets = 4 * shared.partitions(spark)
    blocks = shared.pack(named, ["doc_id", "text"], "substrings")

    def hashed(table: pa.Table) -> tuple[Words, np.ndarray, np.ndarray]:
        words = Words(_texts(table))
        return words, *windows(words.hashes(), words.first, size)

    def emit(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        _, values, _ = hashed(table)
        ranked, counts = np.unique(values, return_counts=True)
        for bucket, part in shared.bucket_slices(ranked, buckets):
            yield bucket, shared.join_parts(shared.squeeze_sorted(ranked[part]), np.packbits(counts[part] > 1).tobytes())

    def finish(table: pa.Table, replies: dict[int, bytes]) -> pa.Table:
        words, values, at = hashed(table)
        ranked, back = np.unique(values, return_inverse=True)
        repeated = np.zeros(len(ranked), bool)
        for bucket, part in shared.bucket_slices(ranked, buckets):
            repeated[part] = np.unpackbits(np.frombuffer(replies[bucket], np.uint8), count=part.stop - part.start)
        gone = covered(at[repeated[back]] if len(at) else at, size, len(words.starts))
        data = words.data.tobytes()
        kept, spans, removed = [], [], []
        for i, (a, b) in enumerate(zip(words.first.tolist(), words.first[1:].tolist())):
            mask = gone[a:b]
            removed.append(int(mask.sum()))
            edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
            spans.append([{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)])
            # kept words are the runs between removed intervals
            runs = np.concatenate(([0], edges, [b - a])).reshape(-1, 2)
            kept.append(b" ".join(data[words.starts[a + x] : words.ends[a + y - 1]] for x, y in runs.tolist() if y > x))
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_words": pa.array(np.diff(words.first), pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_text": pa.array([k.decode() for k in kept], pa.string()),
                "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
        )

    replies = shared.exchange(shared.emitted(blocks, emit), _counted)
    kind = named.schema["doc_id"].dataType.simpleString()
    return shared.gathered(blocks, replies, finish, f"doc_id {kind}, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>")


def brute_force(texts: list[str | None], size: int) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, sha256 of the kept words) of each text, by a dictionary of whole windows."""
    from collections import Counter

    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out
