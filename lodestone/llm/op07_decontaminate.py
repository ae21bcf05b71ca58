"""Benchmark decontamination, with DataFrame functions only.

Words are runs of ASCII letters and digits and of all characters from U+0080 on, A-Z in lower
case. The benchmark's windows of `size` words (an item of fewer words is one window) are a hash
set that every task holds as a literal, as long as they are at most `bound`; a larger benchmark
is joined instead. A window of `size` words holds a whole gram of `gram` words at one of every
size - gram + 1 places, so texts are first scanned at those places only, and just texts with a
known gram are scanned window by window. Hashed hits are verified by joining their words with the
benchmark's.

Defined results: a null text has no words; an item without words, or null, has no window;
repeated rows are each reported; repeated items count by their ids, a null item id as no item;
empty tables give no hits; other columns are ignored by scan and carried by the removals.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import shared

SIZE, GRAM, BOUND = 10, 5, 200_000
_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW_KIND = "array<struct<start:int,size:int,window:string>>"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, _BREAK), "")


def _starts(count: Column, size: int, step: int = 1) -> Column:
    """Zero-based starts of windows of `size` among `count` words."""
    return F.when(count >= size, F.sequence(F.lit(0), count - size, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _hash(word: Column, start: Column, size: int) -> Column:
    return F.xxhash64(F.slice(word, start + 1, F.lit(size)))


def _joined(word: Column, start: Column, size: int) -> Column:
    return F.array_join(F.slice(word, start + 1, F.lit(size)), " ")


def benchmark_windows(benchmark: DataFrame, size: int = SIZE, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(window, size, items): each distinct window with the ids of its items as strings."""
    items = benchmark.select(benchmark[id_column].cast("string").alias("item"), words(benchmark[text_column]).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    w = F.col("w")
    cut = F.when(F.col("n") < size, F.array(F.struct(F.array_join(w, " ").alias("window"), F.col("n").alias("size")))).otherwise(
        F.transform(_starts(F.col("n"), size), lambda i: F.struct(_joined(w, i, size).alias("window"), F.lit(size).alias("size")))
    )
    return items.select("item", F.inline(cut)).groupBy("window", "size").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _holds(word: Column, size: int, known: list[int]):
    """Of a start: whether the window there has a known hash."""
    return lambda i: _hash(word, i, size).isin(known)


def scan(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, bound: int = BOUND, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, items array<string>, starts array<int>, sizes array<int>) of each row.

    starts and sizes tell where windows occur. carry adds all columns of docs in a struct `row`.
    """
    gram = min(GRAM, size)
    windows = shared.written(benchmark_windows(benchmark, size, item_column, item_text), "windows")
    stats = windows.groupBy("size").agg(F.count("*").alias("n")).collect()  # one row for each size up to `size`
    lengths, total = sorted(r["size"] for r in stats), sum(r["n"] for r in stats)
    base = docs.select(docs[id_column].alias("doc_id"), words(docs[text_column]).alias("w"), *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []))
    base = base.withColumn("n", F.size("w"))
    w, n = F.col("w"), F.col("n")
    nothing = F.array().cast(WINDOW_KIND)

    def found(length: int, keep) -> Column:
        starts = F.filter(_starts(n, length), keep)
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(length).alias("size"), _joined(w, i, length).alias("window")))

    if total <= bound:
        hits = nothing
        grams = windows.filter(F.col("size") == size).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(size - gram)), lambda i: _hash(F.split("window", " "), i, gram))).alias("h")).distinct()
        known_grams = [r.h for r in grams.collect()] if size in lengths else []
        for length in lengths:
            known = [r.h for r in windows.filter(F.col("size") == length).select(F.xxhash64(F.split("window", " ")).alias("h")).distinct().collect()]
            own = found(length, _holds(w, length, known))
            if length == size:
                suspect = F.exists(_starts(n, gram, size - gram + 1), _holds(w, gram, known_grams))
                own = F.when(suspect, own).otherwise(nothing)
            hits = own if hits is nothing else F.concat(hits, own)
        rows = base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("n").cast("long").alias("n_words"), hits.alias("hits"), *(["row"] if carry else []))
        rows = shared.written(rows, "hits")
        each = rows.filter(F.size("hits") > 0).select("rid", F.inline("hits"))
        each = each.join(F.broadcast(windows), ["window", "size"])  # at most `bound` windows
    else:
        rows = base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("n").cast("long").alias("n_words"), "w", "n", *(["row"] if carry else []))
        rows = shared.written(rows, "hits")
        # grams at the scanned places, joined with the benchmark's grams: rows that are worth a full scan
        grams = windows.filter(F.col("size") == size).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(size - gram)), lambda i: _hash(F.split("window", " "), i, gram))).alias("h")).distinct()
        scanned = rows.select("rid", F.explode(F.transform(_starts(n, gram, size - gram + 1), lambda i: _hash(w, i, gram))).alias("h"))
        suspects = scanned.join(grams, "h", "left_semi").select("rid").distinct()
        full = rows.join(suspects, "rid", "left_semi").select("rid", F.inline(found(size, lambda i: F.lit(True))))
        for length in [x for x in lengths if x < size]:
            full = full.union(rows.select("rid", F.inline(found(length, lambda i: F.lit(True)))))
        each = full.join(windows, ["window", "size"])
    merged = each.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # covered words: intervals in order of their starts, each counts from the end of those before it
    reach = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("count"), F.lit(0).alias("end")),
        lambda s, x: F.struct(
            (s["count"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(s["end"], x["start"]))).alias("count"),
            F.greatest(s["end"], x["start"] + x["size"]).alias("end"),
        ),
        lambda s: s["count"].cast("long"),
    )
    merged = merged.select("rid", "items", reach.alias("n_hit"), F.col("at.start").alias("starts"), F.col("at.size").alias("sizes"))
    plain = ["rid", "doc_id", "n_words", *(["row"] if carry else [])]
    facts = ["items", "n_hit", "starts", "sizes"]
    if "hits" in rows.columns:
        # only rows with a hashed hit meet their verified windows: other texts are not moved
        noisy = rows.filter(F.size("hits") > 0).select(*plain).join(merged, "rid", "left")
        quiet = rows.filter(F.size("hits") == 0).select(*plain, *[F.lit(None).cast(merged.schema[c].dataType).alias(c) for c in facts])
        joined = noisy.unionByName(quiet)
    else:
        joined = rows.select(*plain).join(merged, "rid", "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("starts", F.array().cast("array<int>")).alias("starts"),
        F.coalesce("sizes", F.array().cast("array<int>")).alias("sizes"),
        *(["row"] if carry else []),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, bound: int = BOUND) -> DataFrame:
    """The rows of docs without a window of the benchmark, columns as they were."""
    found = scan(docs, benchmark, size, bound, carry=True)
    return found.filter("n_hit = 0").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def clean_spans(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, bound: int = BOUND) -> DataFrame:
    """(doc_id, text) where words of benchmark windows are gone: the kept words of a hit text joined by one space, other texts unchanged."""
    found = scan(docs, benchmark, size, bound, carry=True)
    w = words(F.col("row.text"))
    spans = F.arrays_zip("starts", "sizes")
    kept = F.filter(w, lambda x, i: ~F.exists(spans, lambda s: (i >= s["starts"]) & (i < s["starts"] + s["sizes"])))
    return found.select("doc_id", F.when(F.col("n_hit") > 0, F.array_join(kept, " ")).otherwise(F.col("row.text")).alias("text"))


def brute_force(texts: list[str | None], items: list[tuple[object, str | None]], size: int = SIZE) -> list[tuple[int, int, list[str]]]:
    """(n_words, n_hit, items) of each text, by a dictionary of windows."""
    import re

    def cut(text: str | None) -> list[str]:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    known: dict[tuple[str, ...], set[str]] = {}
    for item, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            known.setdefault(tuple(w[i : i + size]), set()).update([] if item is None else [str(item)])
    lengths = {len(k) for k in known}
    out = []
    for text in texts:
        w, hit, who = cut(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in known:
                    hit |= set(range(i, i + n))
                    who |= known[k]
        out.append((len(w), len(hit), sorted(who)))
    return out
