"""Text functions: URLs, dates, cleaning, sentences, chunks, JSON edges. Columns in, columns out, unless a fold needs Python."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.ship import ship

#: Fixed patterns, first hit wins: kind of URL -> pattern of its id.
URLS: list[tuple[str, str]] = [
    ("video", r"[?&]v=([A-Za-z0-9_-]{11})"),
    ("video", r"youtu\.be/([A-Za-z0-9_-]{11})"),
    ("video", r"youtube\.com/(?:shorts|embed|live)/([A-Za-z0-9_-]{11})"),
    ("playlist", r"[?&]list=([A-Za-z0-9_-]+)"),
    ("channel", r"youtube\.com/@([A-Za-z0-9_.-]+)"),
    ("channel", r"youtube\.com/channel/([A-Za-z0-9_-]+)"),
    ("channel", r"youtube\.com/(?:c|user)/([A-Za-z0-9_.-]+)"),
]
#: Patterns of fillers, removed in this order without regard to case.
FILLERS = [r"\b(?:um|uh|uhm|umm)\b", r"\byou know\b", r"\bbasically\b", r"\bsort of\b", r"\bkind of\b", r"\bI mean\b", r"\bright\?\s*", r"\blike,?\s+(?=\w)"]
#: Abbreviations whose period ends no sentence.
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "vs", "etc", "approx"]
#: Fixed table of language names.
LANGUAGES = {"en": "English", "es": "Spanish", "fr": "French", "de": "German", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "ru": "Russian", "zh": "Chinese", "ja": "Japanese", "ko": "Korean", "ar": "Arabic", "hi": "Hindi", "tr": "Turkish", "pl": "Polish", "sv": "Swedish", "no": "Norwegian", "da": "Danish", "fi": "Finnish", "cs": "Czech", "el": "Greek", "he": "Hebrew", "th": "Thai", "vi": "Vietnamese", "id": "Indonesian", "uk": "Ukrainian", "ro": "Romanian"}


def parse_url(url: Column) -> Column:
    """struct(kind, id): what a URL, or a bare @handle, points at (handles without their @); both null for anything else (to be set aside)."""
    url = F.trim(url)
    hosts = url.rlike(r"(?:youtube\.com|youtu\.be)")
    bare = F.regexp_extract(url, r"^@([A-Za-z0-9_.-]+)", 1)
    kind, id_ = F.when(bare != "", F.lit("channel")), F.when(bare != "", bare)
    for name, pattern in reversed(URLS):
        found = F.regexp_extract(url, pattern, 1)
        hit = hosts & (found != "")
        kind, id_ = F.when(hit, F.lit(name)).otherwise(kind), F.when(hit, found).otherwise(id_)
    return F.struct(kind.alias("kind"), id_.alias("id"))


def iso_date(compact: Column) -> Column:
    """yyyyMMdd as yyyy-MM-dd; other values as they are, null as an empty string."""
    parts = F.concat_ws("-", F.substring(compact, 1, 4), F.substring(compact, 5, 2), F.substring(compact, 7, 2))
    return F.when(F.length(compact) == 8, parts).otherwise(F.coalesce(compact, F.lit("")))


def minutes_seconds(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def deep_link(video_id: Column, seconds: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id, F.lit("&t="), F.floor(seconds).cast("long").cast("string"), F.lit("s"))


def segments_text(segments: Column) -> Column:
    """'[MM:SS] text' of each segment, joined by spaces."""
    return F.array_join(F.transform(segments, lambda s: F.concat(F.lit("["), minutes_seconds(s["start"]), F.lit("] "), s["text"])), " ")


def subtitle_events(payload: Column) -> Column:
    """Segments of subtitle JSON: texts of an event's parts joined, milliseconds as seconds."""
    schema = "struct<events:array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>>"
    events = F.filter(F.from_json(payload, schema)["events"], lambda e: e["segs"].isNotNull())
    return F.transform(events, lambda e: F.struct(F.trim(F.array_join(e["segs"]["utf8"], "")).alias("text"), (e["tStartMs"] / 1000).alias("start"), (e["dDurationMs"] / 1000).alias("duration")))


def quick_normalize(text: Column) -> Column:
    for pattern in FILLERS:
        text = F.regexp_replace(text, "(?i)" + pattern, "")
    return F.trim(F.regexp_replace(text, r"\s{2,}", " "))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def sentences(text: Column) -> Column:
    """Split after . ! or ? and white space, not after abbreviations or numbers."""
    mark = "\x01"
    for a in ABBREVIATIONS:
        text = F.regexp_replace(text, rf"\b{re.escape(a)}\.", a.replace(".", mark) + mark)
    text = F.regexp_replace(text, r"(\d)\. ", f"$1{mark} ")
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(F.replace(x, F.lit(mark), F.lit("."))))
    return F.array_remove(parts, "")


def file_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N} _-]", "_"))


def content_hash(cleaned: Column, raw: Column) -> Column:
    return F.sha2(F.coalesce(F.nullif(cleaned, F.lit("")), raw), 256)


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), F.upper(code))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in doubles; 1 where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms).otherwise(F.lit(1.0))


def fenced(reply: Column) -> Column:
    """A model's reply without a code fence around it."""
    return F.trim(F.regexp_replace(reply, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))


def json_list(reply: Column, element: str) -> Column:
    """An array from a reply; empty unless the reply is a JSON array."""
    text = fenced(reply)
    return F.when(text.startswith("["), F.coalesce(F.from_json(text, f"array<{element}>"), F.array().cast(f"array<{element}>"))).otherwise(F.array().cast(f"array<{element}>"))


def json_object(reply: Column, schema: str) -> Column:
    """A struct from a reply: itself, or the outermost braces in it."""
    text = fenced(reply)
    return F.coalesce(F.from_json(F.when(text.startswith("{"), text), schema), F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema))


def triage_reply(reply: Column) -> Column:
    """struct(category, confidence, reasoning); AMBIGUOUS with confidence 0 if the reply holds none."""
    found = json_object(reply, "category string, confidence double, reasoning string")
    return F.struct(F.coalesce(F.upper(found["category"]), F.lit("AMBIGUOUS")).alias("category"), F.coalesce(found["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(found["reasoning"], F.lit("")).alias("reasoning"))


def repair_json(text: str) -> object:
    """Parses JSON after mending trailing commas, missing commas and what was cut off; None if that fails."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    text = re.sub(r"\}\s*\{", "},{", text.strip())
    closers, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "[{":
            closers.append("]" if c == "[" else "}")
        elif c in "]}" and closers:
            closers.pop()
    text += '"' * quoted + "".join(reversed(closers))
    try:
        return json.loads(re.sub(r",\s*([\]}])", r"\1", text))
    except ValueError:
        return None


def sliding_windows(text: Column, size: int = 400, overlap: int = 80, least: int = 50) -> Column:
    """Chunks of `size` words each `size - overlap` words; texts and last chunks under `least` words are left out."""

    def cut(w: Column) -> Column:
        n = F.size(w)
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))
        kept = F.filter(F.transform(starts, lambda i: F.slice(w, i + 1, size)), lambda c, i: (n >= least) & ((i == 0) | (F.size(c) >= least)))
        return F.transform(kept, lambda c: F.array_join(c, " "))

    # the words are bound once: inside a lambda they would be split anew for each window
    return F.element_at(F.transform(F.array(words(text)), cut), 1)


def sliding_chunks(docs: DataFrame, size: int = 400, overlap: int = 80, least: int = 50) -> DataFrame:
    """(chunk_id, video_id, chunk_index, text, word_count, first_word) of rows (video_id, text)."""
    cut = docs.select("video_id", F.posexplode(sliding_windows(F.col("text"), size, overlap, least)).alias("chunk_index", "text"))
    named = F.concat("video_id", F.lit("__chunk_"), F.lpad(F.col("chunk_index").cast("string"), 4, "0"))
    return cut.select(named.alias("chunk_id"), "video_id", "chunk_index", "text", F.size(words(F.col("text"))).alias("word_count"), (F.col("chunk_index") * (size - overlap)).alias("first_word"))


def merge_windows(chunks: Column, overlap: int) -> Column:
    """Texts of overlapping windows as one: later ones lose min(overlap, half of their words)."""
    skip = lambda c: F.least(F.lit(overlap), F.floor(F.size(words(c)) / 2).cast("int"))
    cut = F.transform(chunks, lambda c, i: F.when(i == 0, words(c)).otherwise(F.slice(words(c), skip(c) + 1, F.greatest(F.size(words(c)), F.lit(1)))))
    return F.array_join(F.flatten(cut), " ")


def word_time(segments: Column, index: Column) -> Column:
    """When the word of this number is said: within the first segment whose running count of words reaches it, in proportion.

    segments: array of struct(text, start, duration) in order. Index 0: the first start; past the end: the last end; none: 0.
    """
    state = F.struct(F.lit(0).alias("seen"), F.lit(None).cast("double").alias("at"), F.lit(0.0).cast("double").alias("end"))

    def step(s: Column, g: Column) -> Column:
        n = F.size(words(g["text"]))
        total = s["seen"] + n
        inside = g["start"] + g["duration"] * F.when(n > 0, (index - s["seen"]) / n).otherwise(F.lit(0.0))
        at = F.when(s["at"].isNull() & (total >= index), inside).otherwise(s["at"])
        return F.struct(total.alias("seen"), at.cast("double").alias("at"), (g["start"] + g["duration"]).cast("double").alias("end"))

    return F.round(F.aggregate(segments, state, step, lambda s: F.coalesce(s["at"], s["end"])), 2)


def pack_sentences(parts: Column, most: int) -> Column:
    """Sentences packed greedily into texts of at most `most` characters; a longer sentence stands alone."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["open"] == "") | (F.length(s["open"]) + 1 + F.length(x) <= most)
        joined = F.when(s["open"] == "", x).otherwise(F.concat(s["open"], F.lit(" "), x))
        return F.when(fits, F.struct(s["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), x.alias("open")))

    return F.aggregate(parts, state, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def reslice(translated: Column, segments: Column) -> Column:
    """The words of a translated text dealt to segments by their own word counts; the last takes the rest."""
    w = words(translated)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, g: Column) -> Column:
        n = F.size(words(g["text"]))
        last = F.size(s["out"]) == F.size(segments) - 1
        part = F.slice(w, s["at"] + 1, F.when(last, F.greatest(F.size(w), F.lit(1))).otherwise(n))
        return F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(F.array_join(part, " "))).alias("out"))

    return F.aggregate(segments, state, step, lambda s: s["out"])


def bag_embedder(texts: list[str], size: int = 32) -> list[list[float]]:
    """A deterministic stand-in for a model: hashed counts of words."""
    import zlib

    out = []
    for text in texts:
        vector = [0.0] * size
        for word in text.lower().split():
            vector[zlib.crc32(word.encode()) % size] += 1.0
        out.append(vector)
    return out


def semantic_cuts(parts: list[str], vectors: list[list[float]], most: int, least: int, threshold: float, group: int) -> list[tuple[int, int, str]]:
    """(first sentence, end sentence, text) of chunks: groups of sentences, cut where neighbours differ; short ones join the chunk before, long ones are split."""
    n = len(vectors)

    def distance(a: list[float], b: list[float]) -> float:
        norm = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return 1 - sum(x * y for x, y in zip(a, b)) / norm if norm else 1.0

    cuts = [0] + [i * group for i in range(1, n) if distance(vectors[i - 1], vectors[i]) > threshold] + [len(parts)]
    out: list[tuple[int, int, str]] = []
    for a, b in zip(cuts, cuts[1:]):
        text = " ".join(parts[a:b])
        if len(text.split()) < least and out:
            first, _, before = out[-1]
            out[-1] = (first, b, f"{before} {text}")
        else:
            out.append((a, b, text))
    return [(a, b, " ".join(w[i : i + most])) for a, b, text in out for w in [text.split()] for i in range(0, len(w), most)]


def semantic_chunks(docs: DataFrame, embed: Callable[[list[str]], list[list[float]]] = bag_embedder, most: int = 600, least: int = 100, threshold: float = 0.4, group: int = 3) -> DataFrame:
    """(video_id, chunk_index, text, first_sentence, end_sentence) of rows (video_id, text); none for under six sentences."""
    ship(docs.sparkSession)
    split = docs.select("video_id", sentences(F.col("text")).alias("parts")).filter(F.size("parts") >= 6)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for video_id, parts in zip(batch["video_id"], batch["parts"]):
                parts = list(parts)
                vectors = embed([" ".join(parts[i : i + group]) for i in range(0, len(parts) - len(parts) % group, group)])
                rows += [(video_id, k, text, a, b) for k, (a, b, text) in enumerate(semantic_cuts(parts, vectors, most, least, threshold, group))]
            yield pd.DataFrame(rows, columns=["video_id", "chunk_index", "text", "first_sentence", "end_sentence"])

    return split.mapInPandas(run, "video_id string, chunk_index int, text string, first_sentence int, end_sentence int")


def model_column(text: Column, call: Callable[[list[str]], list[str]], fallback: bool = True) -> Column:
    """A model's reply for each text, in Arrow batches; where a call fails the text itself (or null) stands."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(call(texts.fillna("").tolist()))
        except Exception:
            return texts if fallback else pd.Series([None] * len(texts))

    return F.coalesce(run(text), text) if fallback else run(text)
