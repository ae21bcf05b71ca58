"""Language ID by prediction with partial matching.

Each language has a tree of byte contexts up to `order` bytes, kept as tables of counts by
order. The next byte costs -log2(count / (n + kinds)) bits in the longest context that has
seen it; each longer context that the language knows but which has not seen the byte costs an
escape of -log2(kinds / (n + kinds)) bits; below order 0 a byte costs 8 bits. Counts are frozen
after learning, so a byte's cost depends on it and the bytes before it alone, and each distinct
group of bytes is worked out once. The language with the shortest code wins; the score is its
share of 2**-bits over all languages.

Bytes of ASCII letters count in lower case, bytes from 0x80 on as they are, runs of others as
one space; a context does not reach over the start of a text.

Learning: a sample of documents of each language, whole texts, bounded in expectation by `sample`
bytes per language (documented parameter). The model's size is bounded by that and the number of
languages; it is built on the driver and broadcast. All documents are then scored in full.

Defined results: null text, or a text without a letter: `und` with score 0; if nothing was
learned all are `und`; ties go to the first language by name; repeated rows are scored alike;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import shared
from lodestone.llm.words import U, mix
from lodestone.ship import ship

ORDER, SAMPLE = 5, 5_000_000
UNKNOWN = "und"
_MAP = np.full(256, 0x20, np.uint8)
_MAP[0x61:0x7B] = np.arange(0x61, 0x7B)
_MAP[0x41:0x5B] = np.arange(0x61, 0x7B)
_MAP[0x80:] = np.arange(0x80, 0x100)
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    found = _LETTER.search(text or "")
    return bool(found) and (found[0].isalpha() or any(c.isalpha() for c in text))


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document is never learned from: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def coded(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts, it and the `order` bytes before it as one number (the byte lowest); where texts begin."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(lengths + 1) - lengths - 1
    data = _MAP[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    keep[begins[(lengths > 0) & (begins < len(raw))]] = True
    keep[(begins[1:] - 1)] = False  # the line ends between texts
    place = np.concatenate(([0], np.cumsum(keep)))
    first = place[np.minimum(begins, len(raw))]
    data = data[keep]
    keys = data.astype(np.uint64)
    for k in range(1, order + 1):
        keys[k:] |= data[:-k].astype(np.uint64) << U(8 * k)
    for k in range(order):  # bytes near the start of a text: only spaces lie before it
        at = first + k
        at = at[at < np.append(first[1:], len(data))]
        own = U((1 << (8 * (k + 1))) - 1)
        spaces = U(sum(0x20 << (8 * j) for j in range(k + 1, order + 1)))
        keys[at] = (keys[at] & own) | spaces
    return keys, first


class Model:
    """Frozen counts of all languages and the cost of each group of bytes met so far."""

    #: Places of the table of costs, 8 bytes each and 4 for each language.
    SLOTS = 1 << 19

    def __init__(self, languages: list[str], order: int, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.languages, self.order, self.tables = languages, order, tables
        self.slots: np.ndarray | None = None

    @staticmethod
    def learn(rows: list[tuple[str, int, int, int]] | pa.Table, order: int) -> Model:
        """rows: language, order, number of context and byte, count."""
        languages = sorted(set(rows["lang"].to_pylist()))
        lang = np.array([languages.index(x) for x in rows["lang"].to_pylist()], np.int64)
        orders, keys, counts = rows["o"].to_numpy(), rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy().astype(np.float64)
        tables = []
        for o in range(order + 1):
            at = orders == o
            k, inverse = np.unique(keys[at], return_inverse=True)
            c = np.zeros((len(k), len(languages)))
            np.add.at(c, (inverse, lang[at]), counts[at])
            contexts, context = np.unique(k >> U(8), return_inverse=True)
            total = np.zeros((len(contexts), len(languages)))
            kinds = np.zeros((len(contexts), len(languages)))
            np.add.at(total, context, c)
            np.add.at(kinds, context, (c > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                bits = np.where(c > 0, -np.log2(c / (total + kinds)[context]), np.inf)
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
            tables.append((k, bits.astype(np.float32), contexts, escape.astype(np.float32)))
        return Model(languages, order, tables)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """The cost in bits of each group of bytes in each language."""
        out = np.zeros((len(keys), len(self.languages)))
        open_ = np.ones(out.shape, bool)
        for o in range(self.order, -1, -1):
            known, bits, contexts, escape = self.tables[o]
            own = keys & U((1 << (8 * (o + 1))) - 1)
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            cost = np.where((known[place] == own)[:, None], bits[place], np.inf)
            hit = open_ & np.isfinite(cost)
            out[hit] += cost[hit]
            open_ &= ~hit
            place = np.minimum(np.searchsorted(contexts, own >> U(8)), len(contexts) - 1)
            step = np.where((contexts[place] == own >> U(8))[:, None], escape[place], 0)
            out += np.where(open_, step, 0)
        return out + 8.0 * open_

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """As bits(), from a table of the groups met before."""
        if self.slots is None:
            self.slots = np.full(self.SLOTS, np.iinfo(np.uint64).max, np.uint64)
            self.costs = np.zeros((self.SLOTS, len(self.languages)), np.float32)
        slot = ((keys * U(0x9E3779B97F4A7C15)) >> U(45)).astype(np.int64)
        missing = np.flatnonzero(self.slots[slot] != keys)
        if len(missing):
            new, inverse = np.unique(keys[missing], return_inverse=True)
            fresh = self.bits(new).astype(np.float32)
            out = self.costs[slot]
            out[missing] = fresh[inverse]
            place = ((new * U(0x9E3779B97F4A7C15)) >> U(45)).astype(np.int64)
            self.slots[place], self.costs[place] = new, fresh
            # of two groups for one slot the last one written holds it; both arrays are written in one order
            return out
        return self.costs[slot]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) < 400_000):
                size += len(texts[stop])
                stop += 1
            keys, first = coded(texts[at:stop], self.order)
            if len(keys):
                cost = self.cost(keys)
                some = np.flatnonzero(np.diff(np.append(first, len(keys))))
                for j in range(cost.shape[1]):
                    out[at + some, j] = np.add.reduceat(np.ascontiguousarray(cost[:, j]), first[some], dtype=np.float64)
            at = stop
        return out


def learn(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model | None:
    """A model of the documents that are not held out and have a language."""
    if not 0 <= order <= 6:
        raise ValueError("an order from 0 to 6 is asked for")
    ship(docs.sparkSession)
    own = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"), docs[lang_column].cast("string").alias("lang"))
    own = own.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = {r["lang"]: max(1, r["n"] or 0) for r in own.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    if not counts:
        return None
    span = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(span, span * sample // n))])
    picked = own.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(span)) < share[F.col("lang")])).select("lang", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist())
            texts = np.array(batch["text"].cast(pa.binary()).to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                keys, _ = coded(texts[langs == lang].tolist(), order)
                for o in range(order + 1):
                    k, n = np.unique(keys & U((1 << (8 * (o + 1))) - 1), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(np.full(len(k), o, np.int32)), pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "o", "key", "n"])

    rows = picked.mapInArrow(grams, "lang string, o int, key long, n long").groupBy("lang", "o", "key").agg(F.sum("n").alias("n"))
    table = rows.toArrow()
    return Model.learn(table, order) if table.num_rows else None


def predict(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row; with carry, the columns of docs, then lang_pred and score.

    Columns of docs may have these names too: they are told apart by their places.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    id_at, text_at = names[docs.columns.index(id_column)], names[docs.columns.index(text_column)]
    kept = names if carry else []
    named = flat.select(*kept, flat[id_at].alias("__id"), flat[text_at].cast("string").alias("__text"))
    sent = ship(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts = batch["__text"].to_pylist()
            lettered = np.array([own is not None and has_letter(t) for t in texts], bool)
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = np.flatnonzero(lettered)
            if len(rows):
                bits = own.lengths([texts[i].encode() for i in rows])
                best = bits.argmin(1)
                with np.errstate(under="ignore"):
                    scores[rows] = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
                for i, b in zip(rows, best):
                    langs[i] = own.languages[b]
            columns = [batch[c] for c in kept] or [batch["__id"]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores)], [*(kept or ["__id"]), "__lang", "__score"])

    fields = [T.StructField(c, named.schema[c].dataType) for c in (kept or ["__id"])]
    found = named.mapInArrow(run, T.StructType([*fields, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())]))
    if carry:
        return found.toDF(*docs.columns, "lang_pred", "score")
    return found.select(F.col("__id").alias("doc_id"), held_out(F.col("__id")).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
