"""Token-ID output: raw id payloads in shard files with a minimal perfect hash index.

A store is a folder of shard files. A file is a shard and one line end
(the files go through Spark's text writer, so they land in any store that Spark writes to and
only committed tasks count). A shard:

    8 bytes   magic LODETOK1
    4 bytes   length of the header, little-endian
    header    JSON: partition, shard, n_docs, n_keys, dtype, n_ids, bits (sizes of hash levels), sections
    doc_ids   int64, ascending; absent ones first (mask section)
    offsets   uint64, n_docs + 1, into the ids of the shard
    levels    bits of the minimal perfect hash, ranks before each 64-bit word
    slots     uint32 fingerprint and uint32 document number of each key
    ids       uint16 or uint32 token ids, back to back

The minimal perfect hash has levels of twice as many bits as keys: a key that is alone at its
place of a level is settled there, the others go on. A key's slot is the rank of its bit; the
slot's fingerprint tells a stored key from a foreign one, and its document number gives offset
and length. A lookup costs one expected pass over about two levels, whatever the shard's size.

Documents are range-partitioned and sorted by id, so that shards follow one another in ascending
order. Texts are encoded by the tokenizers library, each worker keeping ids of parts of words it has
met in a table of fixed size, by 64-bit hashes (of n parts in the table, a new one is taken for
another with a chance of n / 2**64); words are set apart at ASCII white space, over which the
pre-tokenizer never reaches. Memory of a task is bounded by slices of 1 MB of text, a shard's ids
and the longest text's ids; a long text is encoded in pieces.

Defined results: a null text is empty and holds the end id alone; a null id comes first and isn't
indexed; rows that repeat an id follow each other, and a shard's index gives the first of them and
their number in the shard; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import json
import mmap
import os
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import shared
from lodestone.llm.words import LOWER, U, Words, mix, range_hashes
from lodestone.ship import ship

MAGIC = b"LODETOK1"
SHARD_IDS = 4 << 20
#: Bytes after which a text that fills a slice alone is encoded in pieces, cut at spaces.
LONG = 2 << 20
_ENCODERS: dict[str, WordEncoder] = {}
#: By byte: letters, for all but ASCII taken to be such until the unit is met; punctuation of ASCII but the apostrophe.
_LETTERS = np.array([chr(i).isalpha() or i > 0x7F for i in range(256)])
_MARKS = np.array([chr(i) in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" for i in range(256)])


class WordEncoder:
    """Ids of texts by units. For vocabularies whose pre-tokenizer drops white space and whose words end in </w>.

    A word of letters and then punctuation is two units, the letters (A-Z in lower case) and the punctuation; any other
    word is one. Units met before are looked up by 64-bit hashes in a table of fixed size, whose ids are kept up to a bound.
    """

    #: Places of the table, 15 bytes each; ids kept, after which the table starts anew.
    SLOTS, KEPT = 1 << 20, 6 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._anew()

    def _anew(self) -> None:
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.at = np.zeros(self.SLOTS, np.uint32)
        self.size = np.zeros(self.SLOTS, np.uint16)
        self.open = np.zeros(self.SLOTS, bool)
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0

    @staticmethod
    def of(path: str) -> WordEncoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = WordEncoder(path)
        return _ENCODERS[path]

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _learned(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each unit begin, how many they are, and whether punctuation after it may join its last part.

        Units of letters go many into one text: each has one pre-token at least and each pre-token one end, so that as
        many ends as units cut them right. A unit that isn't one run of letters once normalised is open at its end.
        """
        begins, sizes, open_ = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), np.ones(len(units), bool)

        def alone(i: int) -> None:
            ids = self._encoded(units[i])
            begins[i], sizes[i] = self._append(ids), len(ids)
            open_[i] = not units[i].isalpha() or np.count_nonzero(self.ends[ids]) != 1

        plain = [i for i, x in enumerate(units) if x.isalpha() and (x.isascii() or x.lower().isalpha())]
        for k in range(0, len(plain), 500):
            part = plain[k : k + 500]
            ids = self._encoded(" ".join([units[i] for i in part]))
            cuts = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))
            if len(cuts) == len(part) + 1 and cuts[-1] == len(ids):
                begins[part], sizes[part], open_[part] = self._append(ids) + cuts[:-1], np.diff(cuts), False
            else:
                for i in part:
                    alone(i)
        own = set(plain)
        for i in range(len(units)):
            if i not in own:
                alone(i)
        return begins, sizes, open_

    def _append(self, ids: np.ndarray) -> int:
        """Puts ids into the store; where they begin."""
        begin = self.used
        if begin + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(ids), len(self.ids)), self.dtype)))
        self.ids[begin : begin + len(ids)] = ids
        self.used += len(ids)
        return begin

    def encode(self, texts: list[bytes], end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts back to back, each followed by `end`, and how many each has."""
        if self.used > self.KEPT:
            self._anew()
        words = Words(texts)
        n, data = len(words.starts), words.data
        # heads: the letters that a word begins with; a word is split there if only punctuation follows
        stops = np.append(np.flatnonzero(~_LETTERS[data]), len(data))
        head = np.minimum(stops[np.searchsorted(stops, words.starts)], words.ends) if n else words.starts
        marks = np.concatenate(([0], np.cumsum(_MARKS[data], dtype=np.int32)))
        split = (head > words.starts) & (marks[words.ends] - marks[head] == words.ends - head)
        head = np.where(split, head, words.ends)
        lower = np.zeros(len(data) + 1, bool)
        lower[: n and words.ends[-1] + 1] = np.repeat(split, words.ends - words.starts + 1)
        data = np.where(lower[:-1], LOWER[data], data)
        tailed = np.flatnonzero(head < words.ends)
        starts, ends = np.concatenate((words.starts, head[tailed])), np.concatenate((head, words.ends[tailed]))
        keys = np.concatenate((range_hashes(data, words.starts, head), range_hashes(data, head[tailed], words.ends[tailed])))
        slot = (keys >> U(64 - self.SLOTS.bit_length() + 1)).astype(np.int64)
        at, size, open_ = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64), self.open[slot]
        missing = np.flatnonzero(self.keys[slot] != keys)
        if len(missing):
            new, first, inverse = np.unique(keys[missing], return_index=True, return_inverse=True)
            raw, some = data.tobytes(), missing[first]
            begins, sizes, flags = self._learned([raw[a:b].decode() for a, b in zip(starts[some].tolist(), ends[some].tolist())])
            at[missing], size[missing], open_[missing] = begins[inverse], sizes[inverse], flags[inverse]
            keep = sizes < 1 << 16
            place = slot[some][keep]
            self.keys[place], self.at[place], self.size[place], self.open[place] = new[keep], begins[keep], sizes[keep], flags[keep]
        joined = tailed[open_[tailed]]
        if len(joined):  # the whole word in place of its first unit
            raw = data.tobytes()
            for i in joined.tolist():
                whole = self._encoded(raw[words.starts[i] : words.ends[i]].decode())
                at[i], size[i] = self._append(whole), len(whole)
            size[n + np.flatnonzero(open_[tailed])] = 0
        # units in the order of the text
        place = np.arange(n)
        place[1:] += np.cumsum(head < words.ends)[:-1]
        order = np.empty(len(starts), np.int64)
        order[place], order[place[tailed] + 1] = np.arange(n), n + np.arange(len(tailed))
        at, size = at[order], size[order]
        done = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(at - done[:-1], size) + np.arange(done[-1])]
        edges = done[np.append(place, len(order))[words.first]]
        counts = np.diff(edges)
        if end:
            ids = np.insert(ids, np.repeat(edges[1:], len(end)), np.tile(np.array(end, self.dtype), len(counts)))
        return ids, counts + len(end)


def pieces(text: bytes, most: int) -> Iterator[bytes]:
    """A long text cut at spaces after `most` bytes each."""
    at = 0
    while len(text) - at > most and (cut := text.find(b" ", at + most)) >= 0:
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, with fingerprints."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        counts = np.bitwise_count(bits).astype(np.int64)
        self.rank = np.cumsum(counts) - counts

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(keys):
            size = max(64, -(-2 * len(keys) // 64) * 64)
            place = PerfectHash._place(keys, len(sizes), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            marks = np.zeros(size, bool)
            marks[place[alone]] = True
            sizes.append(size)
            levels.append(np.packbits(marks, bitorder="little").view("<u8"))
            keys = keys[~alone]
        return PerfectHash(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % U(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that no level holds. Foreign keys may get a slot: compare fingerprints."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        base = 0
        for level, size in enumerate(self.sizes):
            place = base + self._place(keys[left], level, size)
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            held = (self.bits[word] >> bit) & U(1) == 1
            below = np.bitwise_count(self.bits[word] & ((U(1) << bit) - U(1))).astype(np.int64)
            out[left[held]] = (self.rank[word] + below)[held]
            left = left[~held]
            base += size
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ U(0xA5A5A5A5A5A5A5A5)) >> U(32)).astype("<u4")


def pack_shard(partition: int, shard: int, doc_ids: pa.Array, lengths: np.ndarray, payload: np.ndarray) -> bytes:
    """A shard of documents in the order of their ids (absent ones first): lengths of their payloads, the ids of all of them."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype("<u8")
    absent = doc_ids.is_null().to_numpy(zero_copy_only=False)
    ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    keys, first, count = np.unique(ids[~absent], return_index=True, return_counts=True)
    keys, first = keys.view(np.uint64), first + int(absent.sum())
    table = PerfectHash.build(keys)
    slot = table.slots(keys)
    slots = np.zeros((len(keys), 3), "<u4")
    slots[slot, 0], slots[slot, 1], slots[slot, 2] = fingerprint(keys), first, count
    sections = [np.packbits(absent), ids, offsets, table.bits.astype("<u8"), slots, payload]
    header = json.dumps({"partition": partition, "shard": shard, "n_docs": len(ids), "n_keys": len(keys), "n_ids": int(offsets[-1]), "dtype": payload.dtype.str, "bits": table.sizes, "sections": [x.nbytes for x in sections]}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *sections])


class Shard:
    """One shard, opened over its bytes: constant-time access by document id."""

    def __init__(self, data: memoryview):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a shard")
        at = 12 + int.from_bytes(data[8:12], "little")
        self.header = json.loads(bytes(data[12:at]))
        parts = []
        for size in self.header["sections"]:
            parts.append(data[at : at + size])
            at += size
        self.size = at
        self.absent = np.unpackbits(np.frombuffer(parts[0], np.uint8), count=self.header["n_docs"]).astype(bool)
        self.doc_ids = np.frombuffer(parts[1], "<i8")
        self.offsets = np.frombuffer(parts[2], "<i8")
        self.hash = PerfectHash(self.header["bits"], np.frombuffer(parts[3], "<u8"))
        self.slots = np.frombuffer(parts[4], "<u4").reshape(-1, 3)
        self.ids = np.frombuffer(parts[5], self.header["dtype"])

    @staticmethod
    def all(content: bytes | memoryview) -> Iterator[Shard]:
        view, at = memoryview(content), 0
        while at < len(view):
            shard = Shard(view[at:])
            yield shard
            at += shard.size + 1

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first document of each id, -1 if the shard has none; how many documents have that id."""
        keys = keys.astype("<i8").view(np.uint64)
        slot = self.hash.slots(keys)
        if not len(self.slots):
            return slot, np.zeros(len(keys), np.int64)
        at = np.maximum(slot, 0)
        first = self.slots[at, 1].astype(np.int64)
        known = (slot >= 0) & (self.slots[at, 0] == fingerprint(keys)) & (self.doc_ids[first] == keys.view(np.int64))
        return np.where(known, first, -1), np.where(known, self.slots[at, 2].astype(np.int64), 0)

    def tokens(self, number: int) -> np.ndarray:
        return self.ids[self.offsets[number] : self.offsets[number + 1]]

    def get(self, doc_id: int) -> list[np.ndarray]:
        """Ids of each document with this id, without reading any other payload."""
        first, count = self.find(np.array([doc_id]))
        return [self.tokens(int(first[0]) + k) for k in range(int(count[0]))]


class TokenStore:
    """A store in a folder that this machine can map: keyed access touches a shard's index and one payload.

    The range of a key's shard is found by bisection over the shards' first ids, the document in it in constant time.
    """

    def __init__(self, folder: str):
        self.shards: list[Shard] = []
        for name in sorted(n for n in os.listdir(folder) if n.startswith("part-")):
            with open(os.path.join(folder, name), "rb") as f:
                if os.fstat(f.fileno()).st_size:
                    self.shards += Shard.all(memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))
        self.shards = sorted((x for x in self.shards if x.header["n_keys"]), key=lambda x: (x.header["partition"], x.header["shard"]))
        self.first = [int(x.doc_ids[x.absent.sum()]) for x in self.shards]

    def get(self, doc_id: int) -> list[np.ndarray]:
        """Ids of each document with this id; rows that repeat it may go on into the next shards."""
        at, found = max(0, bisect_left(self.first, doc_id) - 1), []
        while at < len(self.shards) and self.first[at] <= doc_id:
            found += self.shards[at].get(doc_id)
            at += 1
        return found


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encodes docs and writes a store of shards in ascending order of document ids, one shard a file.

    Rows that repeat an id follow each other in the order of their texts' hashes, over several partitions if they are many.
    """
    ship(docs.sparkSession)
    named = docs.select(docs[id_column].cast("long").alias("doc_id"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  pa.compute is a module of its own

        encoder = WordEncoder.of(tokenizer)
        end = [] if end_id is None else [end_id]
        partition, shard, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def cut() -> pa.RecordBatch:
            ids, lengths, payload = zip(*held)
            packed = pack_shard(partition, shard, pa.concat_arrays(ids), np.concatenate(lengths), np.concatenate(payload))
            return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["value"])

        for part in shared._sliced((b.select(["doc_id", "text"]) for b in batches), 1 << 20):
            texts = part["text"].cast(pa.binary()).to_pylist()
            if len(texts) == 1 and len(texts[0]) > LONG:
                encoded = [encoder.encode([x], [])[0] for x in pieces(texts[0], LONG)]
                ids = np.concatenate([*encoded, np.array(end, encoder.dtype)])
                lengths = np.array([len(ids)])
            else:
                ids, lengths = encoder.encode(texts, end)
            held.append((part["doc_id"].combine_chunks(), lengths, ids))
            size += len(ids)
            if size >= SHARD_IDS:
                yield cut()
                shard, held, size = shard + 1, [], 0
        if held:
            yield cut()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = named.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return ship(spark).read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content", "path")


def read_store(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(partition, shard, number, doc_id, place, n_tokens, ids_crc32, ids array<long>) of each document.

    place is the offset in the shard, found through the shard's index; ids_crc32 is of all ids as
    little-endian unsigned 32-bit integers.
    """
    names = ["partition", "shard", "number", "doc_id", "place", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                for shard in Shard.all(content.as_buffer()):
                    n = shard.header["n_docs"]
                    # every indexed document is reached by its key; the number within a run of equal ids is added
                    first, _ = shard.find(shard.doc_ids)
                    number = np.arange(n)
                    new = np.ones(n, bool)
                    new[1:] = (shard.doc_ids[1:] != shard.doc_ids[:-1]) | shard.absent[:-1]
                    start = np.maximum.accumulate(np.where(new, number, 0))
                    number = np.where(shard.absent, number, first + number - start)
                    if (number < 0).any():
                        raise ValueError("a document is not in its shard's index")
                    a, b = shard.offsets[number], shard.offsets[number + 1]
                    wide = shard.ids.astype("<u4")
                    crc = [zlib.crc32(wide[x:y]) for x, y in zip(a.tolist(), b.tolist())]
                    columns = [pa.array(np.full(n, shard.header["partition"]), pa.int64()), pa.array(np.full(n, shard.header["shard"]), pa.int64()), pa.array(number, pa.int64()), pa.array(shard.doc_ids, pa.int64(), mask=shard.absent), pa.array(a, pa.int64()), pa.array(b - a, pa.int64()), pa.array(crc, pa.int64())]
                    if ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(shard.offsets, pa.int32()), pa.array(wide.astype(np.int64))).take(pa.array(number)))
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = "partition long, shard long, number long, doc_id long, place long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    return _files(spark, path).mapInArrow(run, schema)


def with_starts(found: DataFrame) -> DataFrame:
    """read_store() with start: the ids of all documents before. Shards add up in their partition, partitions in one window of a row each."""
    sizes = found.groupBy("partition", "shard").agg(F.sum("n_tokens").alias("n"))
    to_here = Window.rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    whole = sizes.groupBy("partition").agg(F.sum("n").alias("n"))
    whole = whole.select("partition", earlier(to_here.orderBy("partition")).alias("ahead"))
    shards = sizes.select("partition", "shard", earlier(to_here.partitionBy("partition").orderBy("shard")).alias("before"))
    placed = shards.join(whole, "partition").select("partition", "shard", (F.col("ahead") + F.col("before")).alias("before"))
    return found.join(placed, ["partition", "shard"]).withColumn("start", F.col("before") + F.col("place"))


def index_store(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, last) of each shard that has documents with ids: to be kept beside a store, so that lookup() opens few files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, file in zip(batch["content"], batch["path"].to_pylist()):
                held = [x.doc_ids[~x.absent] for x in Shard.all(content.as_buffer()) if x.header["n_keys"]]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(held), pa.string()), pa.array([int(x[0]) for x in held], pa.int64()), pa.array([int(x[-1]) for x in held], pa.int64())], ["file", "first", "last"])

    return _files(spark, path).mapInArrow(run, "file string, first long, last long")


def lookup(spark: SparkSession, path: str, keys: list[int], index: DataFrame | None = None) -> DataFrame:
    """(doc_id, ids) of the documents with one of the given ids, by the shards' indexes; no other payload is decoded.

    With an index_store(), only the files whose range of ids holds a key are opened: a few for each key.
    """
    wanted = np.array(sorted(set(keys)), np.int64)
    if index is not None:
        asked = spark.createDataFrame([(int(k),) for k in wanted], "key long")
        files = [r.file for r in index.join(F.broadcast(asked), F.col("key").between(F.col("first"), F.col("last"))).select("file").distinct().collect()]
        if not files:
            return spark.createDataFrame([], "doc_id long, ids array<long>")
        store = ship(spark).read.format("binaryFile").load(files)
    else:
        store = _files(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                for shard in Shard.all(content.as_buffer()):
                    own = wanted
                    if shard.header["n_keys"]:
                        present = shard.doc_ids[~shard.absent]
                        own = wanted[(wanted >= present[0]) & (wanted <= present[-1])]
                    rows = [(int(k), t.tolist()) for k in own for t in shard.get(int(k))]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return store.mapInArrow(run, "doc_id long, ids array<long>")
