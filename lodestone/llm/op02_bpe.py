"""BPE encoding and decoding by a distinct-word table.

Words are split in Spark; each distinct word reaches one bucket, is encoded there once by the
tokenizers library, and its ids return to the blocks that asked, where they are joined back by
position. Decoding looks each id up in the id-to-piece table and joins the pieces' bytes.

A word is a run of non-space characters with the one space before it, if any. A byte-level
BPE with the usual pattern (contractions, letters, numbers, others, white space) never makes a
token over the end of such a word, so ids of words joined in order are the ids of the text.
White space apart from that (line ends, several spaces) is encoded by the block itself. The
vocabulary's added tokens are cut out first, as the library does, so that each stretch between
them is encoded by itself and white space before one is white space at an end. A stretch with
white space other than ASCII's is encoded whole by the library.

Defined results: a null text is empty and has no ids; repeated rows are encoded alike, each
for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lodestone.llm import shared
from lodestone.ship import ship

# Fixed pattern: words with the space before them, then white space as the usual byte-level pattern cuts it.
_UNITS = re.compile(r" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]")
#: White space outside ASCII's usual kinds, as the pattern has it.
_ODD_SPACE = [c for c in map(chr, range(0x10000)) if c.isspace() and c not in " \t\n\r\x0b\x0c"]
#: What keeps a text from being words apart by single spaces and line ends.
_OTHER_SPACE = ["\t", "\r", "\x0b", "\x0c", "  ", " \n", "\n ", "\n\n"]
_LOADED: dict[str, Encoder] = {}


def added_tokens(path: str) -> re.Pattern[str] | None:
    """Finds the added tokens of a vocabulary, the longest first; None if there are none."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t.get(flag) for t in found for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take the white space beside them, or whole words only, are not supported")
    names = sorted((t["content"] for t in found), key=lambda x: (-len(x), x))
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


def _stretches(texts: list[str], added: re.Pattern[str] | None) -> Iterator[str]:
    """The parts of texts between added tokens."""
    for text in texts:
        if added is None or not added.search(text):
            yield text
        else:
            yield from added.split(text)[0::2]


def _alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """A byte-level BPE of the tokenizers library: distinct words in, ids out; ids in, text out."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        alphabet = _alphabet()
        self.pieces: list[bytes] = [b""] * size
        for piece, i in [*spec["model"]["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            known = all(c in alphabet for c in piece)
            self.pieces[i] = bytes(alphabet[c] for c in piece) if known else piece.encode()
        self.added: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.opens = np.array([p[:1] == b" " for p in self.pieces])
        self.decimals = [str(i) for i in range(size)]
        self.newline = self.ids("\n")

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _LOADED:
            _LOADED[path] = Encoder(path)
        return _LOADED[path]

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def many(self, words: list[str], chunk: int = 500) -> list[np.ndarray]:
        """Ids of each word. Many words go into one text: a word that begins with a space opens with the
        only token that holds one; other words are set apart by line ends, whose token is theirs alone."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        spaced = [i for i, w in enumerate(words) if w[:1] == " "]
        bare = [i for i, w in enumerate(words) if w[:1] != " "]
        single = len(self.newline) == 1
        for rows, glue in ((spaced, ""), (bare, "\n")):
            for k in range(0, len(rows), chunk):
                part = rows[k : k + chunk]
                ids = np.array(self.ids(glue.join(words[i] for i in part)), np.uint32)
                if glue:
                    cuts = np.flatnonzero(ids == self.newline[0]) if single else []
                    runs = [r[n > 0 :] for n, r in enumerate(np.split(ids, cuts))]
                else:
                    runs = np.split(ids, np.flatnonzero(self.opens[ids])[1:])
                if len(runs) != len(part) or not all(map(len, runs)):
                    runs = [np.array(self.ids(words[i]), np.uint32) for i in part]
                for i, run in zip(part, runs):
                    out[i] = run
        return out

    def both(self, ids: list[int]) -> tuple[str, bytes]:
        """ids in decimal, and the bytes of their pieces."""
        if len(ids) == 1:
            return self.decimals[ids[0]], self.pieces[ids[0]]
        return ",".join([self.decimals[i] for i in ids]), b"".join([self.pieces[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def _odd(text: str) -> bool:
    """Whether there is white space that words are not cut at."""
    return any(c in text for c in (_ODD_SPACE[:4] if text.isascii() else _ODD_SPACE))


def _plain(text: str) -> bool:
    """Single spaces and line ends between words only."""
    return not any(c in text for c in _OTHER_SPACE) and text[:1] not in ("", " ", "\n") and text[-1] not in " \n"


def _distinct(texts: Iterator[str]) -> tuple[set[str], set[str]]:
    """Words without and with a space before them."""
    bare: set[str] = set()
    spaced: set[str] = set()
    for text in texts:
        if not text or _odd(text):
            continue
        if _plain(text):
            for line in text.split("\n"):
                words = line.split(" ")
                bare.add(words[0])
                spaced.update(words[1:])
        else:
            for unit in _UNITS.findall(text):
                if unit[0] == " " and not unit.isspace():
                    spaced.add(unit[1:])
                elif not unit.isspace():
                    bare.add(unit)
    return bare, spaced


def _keys(bare: set[str], spaced: set[str], buckets: int) -> dict[int, list[str]]:
    found: dict[int, list[str]] = {}
    for word in [*bare, *(" " + w for w in spaced)]:
        found.setdefault(zlib.crc32(word.encode()) % buckets, []).append(word)
    return {bucket: sorted(words) for bucket, words in sorted(found.items())}


def encode_documents(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, ids_sha256, decoded, decoded_sha256) of each row."""
    wanted = "ids", "decoded"
    return _encoded(docs, tokenizer, id_column, text_column, wanted)


def encode_digests(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As encode_documents, without ids and decoded texts."""
    return _encoded(docs, tokenizer, id_column, text_column, ())


def _encoded(docs: DataFrame, path: str, id_column: str, text_column: str, wanted: tuple[str, ...]) -> DataFrame:
    named = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))
    buckets = shared.partitions(docs.sparkSession)
    blocks = shared.pack(named, ["doc_id", "text"], "words")
    added = added_tokens(path)

    def emit(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        for bucket, words in _keys(*_distinct(_stretches(table["text"].fill_null("").to_pylist(), added)), buckets).items():
            yield bucket, zstandard.compress("\n".join(words).encode(), 3)

    def answer(_: list[int], messages: list[bytes]) -> list[bytes]:
        asked = [zstandard.decompress(m).decode().split("\n") for m in messages]
        every = sorted(set().union(*asked))
        ids = dict(zip(every, Encoder.of(path).many(every)))
        replies = []
        for words in asked:
            own = [ids[w] for w in words]
            lengths = np.fromiter(map(len, own), np.uint32, len(own))
            replies.append(shared.join_parts(shared.squeeze(lengths), shared.squeeze(np.concatenate(own).astype(np.uint32))))
        return replies

    def finish(table: pa.Table, replies: dict[int, bytes]) -> pa.Table:
        encoder = Encoder.of(path)
        texts = table["text"].fill_null("").to_pylist()
        # of each distinct word its ids in decimal and, by the id-to-piece table, its bytes: both are joined back by position
        bare: dict[str, str] = {}
        spaced: dict[str, str] = {}
        bare_bytes: dict[str, bytes] = {}
        spaced_bytes: dict[str, bytes] = {}
        for bucket, words in _keys(*_distinct(_stretches(texts, added)), buckets).items():
            lengths, ids = (shared.unsqueeze(p, "<u4") for p in shared.split_parts(replies[bucket]))
            own, ends = ids.tolist(), np.cumsum(lengths, dtype=np.int64).tolist()
            for word, a, b in zip(words, [0, *ends], ends):
                decimal, data = encoder.both(own[a:b])
                if word[:1] == " ":
                    spaced[word[1:]], spaced_bytes[word[1:]] = decimal, data
                else:
                    bare[word], bare_bytes[word] = decimal, data
        blank: dict[str, tuple[str, bytes]] = {}

        def of(unit: str) -> tuple[str, bytes]:
            if not unit.isspace():
                return (spaced[unit[1:]], spaced_bytes[unit[1:]]) if unit[0] == " " else (bare[unit], bare_bytes[unit])
            if unit not in blank:
                blank[unit] = encoder.both(encoder.ids(unit))
            return blank[unit]

        newline, line_end = encoder.both(encoder.newline)
        newline = f",{newline},"

        def stretch(text: str) -> tuple[str, bytes]:
            if not text:
                return "", b""
            if _odd(text):
                return encoder.both(encoder.ids(text))
            if _plain(text):
                decimals, data = [], []
                for line in text.split("\n"):
                    first, *rest = line.split(" ")
                    decimals.append(",".join([bare[first], *map(spaced.__getitem__, rest)]))
                    data.append(b"".join([bare_bytes[first], *map(spaced_bytes.__getitem__, rest)]))
                return newline.join(decimals), line_end.join(data)
            parts = [of(unit) for unit in _UNITS.findall(text)]
            return ",".join([d for d, _ in parts]), b"".join([x for _, x in parts])

        columns: dict[str, list] = {c: [] for c in ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")}
        for text in texts:
            if added is None or not added.search(text):
                decimals, data = stretch(text)
            else:
                parts = [encoder.both([encoder.added[part]]) if n % 2 else stretch(part) for n, part in enumerate(added.split(text))]
                decimals, data = ",".join([d for d, _ in parts if d]), b"".join([x for _, x in parts])
            decoded = data.decode("utf-8", "replace")
            columns["n_tokens"].append(decimals.count(",") + 1 if decimals else 0)
            columns["ids_sha256"].append(hashlib.sha256(decimals.encode()).hexdigest())
            columns["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            if wanted:
                columns["ids"].append(list(map(int, decimals.split(","))) if decimals else [])
                columns["decoded"].append(decoded)
        out = {"doc_id": table["doc_id"], "n_tokens": pa.array(columns["n_tokens"], pa.int64()), "ids_sha256": pa.array(columns["ids_sha256"], pa.string()), "decoded_sha256": pa.array(columns["decoded_sha256"], pa.string())}
        if wanted:
            out |= {"ids": pa.array(columns["ids"], pa.list_(pa.int32())), "decoded": pa.array(columns["decoded"], pa.string())}
        return pa.table(out)

    replies = shared.exchange(shared.emitted(blocks, emit), answer)
    kind = named.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if wanted else "")
    return shared.gathered(blocks, replies, finish, schema)


def decode_ids(ids: DataFrame, tokenizer: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with token ids, by the id-to-piece table of the vocabulary (its size is the vocabulary's)."""
    ship(ids.sparkSession)
    named = ids.select(ids[id_column].alias("doc_id"), ids[ids_column].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            texts = [encoder.decode(x) if x is not None else None for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return named.mapInArrow(run, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, text string")
