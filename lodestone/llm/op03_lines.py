"""Line dedup by winnowing over line hashes.

The hashes of a text's lines (blank lines apart) are winnowed: of each window of `run`
consecutive lines the line with the least hash is a fingerprint, so every repeated run of
`run` lines or more shares a fingerprint at the same place; a line of `words` words or more is
a run in itself and always one. Fingerprints are counted over all blocks; where one repeats,
the match is extended both ways to all runs that hold it; the place of a run is joined with the
first place of the same lines, and every later place loses them. Runs that overlap merge into
maximal ones.

So a line goes if it lies in a run of `run` lines that also starts earlier, or if it has
`words` words and stands earlier too. Earlier is by document id, then by line. Lines are
compared without the white space around them, by 64-bit hashes.

Defined results: a null text stays null and has no lines; blank lines stay and are skipped in
runs; a null id comes after all others; repeated rows are documents of their own, the first of
them stays; an empty table gives an empty result; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm import shared
from lodestone.llm.words import U, mix

RUN, WORDS = 2, 50
_LAST = np.iinfo(np.int64).max


class Lines:
    """Lines of a block: hash, length in words, row and number of each line that isn't blank."""

    def __init__(self, table: pa.Table, run: int, words: int):
        self.texts = table["text"].to_pylist()
        hashes, rows, numbers, long_ = [], [], [], []
        for row, text in enumerate(self.texts):
            for number, line in enumerate((text or "").split("\n")):
                if line := line.strip():
                    hashes.append(xxhash.xxh64_intdigest(line, 1))
                    rows.append(row)
                    numbers.append(number)
                    long_.append(len(line) >= 2 * words - 1 and len(line.split()) >= words)
        self.hash = mix(np.array(hashes, np.uint64))
        self.row, self.number, self.long = np.array(rows, np.int64), np.array(numbers, np.int64), np.array(long_, bool)
        ids = table["doc_id"].cast(pa.int64()).fill_null(_LAST).to_numpy()
        self.doc = ids[self.row] if len(self.row) else np.zeros(0, np.int64)
        n = len(self.hash)
        self.run = run
        # starts of runs: `run` lines of one text
        self.start = np.flatnonzero(self.row[: n - run + 1] == self.row[run - 1 :]) if n >= run else np.zeros(0, np.int64)
        span = self.start[:, None] + np.arange(run)
        pick = span[np.arange(len(span)), self.hash[span].argmin(1)] if len(span) else self.start
        self.print = np.unique(np.concatenate((pick, np.flatnonzero(self.long))))

    def runs(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first line and length of the runs that hold a repeated fingerprint; repeated: a mask of lines."""
        sums = np.concatenate(([0], np.cumsum(repeated)))
        start = self.start[sums[self.start + self.run] > sums[self.start]]
        value = np.zeros(len(start), np.uint64)
        for k in range(self.run):
            value = mix(value * U(31) + self.hash[start + k] + U(1))
        alone = np.flatnonzero(self.long & repeated)
        return np.concatenate((value, mix(self.hash[alone] ^ U(0x5BD1E995)))), np.concatenate((start, alone)), np.concatenate((np.full(len(start), self.run), np.ones(len(alone), np.int64)))


def _repeated(_: list[int], messages: list[bytes]) -> list[bytes]:
    from lodestone.llm.op04_substrings import _counted

    return _counted(_, messages)


def _first(blocks: list[int], messages: list[bytes]) -> list[bytes]:
    """One bit for each run: whether this block holds its first place."""
    parts = [shared.split_parts(m) for m in messages]
    values = [shared.unsqueeze_sorted(p[0]) for p in parts]
    docs = np.concatenate([shared.unsqueeze(p[1], "<i8") for p in parts])
    lines = np.concatenate([shared.unsqueeze(p[2], "<i8") for p in parts])
    every = np.concatenate(values)
    source = np.repeat(np.arange(len(values)), [len(v) for v in values])
    order = np.lexsort((source, lines, docs, every))
    first = np.ones(len(order), bool)
    first[1:] = every[order][1:] != every[order][:-1]
    answer = np.empty(len(order), bool)
    answer[order] = first
    return [np.packbits(a).tobytes() for a in np.split(answer, np.cumsum([len(v) for v in values])[:-1])]


def _bits(replies: dict[int, bytes], ranked: np.ndarray, buckets: int) -> np.ndarray:
    out = np.zeros(len(ranked), bool)
    for bucket, part in shared.bucket_slices(ranked, buckets):
        out[part] = np.unpackbits(np.frombuffer(replies[bucket], np.uint8), count=part.stop - part.start)
    return out


def dedup_lines(docs: DataFrame, run: int = RUN, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs with their text after the deletions, and n_lines and n_removed (lines that aren't blank)."""
    if run < 2 or words < 1:
        raise ValueError("a run has two lines at least, a long line one word")
    buckets = shared.partitions(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_at, text_at = docs.columns.index(id_column), docs.columns.index(text_column)
    flat = docs.toDF(*names)
    flat = flat.select(*names, flat[names[id_at]].cast("long").alias("doc_id"), flat[names[text_at]].cast("string").alias("text"))
    blocks = shared.pack(flat, flat.columns, "lines")

    def prints(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        lines = Lines(table, run, words)
        ranked, counts = np.unique(lines.hash[lines.print], return_counts=True)
        for bucket, part in shared.bucket_slices(ranked, buckets):
            yield bucket, shared.join_parts(shared.squeeze_sorted(ranked[part]), np.packbits(counts[part] > 1).tobytes())

    def repeated(lines: Lines, replies: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ranked, back = np.unique(lines.hash[lines.print], return_inverse=True)
        mask = np.zeros(len(lines.hash), bool)
        mask[lines.print] = _bits(replies, ranked, buckets)[back]
        return lines.runs(mask)

    def places(table: pa.Table, replies: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        lines = Lines(table, run, words)
        value, start, _ = repeated(lines, replies)
        order = np.lexsort((lines.row[start], lines.number[start], lines.doc[start], value))
        ranked, at = np.unique(value[order], return_index=True)
        first = start[order][at]
        for bucket, part in shared.bucket_slices(ranked, buckets):
            yield bucket, shared.join_parts(shared.squeeze_sorted(ranked[part]), shared.squeeze(lines.doc[first[part]]), shared.squeeze(lines.number[first[part]]))

    def finish(table: pa.Table, given: dict[int, bytes]) -> pa.Table:
        own = {b: r for b, r in given.items() if b < buckets}
        later = {b - buckets: r for b, r in given.items() if b >= buckets}
        lines = Lines(table, run, words)
        value, start, size = repeated(lines, own)
        order = np.lexsort((lines.row[start], lines.number[start], lines.doc[start], value))
        ranked, at = np.unique(value[order], return_index=True)
        stays = np.zeros(len(start), bool)
        stays[order[at]] = _bits(later, ranked, buckets)
        marks = np.zeros(len(lines.hash) + 1, np.int64)
        np.add.at(marks, start[~stays], 1)
        np.subtract.at(marks, start[~stays] + size[~stays], 1)
        gone = np.cumsum(marks[:-1]) > 0
        n_lines = np.bincount(lines.row, minlength=table.num_rows)
        removed = np.bincount(lines.row[gone], minlength=table.num_rows)
        texts = list(lines.texts)
        cuts = np.searchsorted(lines.row, np.arange(table.num_rows + 1))
        for row in np.flatnonzero(removed).tolist():
            mine = slice(cuts[row], cuts[row + 1])
            out = set(lines.number[mine][gone[mine]].tolist())
            texts[row] = "\n".join(x for i, x in enumerate(texts[row].split("\n")) if i not in out)
        columns = {c: table[c] for c in names} | {names[text_at]: pa.array(texts, pa.string())}
        return pa.table(columns | {"n_lines": pa.array(n_lines, pa.int64()), "n_removed": pa.array(removed, pa.int64())})

    one = shared.written(shared.exchange(shared.emitted(blocks, prints), _repeated), "prints")
    two = shared.exchange(shared.reemitted(blocks, one, places), _first)
    both = one.union(two.selectExpr("block", f"bucket + {buckets} as bucket", "reply"))
    fields = [T.StructField(n, T.StringType() if i == text_at else f.dataType) for i, (n, f) in enumerate(zip(names, docs.schema.fields))]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return shared.gathered(blocks, both, finish, schema).toDF(*docs.columns, "n_lines", "n_removed")


def brute_force(rows: list[tuple[int | None, str | None]], run: int, words: int) -> list[tuple[int, int, str | None]]:
    """(n_lines, n_removed, text) of each row, by dictionaries of whole runs. Rows in the order of their ids."""
    kept, seen_runs, seen_lines = [], {}, {}
    split = [[(i, x.strip()) for i, x in enumerate((t or "").split("\n")) if x.strip()] for _, t in rows]
    for d, lines in enumerate(split):
        for i in range(len(lines) - run + 1):
            seen_runs.setdefault(tuple(x for _, x in lines[i : i + run]), (d, i))
        for i, (_, x) in enumerate(lines):
            if len(x.split()) >= words:
                seen_lines.setdefault(x, (d, i))
    for d, ((_, text), lines) in enumerate(zip(rows, split)):
        out = set()
        for i in range(len(lines) - run + 1):
            if seen_runs[tuple(x for _, x in lines[i : i + run])] != (d, i):
                out |= {n for n, _ in lines[i : i + run]}
        out |= {n for i, (n, x) in enumerate(lines) if x in seen_lines and seen_lines[x] != (d, i)}
        kept.append((len(lines), len(out), text and "\n".join(x for n, x in enumerate(text.split("\n")) if n not in out)))
    return kept
