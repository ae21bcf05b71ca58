"""Discovery of ids as a stream: a source of listings with offsets, and each id once.

A listing is a file of JSON lines below a folder; new listings have names that sort after the old ones (such as a
folder for each scan). `vault_discovery` is their source: its offset is the last file that was taken (the high-water
mark), a batch takes at most `maxFiles` further files, and files are read in slices of bytes by the executors, through
any file system that pyarrow opens by URI. What was planned last is kept below `progress`, so that a restart, which asks
for the newest offset before it tells the present one, goes on from there; Spark's own log decides what is read.

`discovered` parses the lines, turns bad ones into rows of their own, drops ids that were seen within `memory`, leaves out
what is older than a channel's mark, and says which ids are new to the vault.
"""

from __future__ import annotations

import io
import json
import posixpath
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lodestone.functions.text import iso_date

#: Bytes of a slice of a file.
SLICE = 32 << 20
LINE = "id string, title string, channel_id string, upload_date string"


def _opened(path: str):
    """(file system, path in it) of a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _listings(folder: str) -> list[tuple[str, int]]:
    """(relative path, bytes) of the listings, in order; hidden files and markers aside."""
    from pyarrow import fs

    system, base = _opened(folder)
    found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    named = ((posixpath.relpath(f.path, base), f.size) for f in found if f.is_file)
    return sorted((n, s) for n, s in named if not any(p[:1] in "._" for p in n.split("/")))


class _Slice(InputPartition):
    def __init__(self, file: str, start: int, stop: int) -> None:
        self.file, self.start, self.stop = file, start, stop


def _slices(files: list[tuple[str, int]], size: int) -> list[_Slice]:
    found = [_Slice(name, at, min(at + size, length)) for name, length in files for at in range(0, length, size)]
    return found or [_Slice("", 0, 0)]  # a source has a partition at least


def _lines(folder: str, part: _Slice) -> Iterator[tuple[str, int, str]]:
    """(file, byte, line) of lines that begin within the slice."""
    if part.stop <= part.start:
        return
    system, base = _opened(folder)
    with io.BufferedReader(system.open_input_file(posixpath.join(base, part.file)), 1 << 20) as f:
        at = part.start
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1  # to the first line that begins here
        else:
            f.seek(0)
        while at < part.stop:
            line = f.readline()
            if not line:
                break
            if line.strip():
                yield part.file, at, line.decode("utf-8", "replace").rstrip("\r\n")
            at += len(line)


class ListingStream(DataSourceStreamReader):
    """Offsets are {"after": the last file taken}."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.progress = options["path"], options.get("progress")
        self.most, self.slice = int(options.get("maxFiles", "1000")), int(options.get("sliceBytes", SLICE))
        self.after: str | None = None

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        if self.after is None:
            self.after = self._planned()
        new = [name for name, _ in _listings(self.folder) if name > self.after][: self.most]
        return {"after": new[-1] if new else self.after}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # the engine has logged `end` before it plans the batch
        self.after = max(self.after or "", end["after"])
        self._plan(self.after)
        return _slices([f for f in _listings(self.folder) if start["after"] < f[0] <= end["after"]], self.slice)

    def read(self, partition: _Slice) -> Iterator[tuple]:
        return _lines(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass

    def _planned(self) -> str:
        if not self.progress:
            return ""
        system, base = _opened(self.progress)
        path = posixpath.join(base, "after.json")
        if not system.get_file_info(path).is_file:
            return ""
        with system.open_input_file(path) as f:
            return json.loads(f.read())["after"]

    def _plan(self, after: str) -> None:
        if self.progress:
            system, base = _opened(self.progress)
            system.create_dir(base, recursive=True)
            with system.open_output_stream(posixpath.join(base, "after.json.new")) as f:
                f.write(json.dumps({"after": after}).encode())
            system.move(posixpath.join(base, "after.json.new"), posixpath.join(base, "after.json"))


class ListingBatch(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.slice = options["path"], int(options.get("sliceBytes", SLICE))

    def partitions(self) -> list[InputPartition]:
        return _slices(_listings(self.folder), self.slice)

    def read(self, partition: _Slice) -> Iterator[tuple]:
        return _lines(self.folder, partition)


class DiscoverySource(DataSource):
    """spark.readStream.format('vault_discovery').option('progress', folder)[.option('maxFiles', n)][.option('sliceBytes', n)].load(folder); also for batches."""

    @classmethod
    def name(cls) -> str:
        return "vault_discovery"

    def schema(self) -> str:
        return "file string, at long, raw string"

    def reader(self, schema) -> ListingBatch:
        return ListingBatch(self.options)

    def streamReader(self, schema) -> ListingStream:
        return ListingStream(self.options)


def parsed(lines: DataFrame) -> DataFrame:
    """(file, at, video_id, title, channel_id, upload_date, problem, raw): a line that is no JSON object with an id has a problem instead."""
    m = F.from_json("raw", LINE)
    rows = lines.select("file", "at", m.alias("m"), "raw")
    name = F.trim(F.coalesce("m.id", F.lit("")))
    problem = F.when(F.get_json_object("raw", "$").isNull() | ~F.startswith(F.ltrim("raw"), F.lit("{")), "no_json").when(name == "", "no_id")
    kept = lambda c: F.when(problem.isNull(), c)
    return rows.select("file", "at", kept(name).alias("video_id"), kept(F.coalesce("m.title", F.lit(""))).alias("title"), kept(F.coalesce("m.channel_id", F.lit(""))).alias("channel_id"), kept(F.try_to_date(iso_date(F.col("m.upload_date")))).alias("upload_date"), problem.alias("problem"), kept_raw(problem))


def kept_raw(problem: Column) -> Column:
    """The line itself, of lines with a problem only."""
    return F.when(problem.isNotNull(), F.col("raw")).alias("raw")


def discovered(lines: DataFrame, videos: DataFrame | None = None, marks: DataFrame | None = None, memory: str = "30 days") -> DataFrame:
    """Rows of parsed() with is_new: each id once, of all that come within `memory` of one another (by the time they are read, so no row is late).

    videos (video_id): what the vault has. marks (channel_id, mark): rows with an upload date before their channel's mark are left out;
    take marks before the scan's channels are written, or a second scan sees nothing.
    Which of an id's lines is kept is not defined within a batch. Bad lines are kept, each for itself.
    """
    rows = parsed(lines)
    if marks is not None:
        known = marks.groupBy(F.col("channel_id").alias("__c")).agg(F.max("mark").alias("__mark"))
        old = F.coalesce(F.col("upload_date") < F.col("__mark"), F.lit(False))
        rows = rows.join(known, F.col("channel_id") == F.col("__c"), "left").filter(~old).drop("__c", "__mark")
    one = F.coalesce(F.concat(F.lit("v"), "video_id"), F.concat(F.lit("l"), "file", F.lit(":"), F.col("at").cast("string")))
    rows = rows.withColumn("__key", one)
    if lines.isStreaming:
        rows = rows.withColumn("__read", F.current_timestamp()).withWatermark("__read", memory).dropDuplicatesWithinWatermark(["__key"]).drop("__read")
    else:
        rows = rows.dropDuplicates(["__key"])
    rows = rows.drop("__key")
    if videos is None:
        return rows.withColumn("is_new", F.when(F.col("problem").isNull(), True))
    have = videos.select(F.col("video_id").alias("__v")).distinct().withColumn("__have", F.lit(True))
    out = rows.join(have, F.col("video_id") == F.col("__v"), "left")
    return out.withColumn("is_new", F.when(F.col("problem").isNull(), F.col("__have").isNull())).drop("__v", "__have")


def marks_of(videos: DataFrame) -> DataFrame:
    """(channel_id, mark): the newest upload date of each channel."""
    return videos.groupBy("channel_id").agg(F.max("upload_date").alias("mark"))
