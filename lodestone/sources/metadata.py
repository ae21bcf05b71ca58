"""Ingest edges: metadata JSON, transcript choice, id sources with a lower bound on dates."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition
from pyspark.sql.window import Window

from lodestone.functions.text import iso_date

RAW = "id string, channel_id string, channel string, channel_url string, title string, webpage_url string, description string, duration double, upload_date string, view_count long, tags array<string>, language string"


def parse_metadata(raw: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(videos, channels, rejected) of rows with metadata JSON; rejected holds what isn't JSON with an id."""
    parsed = raw.select(column, F.from_json(column, RAW).alias("m"))
    good = F.col("m.id").isNotNull()
    ok = parsed.filter(good).select("m.*")
    videos = ok.select(F.col("id").alias("video_id"), F.coalesce("channel_id", F.lit("")).alias("channel_id"), F.coalesce("title", F.lit("")).alias("title"), F.col("webpage_url").alias("url"), F.substring(F.coalesce("description", F.lit("")), 1, 500).alias("description"), F.coalesce(F.col("duration").cast("int"), F.lit(0)).alias("duration_seconds"), F.try_to_date(iso_date(F.col("upload_date"))).alias("upload_date"), F.coalesce("view_count", F.lit(0)).alias("view_count"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("language", F.lit("en")).alias("language_iso"))
    channels = ok.filter(F.col("channel_id").isNotNull()).groupBy("channel_id").agg(F.max("channel").alias("name"), F.max("channel_url").alias("url")).withColumn("category", F.lit("UNCLASSIFIED"))
    return videos, channels, parsed.filter(~good).select(column)


def choose_transcript(candidates: DataFrame) -> DataFrame:
    """One transcript a video of (video_id, language, manual, text): manual English, generated English, manual, generated; by language then."""
    english = F.col("language").startswith("en")
    rank = F.when(english & F.col("manual"), 0).when(english, 1).when(F.col("manual"), 2).otherwise(3)
    w = Window.partitionBy("video_id").orderBy("rank", "language")
    best = candidates.withColumn("rank", rank).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return best.select("video_id", "language", "manual", "text", (~F.col("language").startswith("en")).alias("needs_translation"))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ListingReader(DataSourceReader):
    """Reads JSON-lines listings; a bound on upload_date or an id is applied while reading."""

    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options["paths"].split(",") if p]
        self.after: str | None = None
        self.id: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("upload_date",):
                self.after = max(self.after or "", str(f.value))
            elif isinstance(f, EqualTo) and f.attribute == ("video_id",):
                self.id = str(f.value)
            yield f  # Spark checks again: the source only reads less

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as f:
            for line in f:
                try:
                    row = json.loads(line)
                except ValueError:
                    continue
                date = str(row.get("upload_date") or "")
                date = f"{date[:4]}-{date[4:6]}-{date[6:]}" if len(date) == 8 and date.isdigit() else date
                if (self.after and date < self.after) or (self.id and row.get("id") != self.id):
                    continue
                yield (row.get("id"), row.get("title"), row.get("channel_id"), date)


class ListingSource(DataSource):
    """spark.read.format('vault_listing').option('paths', 'a.jsonl,b.jsonl'): one partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "vault_listing"

    def schema(self) -> str:
        return "video_id string, title string, channel_id string, upload_date string"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)
