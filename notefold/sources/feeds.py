"""Paginated feeds as a data source: pages are fetched on the executors, one task per feed.

The fetching function is the caller's and is shipped with the source: ``fetch(feed, cursor)`` gives
``(items, next cursor)``. Reading stops at an empty page, a missing cursor, or one seen before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str, str], tuple[list[tuple[str, str]], str | None]]


class _Feed(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


def _reader(fetch: Fetch, feeds: list[str], most: int) -> type[DataSource]:
    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [_Feed(f) for f in feeds]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            cursor, seen, position = "", set(), 0
            while cursor not in seen:
                seen.add(cursor)
                items, following = fetch(partition.name, cursor)
                for key, payload in items:
                    if most and position >= most:
                        return
                    yield partition.name, position, key, payload
                    position += 1
                if not items or not following:
                    return
                cursor = following

    class PagedFeed(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged_feed"

        def schema(self) -> str:
            return "feed string, position int, id string, payload string"

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return PagedFeed


def paged(spark: SparkSession, fetch: Fetch, feeds: list[str], most: int = 0) -> DataFrame:
    """``feed, position, id, payload`` of feeds, each id once at its first place; ``most`` items a feed, 0 for all."""
    spark.dataSource.register(_reader(fetch, feeds, most))
    rows = spark.read.format("paged_feed").load()
    first = rows.groupBy("feed", "id").agg(F.min(F.struct("position", "payload")).alias("x"))
    return first.select("feed", "x.position", "id", "x.payload")
