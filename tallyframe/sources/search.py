"""Search providers as a Spark data source: each provider maps its answers to one schema; a failed provider gives a row
with its error instead of ending the query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "provider string, id string, title string, url string, published string, summary string, error string"
Fetch = Callable[[str], Iterator[dict]]


class _Part(InputPartition):
    def __init__(self, provider: str):
        self.value = provider


class _Reader(DataSourceReader):
    def __init__(self, providers: dict[str, Fetch], query: str, most: int):
        self.providers, self.query, self.most = providers, query, most

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.providers]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name = partition.value
        try:
            for n, hit in enumerate(self.providers[name](self.query)):
                if n == self.most:
                    return
                yield name, hit.get("id"), hit.get("title"), hit.get("url"), hit.get("published"), hit.get("summary"), None
        except Exception as e:
            yield name, None, None, None, None, None, f"{type(e).__name__}: {e}"


def register(spark: SparkSession, providers: dict[str, Fetch], name: str = "search", per_provider: int = 50) -> None:
    """Registers spark.read.format(name).option("query", ...): one task per provider. providers: name to a function
    from a query to hits (an injected transport, so that tests need no network)."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(providers, self.options.get("query", ""), per_provider)

    spark.dataSource.register(Source)
