"""A data source of pages and search results behind a fetching function.

``fetcher`` is ``module:function`` and maps a key (URL or query) to text; it is
imported where the partition is read.  Without one, keys come back without text.
"""

from __future__ import annotations

import importlib

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE_LIMIT = 50_000


class _Keys(InputPartition):
    def __init__(self, keys: list[str]):
        self.keys = keys


class FetchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.keys = [k for k in options.get("keys", "").split("\n") if k]
        self.fetcher = options.get("fetcher")
        self.parts = max(1, int(options.get("partitions", "4")))

    def partitions(self):
        return [_Keys(self.keys[i :: self.parts]) for i in range(self.parts) if self.keys[i :: self.parts]] or [_Keys([])]

    def read(self, partition):
        fetch = None
        if self.fetcher:
            module, _, name = self.fetcher.partition(":")
            fetch = getattr(importlib.import_module(module), name)
        for key in partition.keys:
            text, error = None, None
            try:
                text = fetch(key)[:PAGE_LIMIT] if fetch else None
                error = None if fetch else "no fetcher"
            except Exception as e:  # one page's failure is a row
                error = type(e).__name__
            yield key, text, error


class FetchSource(DataSource):
    """spark.read.format("millrace_fetch").option("keys", ...).option("fetcher", "module:function")"""

    @classmethod
    def name(cls):
        return "millrace_fetch"

    def schema(self):
        return "key string, text string, error string"

    def reader(self, schema):
        return FetchReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(FetchSource)


def placeholder_results(query: str) -> list[tuple[str, str, float]]:
    """(title, url, score) of an engine that is not connected."""
    return [(f"Results for {query}", "https://doc.rust-lang.org/error_codes/", 0.5)]
