"""Articles over HTTP: a mapper with an injected fetcher, and the same as a Spark data source.

A failed fetch is a row with ok = false and the reason, and never fails the task or the other entities.
"""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import quote_plus

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from weftable.functions.text import ARTICLE_URL

SCHEMA = "entity string, url string, ok boolean, body string, error string"


def http_fetch(url: str, timeout: float = 30) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


def url_of(entity: str, base: str = ARTICLE_URL) -> str:
    return base + quote_plus(entity.replace(" ", "_"), safe="*")


def fetched(entity: str, fetch: Callable[[str], str], base: str = ARTICLE_URL, tries: int = 1, wait: float = 1.0) -> tuple:
    """A failed request is tried again up to `tries` times in all, after `wait` seconds and twice as long each time."""
    url, error = url_of(entity, base), None
    for n in range(tries):
        try:
            return entity, url, True, fetch(url), None
        except Exception as e:  # any failure belongs to this entity alone
            error = f"{type(e).__name__}: {e}"
            if n + 1 < tries:
                time.sleep(wait * 2**n)
    return entity, url, False, None, error


def crawl(seeds: DataFrame, fetch: Callable[[str], str] = http_fetch, partitions: int | None = None, pause: float = 0.0, base: str = ARTICLE_URL, tries: int = 1, wait: float = 1.0) -> DataFrame:
    """Fetches each entity of `seeds`; `partitions` bounds how many requests run at once, `pause` spaces them."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for entity in pdf["entity"]:
                rows.append(fetched(entity, fetch, base, tries, wait))
                if pause:
                    time.sleep(pause)
            yield pd.DataFrame(rows, columns=["entity", "url", "ok", "body", "error"])

    dealt = seeds.select("entity")
    return (dealt.repartition(partitions, "entity") if partitions else dealt).mapInPandas(run, SCHEMA)


class _Slice(InputPartition):
    def __init__(self, entities: list[str]) -> None:
        self.entities = entities


class _Reader(DataSourceReader):
    def __init__(self, options, fetch) -> None:
        self.entities = [e for e in options.get("entities", "").split("\n") if e]
        self.base = options.get("base", ARTICLE_URL)
        self.parts = int(options.get("partitions", "4"))
        self.tries = int(options.get("tries", "1"))
        self.fetch = fetch

    def partitions(self) -> list[_Slice]:
        named = sorted(set(self.entities))
        return [_Slice(named[i :: self.parts]) for i in range(min(self.parts, len(named)))] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for e in partition.entities:
            yield fetched(e, self.fetch, self.base, self.tries)


class ArticleSource(DataSource):
    """spark.read.format("articles").option("entities", "A\\nB").load(), after spark.dataSource.register()."""

    fetch = staticmethod(http_fetch)

    @classmethod
    def name(cls) -> str:
        return "articles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, type(self).fetch)
