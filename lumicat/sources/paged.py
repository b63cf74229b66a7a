"""Pages of a JSON interface as a data source: ``spark.read.format("paged_json")`` and ``spark.readStream``.

Each partition is a range of pages that one task pulls, so pulls run side by side and a lost task repeats its own pages only. A
page is asked for again after an error of the server or the line, each time after twice the wait. A stream asks how many
pages there are, pulls the new ones in ranges, and keeps the page that it came to as its offset in the checkpoint.

Options: ``url`` with ``{page}`` in it; ``pages`` (their number, or ``total_field`` of page ``first``: the field with their
number); ``first`` (1); ``range`` pages a partition (10); ``items`` (the field with the rows, dots go inside; without it the page is
the list); ``retries`` (5); ``wait`` seconds before the first one (0.5); ``timeout`` seconds (30). The schema is the caller's: fields that an item
lacks are null, others are left out, and objects in a string field are kept as JSON. A status of 4xx, but for 408 and 429, fails at once.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

AGAIN = (408, 429)


@dataclass
class Pages(InputPartition):
    begin: int
    end: int


def fetch(url: str, retries: int, wait: float, timeout: float):
    """The JSON of an address; errors that may pass are waited for."""
    for left in range(retries, -1, -1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if left == 0 or (400 <= e.code < 500 and e.code not in AGAIN):
                raise
        except (urllib.error.URLError, OSError, ValueError):
            if left == 0:
                raise
        time.sleep(wait)
        wait *= 2


def inside(value, path: str):
    for part in filter(None, path.split(".")):
        value = value.get(part) if isinstance(value, dict) else None
    return value


def _typed(value, kind: T.DataType):
    if value is None or not isinstance(kind, (T.StringType, T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.BooleanType)):
        return value
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)
    return {T.BooleanType: bool, T.LongType: int, T.IntegerType: int}.get(type(kind), float)(value)


class _Pull:
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = dict(options), schema
        self.first, self.size = int(self.options.get("first", 1)), int(self.options.get("range", 10))
        if "{page}" not in self.options.get("url", ""):
            raise ValueError("the option url must hold {page}")

    def page(self, number: int):
        o = self.options
        return fetch(o["url"].replace("{page}", str(number)), int(o.get("retries", 5)), float(o.get("wait", 0.5)), float(o.get("timeout", 30)))

    def end(self) -> int:
        """The number behind the last page."""
        if "pages" in self.options:
            return self.first + int(self.options["pages"])
        return self.first + int(inside(self.page(self.first), self.options.get("total_field", "pages")) or 0)

    def ranges(self, begin: int, end: int) -> list[Pages]:
        return [Pages(at, min(at + self.size, end)) for at in range(begin, end, self.size)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for number in range(partition.begin, partition.end):
            for item in inside(self.page(number), self.options.get("items", "")) or []:
                yield tuple(_typed(item.get(f.name), f.dataType) for f in self.schema)


class _Reader(_Pull, DataSourceReader):
    def partitions(self) -> list[Pages]:
        return self.ranges(self.first, self.end()) or [Pages(self.first, self.first)]


class _StreamReader(_Pull, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"page": self.first}

    def latestOffset(self) -> dict:
        return {"page": max(self.end(), self.first)}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.ranges(start["page"], end["page"])

    def commit(self, end: dict) -> None:
        pass


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)
