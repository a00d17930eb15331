"""A service that answers in pages, as a Spark data source: each page is a partition of its own, read
and, when the service fails, asked for again by the task that has it.

A graph service prints a table of at most so many rows for a query with SKIP and LIMIT, and may cut its
output short. So a page that comes back with fewer rows than it has is asked for the rest, and the
last page goes on until an empty answer: rows that arrive between the count and the read are not lost.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a page; how often a page is asked for, and how long a task waits before it asks again (twice as long each time).
PAGE, ATTEMPTS, WAIT = 50, 4, 0.2

ROUTES = "id string, route string, http_method string, file_path string, handler string"


class Page(InputPartition):
    def __init__(self, skip: int, size: int, last: bool):
        self.skip, self.size, self.last = skip, size, last


class PagedReader(DataSourceReader):
    def __init__(self, count: Callable[[], int], fetch: Callable[[int, int], Sequence[tuple]], page: int, attempts: int, wait: float):
        self.count, self.fetch, self.page, self.attempts, self.wait = count, fetch, page, attempts, wait

    def _asked(self, skip: int, size: int) -> Sequence[tuple]:
        for n in range(self.attempts):
            try:
                return self.fetch(skip, size)
            except Exception:
                if n + 1 == self.attempts:
                    raise
                time.sleep(self.wait * 2**n)
        raise ValueError("a page must be asked for at least once")

    def partitions(self) -> list[Page]:
        total = self.count()
        starts = list(range(0, max(total, 1), self.page))
        return [Page(s, self.page, s == starts[-1]) for s in starts]

    def read(self, partition: Page) -> Iterator[tuple]:
        skip, left = partition.skip, partition.size
        while left > 0:
            rows = self._asked(skip, left)
            if not rows:
                return
            yield from rows[:left]
            skip += len(rows[:left])
            left = partition.size if partition.last else left - len(rows)


def paged_source(name: str, schema: str, count: Callable[[], int], fetch: Callable[[int, int], Sequence[tuple]], page: int = PAGE, attempts: int = ATTEMPTS, wait: float = WAIT) -> type[DataSource]:
    """A data source, to be registered under that name. ``count()`` says how many rows there are now;
    ``fetch(skip, limit)`` gives the rows (tuples of the schema's columns) from there on, ``limit`` at most and in an order
    that stays; both run on executors, so they must not need the driver. Options: page, attempts."""
    if page < 1:
        raise ValueError("a page has at least one row")

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> PagedReader:  # the caller names the argument
            return PagedReader(count, fetch, int(self.options.get("page", page)), int(self.options.get("attempts", attempts)), wait)

    return Paged


def paged(spark: SparkSession, source: type[DataSource], **options) -> DataFrame:
    """Registers a source and reads it."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load()


def table_rows(text: str | None, columns: int) -> list[list[str]]:
    """The cells of a markdown table below its head and rule, empty cells included; rows with fewer cells
    than ``columns`` are left out."""
    out = []
    for line in (text or "").split("\n")[2:]:
        own = line.strip().removeprefix("|").removesuffix("|")
        cells = [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", own)] if own.strip() else []
        if len(cells) >= columns:
            out.append(cells)
    return out


def route_source(name: str, run: Callable[[str], str | None], page: int = PAGE, attempts: int = ATTEMPTS, wait: float = WAIT) -> type[DataSource]:
    """Route nodes of a graph service. ``run(query)`` gives the markdown table of an answer, or none where there is
    nothing; a missing verb is GET."""

    def count() -> int:
        cells = table_rows(run("MATCH (r:Route) RETURN count(r) as count"), 1)
        found = cells[0][0] if cells else "0"
        return int(found) if found.isdigit() else 0

    def fetch(skip: int, limit: int) -> list[tuple]:
        rows = table_rows(run(f"MATCH (r:Route) RETURN r.name, r.method, r.filePath, r.handlerSymbolId SKIP {skip} LIMIT {limit}"), 4)
        return [(f"Route:{r[1]} {r[0]}", r[0], r[1] or "GET", r[2], r[3]) for r in rows]

    return paged_source(name, ROUTES, count, fetch, page, attempts, wait)
