"""Sources that come in pages, newest first: where to stop, and a data source for Spark.

A user's source is a class with ``count()`` and ``fetch(page)``, named by its import path;
Spark reads its pages in parallel.  ``fetch`` gives a list of rows, an empty list for a page
without rows, and None where nothing has changed, which is not the same.
"""

from __future__ import annotations

import importlib
import itertools
import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGE_SIZE = 8
ROWS = "page int, id string, date string, result array<int>"


def crawl(pages: DataFrame, anchor: str, at_or_below: bool = False, size: int = PAGE_SIZE) -> DataFrame:
    """Rows up to the first short page or the first page with the anchor; an anchor that no such page has is an error.

    With ``at_or_below`` any id not above the anchor ends the crawl, and only rows above it are kept.
    ``pages`` has ``page, id, date, result``; one row a page decides where to stop.
    """
    number = F.col("id").cast("bigint")
    seen = (number <= int(anchor)) if at_or_below else (F.col("id") == anchor)
    each = pages.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.max(seen.cast("int")).alias("hit"))
    # a page that has no rows at all ends the crawl too: later numbers are not reached
    ends = each.withColumn("end", (F.col("n") < size) | (F.col("hit") == 1) | (F.coalesce(F.lead("page").over(Window.partitionBy(F.lit(1)).orderBy("page")), F.lit(-1)) != F.col("page") + 1))
    last = ends.agg(F.min(F.when(F.col("end"), F.col("page"))).alias("_last"), F.min(F.when(F.col("hit") == 1, F.col("page"))).alias("_hit"))
    ok = last.select("_last", F.when(F.col("_hit").isNull() | (F.col("_hit") > F.col("_last")), F.raise_error(F.lit(f"no page has the anchor {anchor}")).cast("int")).otherwise(F.col("_hit")).alias("_hit"))
    kept = pages.join(F.broadcast(ok), (F.col("page") <= F.col("_last")) & F.col("_hit").isNotNull()).drop("_last", "_hit")  # one row on the right
    return kept.where(number > int(anchor)) if at_or_below else kept


class JsonPages:
    """Pages as files ``0.json``, ``1.json``, ... of lists of rows, in a folder that all executors see."""

    def __init__(self, options: dict):
        self.folder = Path(options["folder"])

    def count(self) -> int:
        return sum(1 for p in self.folder.glob("*.json") if p.stem.isdigit())

    def fetch(self, page: int) -> list[dict] | None:
        path = self.folder / f"{page}.json"
        return json.loads(path.read_text()) if path.exists() else None


def adapter(options: dict):
    module, _, name = options.get("adapter", f"{__name__}:JsonPages").partition(":")
    return getattr(importlib.import_module(module), name)(options)


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


def _tuples(page: int, rows: list[dict] | None) -> Iterator[tuple]:
    for r in rows or []:
        yield page, r["id"], r["date"], list(r["result"])


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Page(i) for i in range(adapter(self.options).count())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _tuples(partition.value, adapter(self.options).fetch(partition.value))


class NewPage(InputPartition):
    """A page of a batch: its rows above ``above``, up to ``high``; the last one goes on until a row is not above ``floor``."""

    def __init__(self, number: int, floor: int | None, above: int, high: int, last: bool):
        super().__init__(number)
        self.floor, self.above, self.high, self.last = floor, above, high, last


class PageStream(DataSourceStreamReader):
    """Rows with ids above the last one read, page by page on the executors.

    The driver looks at the newest page, and by a binary search at the few that tell which page reaches back to the
    last id read.  A source of which no page does is an error, before anything is read and so before anything is
    committed; so is a page in between that is missing or short, and a source whose newest row is older than before.
    Pages move back while a source grows: a task counts the rows newer than its batch, reads its rows that much later,
    and reads again if that number has changed meanwhile.  The offset is the newest id and the number of pages then.
    Without ``after`` the crawl must reach ``first``, if that is given.
    """

    def __init__(self, options: dict):
        self.options = options
        self.size = int(options.get("size", PAGE_SIZE))
        self.newest = self.initialOffset()

    def initialOffset(self) -> dict:  # noqa: N802
        return {"id": self.options.get("after", ""), "pages": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        source = adapter(self.options)
        rows = source.fetch(0)
        if rows and (newest := max((r["id"] for r in rows), key=int)) != self.newest["id"]:
            self.newest = {"id": newest, "pages": source.count()}
        return self.newest

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["id"] == end["id"]:
            return []
        source = adapter(self.options)
        # a batch that failed is planned anew with the offset it had
        most = max((end["id"], start["id"] or end["id"]), key=int)
        newest = max((r["id"] for r in source.fetch(0) or []), key=int, default="-1")
        if int(newest) < int(most) or int(end["id"]) < int(most):
            raise ValueError(f"the newest id went back from {most} to {min((newest, end['id']), key=int)}")
        pages = source.count()
        floor = int(start["id"]) if start["id"] else int(self.options["first"]) if "first" in self.options else None
        above, last = -1 if floor is None else floor if start["id"] else floor - 1, pages - 1
        if floor is not None:
            # ids fall from page to page: the first page with one not above the floor
            reaches = lambda page: any(int(r["id"]) <= floor for r in source.fetch(page) or [])
            a, b = 0, pages
            while a < b:
                mid = (a + b) // 2
                a, b = (a, mid) if reaches(mid) else (mid + 1, b)
            last = a
            if last == pages:
                raise ValueError(f"no page reaches back to {floor:05d}")
        return [NewPage(i, floor, above, int(end["id"]), i == last) for i in range(last + 1)]

    def _newer(self, source, high: int) -> int:
        """How many rows are newer than the batch."""
        n = 0
        for page in itertools.count():
            rows = source.fetch(page) or []
            n += sum(int(r["id"]) > high for r in rows)
            if not rows or any(int(r["id"]) <= high for r in rows):
                return n

    def _rows(self, source, part: NewPage, newer: int) -> list[dict]:
        out: list[dict] = []
        for place in itertools.count(part.value):
            at = place * self.size + newer
            held = source.fetch(at // self.size) or []
            rows = held[at % self.size :]
            if at % self.size and len(held) == self.size:
                rows += (source.fetch(at // self.size + 1) or [])[: at % self.size]
            out += rows
            reached = part.floor is not None and any(int(r["id"]) <= part.floor for r in rows)
            if len(rows) < self.size and not reached and not (part.last and part.floor is None):
                raise ValueError(f"page {place} is missing or short")
            if reached or not part.last or part.floor is None:
                return out

    def read(self, partition: NewPage) -> Iterator[tuple]:
        source = adapter(self.options)
        newer = self._newer(source, partition.high)
        while True:
            rows = self._rows(source, partition, newer)
            again = self._newer(source, partition.high)
            if again == newer:
                return _tuples(partition.value, [r for r in rows if partition.above < int(r["id"]) <= partition.high])
            newer = again


class PagedDraws(DataSource):
    """``spark.dataSource.register(PagedDraws)``, then format ``paged_draws`` with options ``adapter`` and its own."""

    @classmethod
    def name(cls) -> str:
        return "paged_draws"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStream(dict(self.options))
