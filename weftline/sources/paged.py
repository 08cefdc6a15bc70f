"""A remote source that is read page by page, as a Python data source: one partition for each id.

The option `provider` names a function as module:name. It takes (id, cursor, count) and returns a dict with
items, has_more and the next cursor (as next_cursor, as cursor, or as page.cursor); the option `fields` may map the
columns comment_id, text and like_count to other, dotted names. Rows without a text are dropped. A failing page ends that
id's rows: what was read before stays, and cut_short is true in the rows of the last page before it. Where the first
page fails there is nothing to keep, and the read fails.

Filters are not taken by the reader, ids are told as an option: Spark 4.1.2 keeps a reader that took a filter with its DataFrame, and
a later query on that DataFrame without the filter would lose rows.

As a stream (readStream) a source whose cursors are offsets is read from where the checkpoint left each id: the option `ends`
names a function that takes an id and returns its number of rows so far. What is new of an id is read by several tasks, PAGES pages each.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Rows of a page and pages of a scan, at most.
PAGE_ROWS, MOST_PAGES = 20, 50
#: Pages that a task of the stream reads.
PAGES = 10


def _named(function: str):
    module, _, name = function.partition(":")
    return getattr(importlib.import_module(module), name)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.ids = [x for x in options["ids"].split(",") if x]
        self.provider, self.limit = options["provider"], int(options.get("limit", "2000"))
        self.fields = {"comment_id": "comment_id", "text": "text", "like_count": "like_count"} | json.loads(options.get("fields", "{}"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in self.ids]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # no ids
            return
        fetch = _named(self.provider)
        cursor, n = 0, 0
        held: list[tuple] = []  # a page's rows wait until the next page is there or fails
        for page in range(MOST_PAGES):
            try:
                got = fetch(partition.value, cursor, min(PAGE_ROWS, self.limit - n))
            except OSError:
                if not page:
                    raise
                yield from (row + (True,) for row in held)
                return
            yield from (row + (False,) for row in held)
            held = []
            for item in got["items"]:
                text = _dug(item, self.fields["text"]) or ""
                if n < self.limit and text.strip():
                    held.append((partition.value, str(_dug(item, self.fields["comment_id"])), text, int(_dug(item, self.fields["like_count"]) or 0), page))
                    n += 1
            cursor = next((c for c in (_dug(got, "next_cursor"), _dug(got, "cursor"), _dug(got, "page.cursor")) if c is not None), None)
            if n >= self.limit or not got.get("has_more") or cursor is None:
                break
        yield from (row + (False,) for row in held)


@dataclass
class Range(InputPartition):
    """Rows of an id from start to before end."""

    id: str
    start: int
    end: int


class PagedStreamReader(DataSourceStreamReader):
    """New rows of each id; offsets are rows by id."""

    def __init__(self, options: dict) -> None:
        if "ends" not in options:
            raise ValueError("a stream needs the option ends")
        self.reader, self.ends = PagedReader(options), options["ends"]

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.reader.ids, 0)

    def latestOffset(self) -> dict:
        end = _named(self.ends)
        return {i: int(end(i)) for i in self.reader.ids}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        size = PAGES * PAGE_ROWS
        return [Range(i, a, min(a + size, end[i])) for i in self.reader.ids if i in end for a in range(start.get(i, 0), end[i], size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        fetch, fields = _named(self.reader.provider), self.reader.fields
        for cursor in range(partition.start, partition.end, PAGE_ROWS):
            for item in fetch(partition.id, cursor, min(PAGE_ROWS, partition.end - cursor))["items"]:
                text = _dug(item, fields["text"]) or ""
                if text.strip():
                    yield partition.id, str(_dug(item, fields["comment_id"])), text, int(_dug(item, fields["like_count"]) or 0), cursor // PAGE_ROWS, False

    def commit(self, end: dict) -> None:
        """The checkpoint keeps the offsets; the source has nothing to forget."""


def _dug(value, path: str):
    """The value at a dotted path, None where there is none."""
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged").option("provider", ...).option("ids", "a,b").load()"""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, comment_id string, text string, like_count long, page int, cut_short boolean"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> PagedStreamReader:
        return PagedStreamReader(self.options)
