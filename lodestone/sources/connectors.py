"""Connectors as Python data sources: loads by time range, resumable streams, and listings of ids and permissions.

A connector is a folder of JSON-line pages (``page-<n>.jsonl``) here, as services hand them out; a folder is a local path or a
URI that pyarrow reads, and pages may grow. Other services plug in by a subclass of :class:`Connector`. Rows that cannot be
read become rows with an ``error`` (a failure of that row, not of the run); a checkpoint goes past them."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "id string, text string, updated_at long, error string"
SLIM_SCHEMA = "id string, updated_at long, groups array<string>, error string"
#: Rows of a page that one task reads.
PART_ROWS = 10_000


class Connector:
    """What a service offers: its pages in order, how many rows each has, and the rows of a page from one on."""

    def __init__(self, options: dict):
        url = urlparse(options["path"])
        self.store, self.folder = (fs.LocalFileSystem(), url.path) if url.scheme in ("", "file") else fs.FileSystem.from_uri(options["path"])

    def pages(self) -> list[str]:
        found = self.store.get_file_info(fs.FileSelector(self.folder))
        return sorted(x.base_name for x in found if x.base_name.startswith("page-"))

    def _lines(self, page: str) -> Iterator[str]:
        with self.store.open_input_stream(f"{self.folder}/{page}") as f:
            rest = b""
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                yield from (x.decode(errors="replace") for x in lines)
            # a last line without its end is not yet written to the end

    def count(self, page: str) -> int:
        return sum(1 for _ in self._lines(page))

    def rows(self, page: str, first: int = 0, stop: int | None = None) -> Iterator[tuple]:
        """(id, text, updated_at, groups, error)"""
        for line in itertools.islice(self._lines(page), first, stop):
            try:
                d = json.loads(line)
                groups = d.get("groups")
                yield str(d["id"]), d.get("text", ""), int(d.get("updated_at", 0)), None if groups is None else [str(g) for g in groups], None
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                yield None, line, None, None, repr(e)


def validate_checkpoint(checkpoint: dict) -> dict:
    """``checkpoint`` itself: {"page": name or "", "row": rows of it that were read}; anything else raises."""
    if set(checkpoint) != {"page", "row"} or not isinstance(checkpoint["page"], str) or not isinstance(checkpoint["row"], int) or checkpoint["row"] < 0 or (not checkpoint["page"] and checkpoint["row"]):
        raise ValueError(f"not a checkpoint of this source: {checkpoint}")
    return checkpoint


class _Part(InputPartition):
    def __init__(self, page: str, first: int, stop: int | None):
        self.page, self.first, self.stop = page, first, stop


class _Reader:
    """Rows of parts of pages, with or without their texts."""

    def __init__(self, connector: Connector, slim: bool, after: int = -1, until: int = 1 << 62):
        self.connector, self.slim, self.after, self.until = connector, slim, after, until

    def read(self, partition):
        for id_, text, at, groups, error in self.connector.rows(partition.page, partition.first, partition.stop):
            if error is not None or self.after < at <= self.until:
                yield (id_, at, groups, error) if self.slim else (id_, text, at, error)


class _Load(_Reader, DataSourceReader):
    def partitions(self):
        return [_Part(p, 0, None) for p in self.connector.pages()]


class _Poll(_Reader, DataSourceStreamReader):
    """A batch reads what has come since the last one, also inside a page that has grown: the offset is a checkpoint."""

    def initialOffset(self):
        return {"page": "", "row": 0}

    def latestOffset(self):
        pages = self.connector.pages()
        return {"page": pages[-1], "row": self.connector.count(pages[-1])} if pages else self.initialOffset()

    def partitions(self, start, end):
        start, end = validate_checkpoint(start), validate_checkpoint(end)
        pages, out = self.connector.pages(), []
        for checkpoint in (start, end):
            if checkpoint["page"] and (checkpoint["page"] not in pages or checkpoint["row"] > self.connector.count(checkpoint["page"])):
                raise ValueError(f"the source no longer has what the checkpoint names: {checkpoint}")
        for page in pages:
            if start["page"] <= page <= end["page"]:
                first = start["row"] if page == start["page"] else 0
                stop = end["row"] if page == end["page"] else self.connector.count(page)
                out += [_Part(page, a, min(stop, a + PART_ROWS)) for a in range(first, stop, PART_ROWS)]
        return out

    def commit(self, end):
        validate_checkpoint(end)


class PagedSource(DataSource):
    """``format("paged")``: options path, after, until (exclusive, inclusive bounds on updated_at), and slim (true: ids, times
    and the groups that may read, without texts)."""

    @classmethod
    def name(cls):
        return "paged"

    def _slim(self) -> bool:
        return str(self.options.get("slim", "false")).lower() == "true"

    def schema(self):
        return SLIM_SCHEMA if self._slim() else SCHEMA

    def reader(self, schema):
        return _Load(Connector(self.options), self._slim(), int(self.options.get("after", -1)), int(self.options.get("until", 1 << 62)))

    def streamReader(self, schema):
        return _Poll(Connector(self.options), self._slim())


def register(spark) -> None:
    spark.dataSource.register(PagedSource)
