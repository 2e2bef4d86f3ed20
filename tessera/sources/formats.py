"""Folders of documents as sources: spark.read.format("xbrl" | "exhibit" | "feed").load(folder), once `register` has made them known.

Tasks read files, several small ones each. Filters on `file` choose files before any is opened (spark.sql.python.filterPushdown.enabled); a file
that cannot be read as what it should be gives one row, with `error`. A file that cannot be opened fails its task: it may be there at the next try."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from xml.etree.ElementTree import ParseError

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from tessera.sources.parsers import ENTRIES, FACTS, LINES, feed_rows, page_rows, xbrl_elements

#: How much a task reads, and what opening a file counts as.
TASK, OPEN = 128 << 20, 4 << 20


@dataclass
class Files(InputPartition):
    """Paths as the file system has them; with `start` before them they are the names that rows have. A name is never taken for an
    address again: its percent signs are its own."""

    start: str
    paths: list[str]


def _wanted(filters: Sequence[Filter], path: str) -> bool:
    tests = {EqualTo: lambda v: path == v, In: lambda v: path in v, StringStartsWith: lambda v: v is not None and path.startswith(v)}
    return all(tests[type(f)](f.value) for f in filters)


class FolderReader(DataSourceReader):
    def __init__(self, source: FolderSource, width: int):
        self.read_file, self.width, self.files = source.read_file, width, []
        if not (folder := source.options.get("path")):
            raise ValueError(f"{source.name()}: load() needs a folder")
        self.folder, self.names = folder, source.options.get("pathGlobFilter", "*")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and f.attribute == ("file",):
                self.files.append(f)
            else:
                yield f

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if ":/" in self.folder else (fs.LocalFileSystem(), self.folder)

    def partitions(self) -> Sequence[InputPartition]:
        """Only names and sizes reach the driver. Names that begin with _ or . are hidden, as in other sources."""
        at, root = self._system()
        start = self.folder[: len(self.folder) - len(root)] if self.folder.endswith(root) else ""
        out, room = [], 0
        for f in sorted(at.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda f: f.path):
            inside = f.path[len(root) :].strip("/").split("/")
            if f.type != fs.FileType.File or any(p[:1] in "_." for p in inside) or not fnmatch.fnmatch(inside[-1], self.names) or not _wanted(self.files, start + f.path):
                continue
            if room < f.size + OPEN:
                out.append(Files(start, []))
                room = TASK
            out[-1].paths.append(f.path)
            room -= f.size + OPEN
        return out or [Files(start, [])]

    def read(self, partition: Files) -> Iterator[tuple]:
        at, _ = self._system()
        for name in partition.paths:
            path = partition.start + name
            with at.open_input_stream(name) as f:
                content = f.read()
            try:
                yield from self.read_file(path, content)
            except (ParseError, ValueError) as e:
                yield (path, *[None] * (self.width - 2), f"{type(e).__name__}: {e}")


class FolderSource(DataSource):
    """The rows of a folder's files with `error`, null for rows that were read."""

    columns: str

    def schema(self) -> str:
        return f"{self.columns}, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(self, len(schema.fields))


class Xbrl(FolderSource):
    columns = FACTS

    @classmethod
    def name(cls) -> str:
        return "xbrl"

    @staticmethod
    def read_file(path: str, content: bytes) -> Iterator[tuple]:
        for row in xbrl_elements(path, content):
            yield (*row, row[7] if row[1] == "error" else None)


class Exhibit(FolderSource):
    columns = LINES

    @classmethod
    def name(cls) -> str:
        return "exhibit"

    @staticmethod
    def read_file(path: str, content: bytes) -> Iterator[tuple]:
        if b"\0" in content:
            raise ValueError("not text")
        for row in page_rows(path, content):
            yield (*row, None)


class Feed(FolderSource):
    columns = ENTRIES

    @classmethod
    def name(cls) -> str:
        return "feed"

    @staticmethod
    def read_file(path: str, content: bytes) -> Iterator[tuple]:
        for row in feed_rows(path, content):
            yield (*row, None)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, and lets filters choose files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Xbrl, Exhibit, Feed):
        spark.dataSource.register(source)
