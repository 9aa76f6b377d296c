"""A folder tree as a data source: ``spark.read.format("file_listing")`` and ``spark.readStream.format("file_listing")``.

A row is a file: path, name, suffix (lower-cased, with its dot), size, modified (its time, UTC). Options: ``path``, and ``recursive``
(false). Reading, there is one partition for each folder that is found down to ``depth`` levels (2); what lies deeper is listed by the task of
its folder at that level, so the driver looks at folders near the top alone and the files are listed in tasks. Filters on name and suffix
(equal, one of, ends with) are taken over by the source: a file that they leave out is not even asked for its size.

As a stream, the offset is a mark in time: a batch has the files that were modified after the last mark, up to a new one, which is
``settle`` seconds (2) behind the clock so that no file of that time is still to come. A file that is written again shows again. What is moved in with an
older time of change does not show; write files in place, or give them a new time.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringEndsWith,
)

from tallymatch.sources.folders import printable, require_folder
from tallymatch.sources.storage import open_store, plain_path

NAME = "file_listing"
SCHEMA = "path string, name string, suffix string, size bigint, modified timestamp"
NANOS = 1_000_000_000


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileListing)


@dataclass(frozen=True)
class Found:
    path: str
    name: str
    is_folder: bool
    is_link: bool
    is_file: bool
    entry: object

    @property
    def suffix(self) -> str:
        """Text from the last dot on; none where there is nothing before or after that dot."""
        stem, dot, end = self.name.rpartition(".")
        return (dot + end).lower() if stem and end else ""

    def facts(self) -> tuple[int | None, int]:
        """Size, and time of modification in nanoseconds."""
        if isinstance(self.entry, os.DirEntry):
            try:
                seen = self.entry.stat()
            except OSError:
                return None, 0
            return seen.st_size, seen.st_mtime_ns
        return self.entry.size, self.entry.mtime_ns or 0


def entries(folder: str) -> Iterator[Found]:
    """What is directly in a folder."""
    store, inner = open_store(folder)
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(inner) as opened:
            for entry in opened:
                path = printable(entry.path)
                yield Found(path, os.path.basename(path), entry.is_dir(), entry.is_symlink(), entry.is_file(), entry)
        return
    scheme = folder[: len(folder) - len(inner)] if folder.endswith(inner) else ""
    for info in store.get_file_info(fs.FileSelector(inner)):
        yield Found(scheme + info.path, info.base_name, info.type == fs.FileType.Directory, False, info.is_file, info)


@dataclass
class Folder(InputPartition):
    """A folder to list, with everything below it or without."""

    path: str
    below: bool


@dataclass(frozen=True)
class Wanted:
    """Tests of name and suffix, all of which a file has to pass."""

    tests: tuple[tuple[str, str, tuple[str, ...]], ...] = ()

    def takes(self, found: Found) -> bool:
        for column, kind, values in self.tests:
            value = found.suffix if column == "suffix" else found.name
            if not (value.endswith(values) if kind == "ends" else value in values):
                return False
        return True

    @staticmethod
    def test(given: Filter) -> tuple[str, str, tuple[str, ...]] | None:
        """The test behind a filter, None where it is for Spark to apply."""
        if not isinstance(given, (EqualTo, In, StringEndsWith)) or given.attribute not in (("name",), ("suffix",)):
            return None
        kind = "ends" if isinstance(given, StringEndsWith) else "in"
        values = tuple(given.value) if isinstance(given, In) else (given.value,)
        return (given.attribute[0], kind, values) if all(isinstance(v, str) for v in values) else None


class Options:
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("file_listing needs the option path")
        self.path = plain_path(options["path"])
        self.recursive = str(options.get("recursive", "false")).lower() == "true"
        self.depth = int(options.get("depth", 2))
        self.settle = float(options.get("settle", 2))

    def folders(self) -> list[Folder]:
        """The folders to list: one level after the other from the top, links to folders left out."""
        require_folder(self.path)
        level, out = [self.path], []
        for _ in range(self.depth if self.recursive else 0):
            out += [Folder(path, False) for path in level]
            level = [found.path for path in level for found in entries(path) if found.is_folder and not found.is_link]
        return out + [Folder(path, self.recursive) for path in level]


def listed(folder: Folder, recursive: bool, wanted: Wanted, after: int = -1, to: int | None = None) -> Iterator[tuple]:
    """The files of a folder that were modified after one time and not after another, in nanoseconds."""
    open_folders = [folder.path]
    while open_folders:
        for found in entries(open_folders.pop()):
            if found.is_folder:
                if folder.below and not found.is_link:
                    open_folders.append(found.path)
                continue
            if not (recursive or found.is_file) or not wanted.takes(found):
                continue
            size, modified = found.facts()
            if modified > after and (to is None or modified <= to):
                moment = datetime.fromtimestamp(modified // 1000 / 1e6, timezone.utc)
                yield found.path, found.name, found.suffix, size, moment


class FileListing(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(Options(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  (the API's name)
        return StreamReader(Options(self.options))


class Reader(DataSourceReader):
    def __init__(self, options: Options):
        self.options, self.wanted = options, Wanted()

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        tests = []
        for given in filters:
            test = Wanted.test(given)
            if test is None:
                yield given
            else:
                tests.append(test)
        self.wanted = Wanted(tuple(tests))

    def partitions(self) -> list[Folder]:
        return self.options.folders()

    def read(self, partition: Folder) -> Iterator[tuple]:
        yield from listed(partition, self.options.recursive, self.wanted)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: Options):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"mark": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"mark": time.time_ns() - int(self.options.settle * NANOS)}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        self.marks = start["mark"], end["mark"]
        return [Batch(folder.path, folder.below, *self.marks) for folder in self.options.folders()]

    def read(self, partition: Batch) -> Iterator[tuple]:
        yield from listed(partition, self.options.recursive, Wanted(), partition.after, partition.to)


@dataclass
class Batch(Folder):
    """A folder to list, and between which marks."""

    after: int
    to: int
