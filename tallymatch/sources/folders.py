"""Folder listings as tables.

Folders are listed inside tasks, one level of the tree per step, and each level is written to the stage before the next
one starts. One task reads the names of a folder, in sequence; their sizes, a request for each file of a local folder, are asked for by
all tasks. Nothing is listed on the driver, a lost executor costs one folder, and the result is a fixed snapshot that
later steps may read as often as they like. Spark's own file sources are not used here: they leave out names that begin
with a dot or an underscore.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymatch.plans.staging import Stage
from tallymatch.sources.storage import is_folder, open_store, plain_path

ENTRIES = "path string, size bigint, kind string"
SCHEMA = pa.schema([("path", pa.string()), ("size", pa.int64()), ("kind", pa.string())])
#: The kind of a file whose size is still to be asked for.
UNSIZED = "unsized"
BATCH = 10_000
FOLDERS_PER_TASK = 16
MOST_TASKS = 10_000


def require_folder(folder: str) -> None:
    if not is_folder(folder):
        raise NotADirectoryError(f"Folder not found: {folder}")


def list_folder(spark: SparkSession, folder: str, stage: Stage, recursive: bool = False) -> DataFrame:
    """Every file of a folder, or of the whole tree below it: (path, size).

    Flat: the entries that are files, links to files included. Recursive: every entry that is no folder; links to
    folders are not followed.
    """
    require_folder(folder)
    root = plain_path(folder)
    cores = spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(root,)], "path string").coalesce(1)
    levels = []
    while True:
        level = stage.save(_listed(frontier, cores, recursive), "listing")
        levels.append(level)
        below = level.filter("kind = 'folder'").select("path")
        count = below.count() if recursive else 0
        if not count:
            break
        frontier = below.repartition(min(MOST_TASKS, max(-(-count // FOLDERS_PER_TASK), min(count, cores))))
    listing = levels[0]
    for level in levels[1:]:
        listing = listing.unionByName(level)
    return listing.filter("kind = 'file'").select("path", "size")


def list_names(spark: SparkSession, folder: str, stage: Stage) -> DataFrame:
    """Whatever is directly in a folder, folders too: (path, size); a folder has no size. A folder that is not there holds nothing."""
    if not is_folder(folder):
        return spark.createDataFrame([], "path string, size bigint")
    frontier = spark.createDataFrame([(plain_path(folder),)], "path string").coalesce(1)
    names = _listed(frontier, spark.sparkContext.defaultParallelism, True, links=True)
    return stage.save(names, "names").select("path", "size")


def _listed(folders: DataFrame, tasks: int, recursive: bool, links: bool = False) -> DataFrame:
    """What is in the folders. One task lists a folder, whatever it holds; sizes, and what reads the listing later, are dealt out."""
    names = folders.mapInArrow(_lister(recursive, links), ENTRIES).repartition(tasks)
    return names.mapInArrow(_with_sizes, ENTRIES)


def _lister(recursive: bool, links: bool = False):
    def list_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = []
                for entry in _entries(folder, recursive, links):
                    found.append(entry)
                    if len(found) == BATCH:
                        yield _table(found)
                        found = []
                yield _table(found)

    return list_all


def _table(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*found) if found else [()] * 3, SCHEMA)], schema=SCHEMA)


def _with_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(column.to_pylist() for column in batch.columns))
        yield _table([(path, _size(path), "file") if kind == UNSIZED else (path, size, kind) for path, size, kind in rows])


def _entries(folder: str, recursive: bool, links: bool = False) -> Iterator[tuple]:
    """``links``: links to folders count as folders, else they are left out."""
    store, inner = open_store(folder)
    if not isinstance(store, fs.LocalFileSystem):
        scheme = folder[: len(folder) - len(inner)] if folder.endswith(inner) else ""
        for info in store.get_file_info(fs.FileSelector(inner)):
            kind = "folder" if info.type == fs.FileType.Directory else "file"
            yield scheme + info.path, info.size, kind
        return
    with os.scandir(inner) as entries:
        for entry in entries:
            if entry.is_dir():
                if recursive and (links or not entry.is_symlink()):
                    yield printable(entry.path) if links else entry.path, None, "folder"
            elif recursive or entry.is_file():
                path = printable(entry.path)
                # A name that is spelled out names no file, so its size is asked for here.
                yield (path, None, UNSIZED) if path == entry.path else (path, _size(entry), "file")


def printable(path: str) -> str:
    """The path; bytes of a name that is not UTF-8 are spelled out.

    Such a file is listed like any other and accounted for. A copy of it fails by itself, since no path names it.
    """
    return os.fsencode(path).decode("utf-8", "backslashreplace")


def _size(entry: os.DirEntry | str) -> int | None:
    try:
        return os.stat(entry).st_size
    except OSError:
        return None


def as_listing(table: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """A table that already lists files, for example an inventory of a bucket, in the form of ``list_folder``."""
    return table.select(F.col(path).cast("string").alias("path"), F.col(size).cast("bigint").alias("size"))
