"""Zip archives as tables of entries, and their extraction.

The directory of an archive is read by one task, its content by many: pieces of it are spread over tasks, and each task
opens the archive and reads its entries only. So one huge archive is no bottleneck.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymatch.functions.paths import resolved_entry, resolves_inside
from tallymatch.sources.storage import open_store, plain_path, write_into_place

ENTRIES = "archive string, entries bigint, ordinal bigint, entry string, size bigint"
BATCH = 10_000
SMALLEST_PIECE = 1_000
MOST_PIECES = 256


def archive_entries(archives: DataFrame) -> DataFrame:
    """(path) of zip files -> every entry that is no folder: (archive, entries, ordinal, entry, size).

    ``entries`` is the number of entries of the archive, ``ordinal`` the place of this one.
    """
    return archives.select("path").mapInPandas(_list_entries, ENTRIES)


def safe_entries(entries: DataFrame) -> DataFrame:
    """Entries that stay below the folder they are extracted to, with the place they resolve to."""
    return (
        entries.filter(resolves_inside(F.col("entry")))
        .withColumn("place", resolved_entry(F.col("entry")))
        .filter("place <> ''")
    )


def entries_written(entries: DataFrame) -> DataFrame:
    """Per archive: entries that pass the check, and the distinct places they are written to: (archive, n, n_places)."""
    places = safe_entries(entries).groupBy("archive", "place").agg(F.count(F.lit(1)).alias("n"))
    return places.groupBy("archive").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_places"))


def last_per_place(entries: DataFrame) -> DataFrame:
    """Where several entries go to one place, the last one: that is what is there after writing them in order."""
    last = entries.groupBy("archive", "place").agg(F.max("ordinal").alias("ordinal"))
    return entries.join(last, ["archive", "place", "ordinal"], "left_semi")


def extract(entries: DataFrame, folder: str, tasks: int) -> DataFrame:
    """Write the safe entries below ``folder``: (path, size) of each file, in the form of a folder listing.

    Every archive is cut into pieces of consecutive entries, at most ``MOST_PIECES``, since opening it means reading its
    directory. The result is lazy and writing is its side effect: store it once and read it from there.
    """
    root = plain_path(folder).rstrip("/")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark = str(TaskContext.get().taskAttemptId())
        opened, name, infos = None, None, []
        try:
            for batch in batches:
                written = []
                for archive, ordinal, place in zip(batch["archive"], batch["ordinal"], batch["place"]):
                    if archive != name:
                        if opened:
                            opened.close()
                        opened, name = _open_archive(archive), archive
                        infos = opened.infolist()
                    path = f"{root}/{place}"
                    with opened.open(infos[ordinal]) as content:
                        write_into_place(content, path, mark)
                    written.append((path, infos[ordinal].file_size))
                yield pd.DataFrame(written, columns=["path", "size"])
        finally:
            if opened:
                opened.close()

    per_piece = F.greatest(F.lit(SMALLEST_PIECE), F.ceil(F.col("entries") / MOST_PIECES))
    chosen = last_per_place(safe_entries(entries)).withColumn("piece", F.floor(F.col("ordinal") / per_piece))
    spread = chosen.repartition(tasks, "archive", "piece").sortWithinPartitions("archive", "ordinal")
    return spread.mapInPandas(write, "path string, size bigint")


def _list_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["archive", "entries", "ordinal", "entry", "size"]
    for batch in batches:
        for path in batch["path"]:
            with _open_archive(path) as opened:
                infos = opened.infolist()
            for start in range(0, len(infos), BATCH):
                part = enumerate(infos[start : start + BATCH], start)
                rows = [(path, len(infos), at, info.filename, info.file_size) for at, info in part if not info.is_dir()]
                yield pd.DataFrame(rows, columns=columns)


def _open_archive(path: str) -> zipfile.ZipFile:
    store, inner = open_store(path)
    return zipfile.ZipFile(store.open_input_file(inner))
