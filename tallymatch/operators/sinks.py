"""Where an audit is stored: as a table for further queries, as CSV for reading."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymatch.operators.audit import COLUMNS, report_order
from tallymatch.plans.staging import Stage
from tallymatch.sources.storage import PIECE, folder_sizes, is_local, make_folder, name_file, open_store, write_into_place, write_range

# The form of the report.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
BYTE_ORDER_MARK = "﻿"


def write_audit(audit: DataFrame, path: str) -> None:
    """The audit as parquet, one folder per status."""
    audit.write.partitionBy("status").parquet(path)


def read_audit(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*COLUMNS, "key")


def write_report(audit: DataFrame, path: str, files: int | None = None) -> None:
    """The audit columns as CSV in report order: rows by number, then orphans.

    The report is a folder of files whose names are in report order too. Each begins with a byte order mark, so that
    spreadsheets read accents right, and a header. ``files`` sets their number; by default it follows from the data.
    """
    report = _ordered(audit, files).select(F.col("row_number").alias(BYTE_ORDER_MARK + "row_number"), *COLUMNS[1:])
    report.write.options(**CSV_OPTIONS).csv(path)


def _ordered(audit: DataFrame, files: int | None) -> DataFrame:
    order = report_order()
    if files:
        return audit.repartitionByRange(files, *order).sortWithinPartitions(*order)
    return audit.orderBy(*order)


def write_report_file(audit: DataFrame, path: str, stage: Stage, files: int | None = None) -> None:
    """The same as one file: byte order mark and header once, then all rows in report order.

    The rows are written as sorted parts first. Where a part begins in the file follows from the lengths of those before it, so on a
    local or mounted folder each task writes its parts to their places, all at the same time. Other stores take a file
    as one stream: there one task passes the parts on, a piece at a time. The file has its name when it is whole.
    """
    parts = stage.path("report")
    _ordered(audit, files).select(*COLUMNS).write.options(**{**CSV_OPTIONS, "header": False}).csv(parts)
    header = (BYTE_ORDER_MARK + ",".join(COLUMNS) + "\n").encode()
    # One entry for each task of the write: few, whatever the size of the report.
    places, at = [], len(header)
    for part, size in folder_sizes(parts):
        if part.rpartition("/")[2].startswith("part-") and size:
            places.append((part, at, size))
            at += size
    spark, whole = audit.sparkSession, f"{path}.{uuid.uuid4().hex}.part"
    if not is_local(path):
        given = spark.createDataFrame([([part for part, _, _ in places], path)], "parts array<string>, path string")
        given.mapInPandas(lambda batches: _stream_parts(batches, header), "path string").collect()
        return
    make_folder(path.rpartition("/")[0] or ".")
    write_range(io.BytesIO(header), whole, 0, len(header))
    if places:
        given = spark.createDataFrame(places, "part string, at bigint, size bigint").withColumn("whole", F.lit(whole))
        given.repartition(len(places), "part").mapInPandas(_place_parts, "part string").count()
    name_file(whole, path, at)


def _place_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part, at, size, whole in zip(batch["part"], batch["at"], batch["size"], batch["whole"], strict=True):
            store, inner = open_store(part)
            with store.open_input_file(inner) as content:
                write_range(content, whole, int(at), int(size))
        yield batch[["part"]]


def _stream_parts(batches: Iterator[pd.DataFrame], header: bytes) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for parts, path in zip(batch["parts"], batch["path"], strict=True):
            write_into_place(Joined(header, parts), path, str(TaskContext.get().taskAttemptId()))
        yield batch[["path"]]


class Joined(io.RawIOBase):
    """The header and the parts, read as one stream."""

    def __init__(self, header: bytes, parts: Iterable[str]):
        self.pieces = self._pieces(header, parts)

    @staticmethod
    def _pieces(header: bytes, parts: Iterable[str]) -> Iterator[bytes]:
        yield header
        for part in parts:
            store, inner = open_store(part)
            with store.open_input_stream(inner) as content:
                while piece := content.read(PIECE):
                    yield piece

    def read(self, size: int = -1) -> bytes:
        return next(self.pieces, b"")
