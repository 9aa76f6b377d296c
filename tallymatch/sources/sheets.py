"""Sheets and tables as roster rows: (row_number, key_raw, target_raw, name).

Sheets are read in parallel, split by split. Where every record is one line, which is tested first in a rule that errs on
the safe side, Spark's CSV parser takes the lines as they are. Sheets with line breaks inside quoted cells, or with stray
quotes, are put together to records first and parsed the way Python's csv module does.
"""

from __future__ import annotations

import csv
import io
import logging
import re
import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymatch.functions.text import WHITESPACE, clean_cell
from tallymatch.sources.storage import folder_files, is_file, is_folder, open_store

log = logging.getLogger(__name__)

# A quoted cell that fills its place between two commas and holds nothing but whitespace.
QUOTED_BLANK = r'(?U)(?:\A|(?<=,))"[\s\x1c-\x1f]*+"(?=,|\z)'
# The letters of a header that count, and characters with a meaning in a path that Spark reads.
HEADER_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
PATTERN_SIGNS = "{}[]*?\\"
CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
HIDDEN = ("_", ".")
# Effects of a line on the state; 0 and 1 set it.
KEEP, FLIP = 2, 3
RAW_COLUMNS = ("key_raw", "target_raw", "name")
Places = tuple[int, int, int | None]


class MissingColumn(ValueError):
    """A column that must be there is not among the headers."""


def reduced(header: str) -> str:
    """What counts of a header, as ``text.header_token`` has it for columns."""
    return "".join(letter for letter in header.lower() if letter in HEADER_LETTERS)


def find_columns(cells: Sequence[str], key: str, target: str, name: str | None = None) -> Places:
    """Where the key, the target and the name are among the cells of a header; of equal headers the last one counts.

    Key and target must be there. A name that is not gives blank names.
    """
    last_place = {reduced(cell): place for place, cell in enumerate(cells)}
    missing = [label for label in (key, target) if reduced(label) not in last_place]
    if missing:
        raise MissingColumn(f"Missing: {', '.join(missing)}. The header has: {', '.join(cells)}")
    if name and reduced(name) not in last_place:
        log.warning("There is no column %r; names stay blank", name)
    return last_place[reduced(key)], last_place[reduced(target)], last_place.get(reduced(name)) if name else None


def roster_from_table(
    table: DataFrame, key: str, target: str, name: str | None = None, row_number: str = "row_number"
) -> DataFrame:
    """Roster rows from any table that carries its own row numbers. Rows with nothing but blank cells are dropped."""
    headers = [column for column in table.columns if column != row_number]
    key_at, target_at, name_at = find_columns(headers, key, target, name)
    types = dict(table.dtypes)
    cells = [clean_cell(F.col(f"`{header}`"), types[header]) for header in headers]
    filled = F.lit(False)
    for cell in cells:
        filled = filled | (cell != "")
    return table.filter(filled).select(
        F.col(row_number).cast("bigint").alias("row_number"),
        cells[key_at].alias("key_raw"),
        cells[target_at].alias("target_raw"),
        (F.lit("") if name_at is None else cells[name_at]).alias("name"),
    )


def read_sheet(spark: SparkSession, path: str, key: str, target: str, name: str | None = None) -> DataFrame:
    """Roster rows of a CSV sheet. Row numbers count records from 1, the header included, blank ones too.

    The sheet is one .csv file, or a folder of parts that follow each other by name, the way Spark writes text; the
    header is the first record of the first part then.
    """
    header = _first_record(path, sheet_parts(path))
    places = find_columns(header, key, target, name)
    lines = split_lines(spark, path)
    # One row a split: its lines, where they begin, and what is unusual about them.
    value = F.col("value")
    splits = lines.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("id").alias("first_id"),
        F.count_if(~F.is_valid_utf8(value)).alias("n_unreadable"),
        F.bool_or(~is_whole_record(value)).alias("has_open_lines"),
        F.max(F.length(value) - F.length(F.translate(value, ",", ""))).alias("most_commas"),
    ).cache()
    unreadable, has_open_lines, most_commas = splits.agg(
        F.sum("n_unreadable"), F.bool_or("has_open_lines"), F.max("most_commas")
    ).first()
    if unreadable:
        raise ValueError(f"{path} is not UTF-8: {unreadable} lines hold bytes that mean nothing")
    if has_open_lines:
        return _read_records(lines, places, path)
    return _read_lines(numbered_lines(lines, splits), len(header), places, (most_commas or 0) + 2)


def sheet_parts(path: str) -> list[str]:
    """The files of a sheet in order."""
    if is_folder(path):
        return [part for part in folder_files(path) if not part.rpartition("/")[2].startswith(HIDDEN)]
    if not path.lower().endswith(".csv"):
        raise ValueError(f"Cannot read {path}: only .csv sheets; load workbooks as a table and use roster_from_table")
    if not is_file(path):
        raise FileNotFoundError(f"Sheet not found: {path}")
    if path.rpartition("/")[2].startswith(HIDDEN):
        raise ValueError(f"Spark leaves out files whose names begin with a dot or an underscore; rename {path}")
    return [path]


def is_whole_record(line: Column) -> Column:
    """True where the line is a record by itself: every cell free of quotes, or quoted from end to end.

    Cut at its quotes, such a line has an odd number of parts. Every second part is inside quotes and may hold anything. A
    part between two quoted stretches is empty (a doubled quote) or runs from comma to comma; the first and the last part,
    if not empty, end and begin with one.
    """
    parts = F.split(line, '"', -1)
    last = F.size(parts) - 1

    def wrong(part: Column, at: Column) -> Column:
        begins = (at == 0) | part.startswith(",")
        ends = (at == last) | part.endswith(",")
        return (at % 2 == 0) & (part != "") & ~(begins & ends)

    return ~line.contains('"') | ((last % 2 == 0) & (F.size(F.filter(parts, wrong)) == 0))


def is_blank_record(line: Column) -> Column:
    """True where no cell of a whole record holds anything but whitespace."""
    return F.translate(F.regexp_replace(line, QUOTED_BLANK, ""), WHITESPACE + ",", "") == ""


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file, or of the files of a folder: (split, id, value). Split and id give their order."""
    # A name means itself here; Spark would take some signs for a pattern.
    named = "".join(f"\\{sign}" if sign in PATTERN_SIGNS else sign for sign in path)
    return spark.read.text(named).select(
        "value",
        F.struct("_metadata.file_path", "_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"),
    )


def numbered_lines(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, id, value) lines with their numbers from 1: (row_number, value).

    Each split counts its own lines (``splits``: split, n, first_id); the counts before it are added. Only those counts, one
    per split, are ordered, and Spark decides by their size how they are joined.
    """
    offsets = _with_count_before(splits, "split").select("split", "first_id", "before")
    number = F.col("before") + F.col("id") - F.col("first_id") + 1
    return lines.join(offsets, "split").select(number.alias("row_number"), "value")


def _with_count_before(counts: DataFrame, order: str) -> DataFrame:
    before = F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("before", F.coalesce(before, F.lit(0)))


def _first_record(path: str, parts: list[str]) -> list[str]:
    for part in parts:
        with _text_stream(part) as lines:
            for header in csv.reader(lines):
                return header
    raise ValueError(f"Sheet is empty: {path}")


def _text_stream(path: str) -> io.TextIOWrapper:
    store, inner = open_store(path)
    return io.TextIOWrapper(store.open_input_file(inner), encoding="utf-8-sig", newline="")


def _read_lines(lines: DataFrame, width: int, places: Places, most_cells: int) -> DataFrame:
    options = {**CSV_OPTIONS, "maxColumns": str(max(most_cells, width))}
    record = F.from_csv("value", ", ".join(f"c{at} string" for at in range(width)), options)

    def cell(at: int | None) -> Column:
        return F.lit("") if at is None else clean_cell(F.col("record")[f"c{at}"])

    return (
        lines.filter((F.col("row_number") > 1) & ~is_blank_record(F.col("value")))
        .select("row_number", record.alias("record"))
        .select(
            F.col("row_number").cast("bigint").alias("row_number"),
            *[cell(at).alias(column) for column, at in zip(RAW_COLUMNS, places)],
        )
    )


def _read_records(lines: DataFrame, places: Places, path: str) -> DataFrame:
    """Roster rows where a record may take several lines."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            found = []
            for number, record in zip(batch["row_number"], batch["value"]):
                parsed = next(csv.reader(io.StringIO(record, newline="")), [])
                if any(cell.strip() for cell in parsed):
                    found.append((number, *[parsed[at] if at is not None and at < len(parsed) else "" for at in places]))
            yield pd.DataFrame(found, columns=["row_number", *RAW_COLUMNS])

    texts = ", ".join(f"{column} string" for column in RAW_COLUMNS)
    raw = numbered_records(lines, path).filter("row_number > 1").mapInPandas(cells, f"row_number bigint, {texts}")
    return raw.select("row_number", *[clean_cell(column).alias(column) for column in RAW_COLUMNS])


@F.pandas_udf(T.IntegerType())
def line_effect(lines: pd.Series) -> pd.Series:
    """What a line does to the state "inside a quoted cell": sets it to 0 or 1, keeps it, or flips it."""
    csv.field_size_limit(sys.maxsize)

    def inside_after(*start: str) -> bool:
        # The letter is a record of its own, unless the line break before it belongs to a cell.
        return len(list(csv.reader([*start, "x"]))) == 1

    def effect(line: str) -> int:
        if '"' not in line:
            return KEEP
        from_outside, from_inside = inside_after(line + "\n"), inside_after('"\n', line + "\n")
        if from_outside == from_inside:
            return int(from_outside)
        return FLIP if from_outside else KEEP

    return lines.map(effect)


def numbered_records(lines: DataFrame, path: str = "the sheet") -> DataFrame:
    """(split, id, value) lines -> (row_number, value) records, whatever line breaks their cells hold.

    Where a record begins depends on all lines before it, but a line only ever sets, keeps or flips one bit of state. So
    each split works out its own effect on that bit, the splits are chained (one row per split), and then every split
    knows the state it starts in and numbers its records by itself.
    """
    in_split = Window.partitionBy("split").orderBy("id")
    marked = _with_state(lines.withColumn("effect", line_effect("value")), in_split)
    splits = marked.groupBy("split").agg(F.max_by(_as_effect(), "id").alias("effect"))
    chained = _with_state(splits, Window.orderBy("split"))
    at_end = chained.select("split", _state_after(F.lit(0)).alias("inside")).orderBy(F.desc("split")).first()
    if at_end and at_end["inside"]:
        begun = marked.filter(F.col("effect") != KEEP).agg(F.max("id")).first()[0]
        line = marked.filter(F.col("id") == begun).select("value").first()[0]
        raise ValueError(f"{path} ends inside a quoted cell; the last quote that counts is in the line {line[:100]!r}")
    starts = chained.select(
        "split", F.lag(_state_after(F.lit(0)), 1, 0).over(Window.orderBy("split")).alias("start")
    )
    state = marked.join(starts, "split").withColumn(
        "begins", (F.lag(_state_after(F.col("start"))).over(in_split).eqNullSafe(0))
        | (F.row_number().over(in_split) == 1) & (F.col("start") == 0)
    )
    counted = state.withColumn("in_split", F.sum(F.col("begins").cast("bigint")).over(in_split))
    counts = counted.groupBy("split").agg(F.max("in_split").alias("n"))
    before = _with_count_before(counts, "split").drop("n")
    numbered = counted.join(before, "split").withColumn("row_number", F.col("in_split") + F.col("before"))
    pieces = F.array_sort(F.collect_list(F.struct("split", "id", "value")))
    text = F.array_join(F.transform(pieces, lambda piece: piece["value"]), "\n")
    return numbered.groupBy("row_number").agg(text.alias("value"))


def _with_state(rows: DataFrame, order) -> DataFrame:
    """Adds the flips so far, and the last effect that set the state with the flips up to there."""
    effect = F.col("effect")
    return rows.withColumn("flips", F.sum((effect == FLIP).cast("int")).over(order)).withColumn(
        "last_set", F.last(F.when(effect < KEEP, F.struct("effect", "flips")), ignorenulls=True).over(order)
    )


def _state_after(start: Column) -> Column:
    set_to, flips_then = F.col("last_set")["effect"], F.col("last_set")["flips"]
    return F.when(set_to.isNull(), (start + F.col("flips")) % 2).otherwise((set_to + F.col("flips") - flips_then) % 2)


def _as_effect() -> Column:
    """All rows so far as one effect."""
    flipped = F.when(F.col("flips") % 2 == 1, FLIP).otherwise(KEEP)
    return F.when(F.col("last_set").isNull(), flipped).otherwise(_state_after(F.lit(0)))
