"""File names and paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix starts at the last dot; a leading or a trailing dot starts none.
SUFFIX = r"(?s)(?<=.)\.[^.]+\z"


def path_parts(path: Column) -> Column:
    """The components of a path. Sorting on them puts ``a/b`` before ``a-x/b``; sorting on the text does not."""
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(name: Column) -> Column:
    """The name without its suffix; the whole name where it has none."""
    return F.regexp_replace(name, SUFFIX, "")


def file_suffix(name: Column) -> Column:
    """The suffix with its dot, or ''."""
    return F.regexp_extract(name, SUFFIX, 0)


def place_in(folder: str, *name: Column) -> Column:
    """The path of a name directly in a folder."""
    root = folder.rstrip("/") or "/"
    return F.concat(F.lit(root if root.endswith("/") else root + "/"), *name)


def target_path(folder: str, target: Column, source_name: Column) -> Column:
    """Where a matched file goes: the row's target plus the lower-cased suffix of the source."""
    return place_in(folder, target, F.lower(file_suffix(source_name)))


def resolves_inside(entry: Column) -> Column:
    """True where a relative entry stays below the root it is joined to.

    Reads the parts from left to right and keeps the depth: absolute entries and any step above the root are refused.
    """
    depth = F.aggregate(
        F.split(entry, "/"),
        F.lit(0),
        lambda at, part: F.when(at < 0, at)
        .when(part.isin("", "."), at)
        .when(part == "..", at - 1)
        .otherwise(at + 1),
    )
    return ~entry.startswith("/") & (depth >= 0)


def resolved_entry(entry: Column) -> Column:
    """The entry with its ``.`` and ``..`` steps taken. For entries that ``resolves_inside`` lets through."""
    steps = F.aggregate(
        F.split(entry, "/"),
        F.array().cast("array<string>"),
        lambda at, part: F.when(part.isin("", "."), at)
        .when(part == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))))
        .otherwise(F.array_append(at, part)),
    )
    return F.array_join(steps, "/")
