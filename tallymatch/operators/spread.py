"""Lookups that stay even when one key holds a large part of all rows.

``heaviest`` finds the keys that hold the most rows. Its list names a key by a digest of fixed length and has a fixed number
of entries at most, so it can be broadcast whatever the data, and by the pigeonhole principle a key that is not on it holds
less than one part in ``Limits.heavy_keys`` of all rows. ``attach`` answers the rows of listed keys from the broadcast
list and sends the others through an ordinary shuffled join. Rows that need no lookup travel under a key of their own, so
they spread evenly too. ``keep_keys`` is the semi join of that kind.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Sizes that steer the plan. None of them changes what is in any result."""

    # At most this many keys are answered from a broadcast list: 5 MB at the very most.
    heavy_keys: int = 50_000
    # Keys with fewer rows than this never are: a task handles that many rows easily.
    heavy_rows: int = 100_000

    def __post_init__(self) -> None:
        if self.heavy_keys < 1 or self.heavy_rows < 2:
            raise ValueError("A list of heavy keys needs room for one key, and a heavy key has two rows at least")


def digest(key: Column | str) -> Column:
    """What stands for a key on a list of heavy keys."""
    return F.md5(key)


def heaviest(counts: DataFrame, on: str, rows: str, limits: Limits) -> DataFrame:
    """The entries of a one-row-per-key count table with the most rows: digest and the numbers of the table."""
    numbers = [name for name, kind in counts.dtypes if name != on and kind == "bigint"]
    return (
        counts.filter(F.col(rows) >= limits.heavy_rows)
        .select(digest(on).alias("digest"), *numbers)
        .orderBy(F.col(rows).desc(), "digest")
        .limit(limits.heavy_keys)
    )


def own_key(salt: Column) -> Column:
    """A join key that matches nothing: cleaned keys hold no whitespace, this starts with a blank."""
    return F.concat(F.lit(" "), salt.cast("string"))


def attach(
    rows: DataFrame,
    on: str,
    heavy: DataFrame,
    facts: Sequence[DataFrame],
    salt: Column,
    needed: Column | None = None,
) -> DataFrame:
    """Left join of one-row-per-key tables, safe for heavy keys.

    ``heavy`` has the digest and any of the fact columns for the heaviest keys, at most ``Limits.heavy_keys`` rows. A fact
    column is NULL where the key has no entry, where ``needed`` is false, or where the key is heavy and ``heavy`` lacks
    the column. No row on the left is lost or multiplied.
    """
    known = [name for name in heavy.columns if name != "digest"]
    short = heavy.select(
        F.col("digest").alias("heavy_digest"),
        F.lit(True).alias("is_heavy"),
        *[F.col(name).alias(f"heavy_{name}") for name in known],
    )
    open_row = F.col("is_heavy").isNull()
    if needed is not None:
        open_row = open_row & needed
    found = rows.withColumn("heavy_digest", digest(on)).join(F.broadcast(short), "heavy_digest", "left").withColumn(
        "probe", F.when(open_row, F.col(on)).otherwise(own_key(salt))
    )
    added: list[str] = []
    for fact in facts:
        added += [name for name in fact.columns if name != on]
        found = found.join(fact.withColumnRenamed(on, "probe"), "probe", "left")

    def answer(name: str) -> Column:
        if name not in known:
            return F.col(name)
        short_answer = F.col(f"heavy_{name}")
        return (F.coalesce(short_answer, F.col(name)) if name in added else short_answer).alias(name)

    names = dict.fromkeys(added + known)
    return found.select(*rows.columns, *[answer(name) for name in names])


def keep_keys(rows: DataFrame, on: str, keys: DataFrame, heavy: DataFrame) -> DataFrame:
    """Left semi join with a table of keys, safe for heavy keys. ``heavy`` has the heaviest keys of ``rows``.

    Rows of heavy keys never move: they are kept or dropped by the broadcast list. Only the others are shuffled, and
    where the keys are few or selective Spark filters or broadcasts before that.
    """
    wanted = heavy.join(keys.select(digest(on).alias("digest")), "digest", "left_semi")
    marked = rows.withColumn("digest", digest(on))
    hot = marked.join(F.broadcast(wanted.select("digest")), "digest", "left_semi")
    others = marked.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(keys.select(on), on, "left_semi")
    return others.select(*rows.columns).unionByName(hot.select(*rows.columns))
