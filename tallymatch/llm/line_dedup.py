"""Line dedup with overlapping windows of three lines. DataFrame functions only.

A text is cut at ``\\n``. Each three consecutive lines, of which at least one holds a word, are a window. Of a window that
occurs several times in all texts, the first occurrence stays (smallest id, then smallest line number) and the lines of
the others go, overlapping windows merged. Windows are judged on the input. So a line goes where it is repeated together
with its neighbours; a short line that occurs everywhere by itself stays.

Windows are compared by two 64-bit hashes. Counting combines in each task before it shuffles, and the occurrences of the
repeated windows meet the first ones in an ordinary shuffled join, whose heavy partitions Spark splits at run time. The
covered lines of one document are gathered (no more than the document has), taken off the list of its line numbers as a
set, and what is left is joined again.

Null text: stays null, without lines. Texts of fewer than three lines stay. Null id: smaller than all others. Rows with
the same id are told apart by the hash of their text, which is also their order; rows repeated as a whole are treated
alike. An empty table gives an empty result; columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymatch.llm import tables

LINES = 3
HAS_WORD = r"[^\x20\x09-\x0D]"


def _hashes(lines: Column, seed: int) -> Column:
    return F.transform(lines, lambda line: F.xxhash64(F.lit(seed), line))


def windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id, row, at, one, two: a row for each window."""
    split = F.split("text", "\n")
    hashed = docs.select(
        "doc_id",
        "row",
        F.size(split).alias("n"),
        _hashes(split, 1).alias("first"),
        _hashes(split, 2).alias("second"),
        F.transform(split, lambda line: line.rlike(HAS_WORD)).alias("words"),
    ).filter(F.col("n") >= lines)

    def window(at: Column) -> Column:
        parts = [at + k for k in range(lines)]
        full = F.get("words", parts[0])
        for part in parts[1:]:
            full = full | F.get("words", part)
        return F.struct(
            at.alias("at"),
            F.xxhash64(*(F.get("first", part) for part in parts)).alias("one"),
            F.xxhash64(*(F.get("second", part) for part in parts)).alias("two"),
            full.alias("full"),
        )

    starts = F.sequence(F.lit(0), F.col("n") - lines)
    exploded = hashed.select("doc_id", "row", F.explode(F.transform(starts, window)).alias("w"))
    return exploded.filter("w.full").select("doc_id", "row", "w.at", "w.one", "w.two")


def remove_repeated_lines(docs: DataFrame, lines: int = LINES, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text (the kept lines), n_lines, n_removed; a row for each row of ``docs``, with the columns to carry."""
    carried = F.struct(*(F.col(f"`{name}`") for name in carry)) if carry else F.lit(None)
    docs = docs.select(
        tables.known_id().alias("doc_id"), "text", F.xxhash64("text").alias("row"), carried.alias("carried")
    )
    found = windows(docs, lines)
    place = F.struct("doc_id", "row", "at")
    firsts = found.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least"))
    firsts = firsts.filter("n > 1").select("one", "two", "least")
    later = found.join(firsts, ["one", "two"]).filter(place > F.col("least"))
    covered = later.groupBy("doc_id", "row").agg(F.collect_set("at").alias("starts"))

    met = docs.join(covered, ["doc_id", "row"], "left")
    split = F.split("text", "\n")
    gone = F.flatten(F.transform("starts", lambda at: F.array(*(at + k for k in range(lines)))))
    rest = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
    met = met.withColumn("rest", F.when(F.col("starts").isNotNull(), rest))
    left = F.array_join(F.transform("rest", lambda at: F.get(split, at)), "\n")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long")
    n_rest = F.coalesce(F.size("rest").cast("long"), n_lines)
    return met.select(
        tables.given_id().alias("doc_id"),
        F.when(F.col("rest").isNull(), F.col("text")).otherwise(left).alias("text"),
        n_lines.alias("n_lines"),
        (n_lines - F.when(F.col("rest").isNull(), n_lines).otherwise(n_rest)).alias("n_removed"),
        *(F.col("carried")[name].alias(name) for name in carry),
    )


def op3_line_dedup(spark, folder: str) -> DataFrame:
    return remove_repeated_lines(tables.table(spark, folder, "documents"))


OP3_SQL = r"""
with split as (
  select doc_id, text, string_split(text, chr(10)) as lines from documents),
listed as (
  select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from split),
windows as (
  select doc_id, pos, line as one, lead(line) over d as two, lead(line, 2) over d as three
  from listed window d as (partition by doc_id order by pos)),
ranked as (
  select doc_id, pos, row_number() over (partition by one, two, three order by doc_id, pos) as n
  from windows
  where three is not null and regexp_matches(concat(one, two, three), '[^\x20\x09-\x0D]')),
gone as (
  select distinct doc_id, pos + step as pos from ranked, (values (0), (1), (2)) as steps (step) where n > 1),
kept as (
  select l.doc_id, string_agg(line, chr(10) order by l.pos) as text, count(*) as n
  from listed l anti join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by 1)
select s.doc_id, coalesce(k.text, case when s.text is not null then '' end) as text,
  cast(coalesce(len(lines), 0) as bigint) as n_lines,
  cast(coalesce(len(lines), 0) - coalesce(k.n, 0) as bigint) as n_removed
from split s left join kept k on s.doc_id = k.doc_id
"""
