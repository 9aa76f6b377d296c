"""A running audit: rows and files come and go as streams, and the counts behind every decision are kept in Spark's state store.

What a row is decided from is few numbers: how many rows have its key, how many its target, how many files carry the key, and
the path where there is one. Each event, a row or a file that arrives or is withdrawn, adds to these numbers or takes from them. One
streaming aggregation keeps them: signed sums for each key and each target, in the state store, so a batch reads its own events and
nothing else, however long the stream has run.

The path behind a single file has to survive withdrawals too. Besides the least path that came, which is right while none has been
withdrawn, the state holds the signed sum of the hashes of the paths: where one file is left, that is its hash, and its path is
looked up among the listings by key and hash.

The audit reads the counts from the state store and decides the rows that are there now, by the same functions as a batch
match does. The listings stay where they came in; the state knows which of them it has taken, so an audit never mixes what
is counted with what is yet to come. Withdrawn are rows and files as they came, by all their columns and by their path; a changed row is
one withdrawn and one that arrives.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymatch.functions.text import fold_case
from tallymatch.operators.audit import COLUMNS, audit_table
from tallymatch.operators.groups import key_counts, open_groups, repeated, target_counts
from tallymatch.operators.keyed import DEFAULT_SUFFIXES, keyed_roster, marked_assets
from tallymatch.operators.matching import ROW_COLUMNS, Counts, decide, orphans
from tallymatch.operators.spread import Limits
from tallymatch.plans.staging import Stage
from tallymatch.sources.storage import is_file, is_folder

#: change: 1 for one that arrives, as in listings without this column, -1 for one that is withdrawn.
FILES = "path string, size bigint, change int"
ROWS = "row_number bigint, key_raw string, target_raw string, name string, change int"

KEY, TARGET, LISTING = "key", "target", "listing"
#: What the aggregation keeps, in order: rows, files, sum of path hashes, withdrawals of files, least path.
STATE = "struct<n_rows:bigint,n_assets:bigint,marks:decimal(30,0),empty:boolean,withdrawn:bigint,path:string>"


def mark(path: Column) -> Column:
    """A number that stands for a path; sums of it are exact."""
    return F.xxhash64(path).cast("decimal(20,0)")


def entry(kind: str, name: Column, **numbers: Column) -> Column:
    """What an event adds to one entry of the state."""
    none = F.lit(0).cast("bigint")
    return F.struct(
        F.lit(kind).alias("kind"),
        name.alias("name"),
        numbers.get("n_rows", none).alias("n_rows"),
        numbers.get("n_assets", none).alias("n_assets"),
        numbers.get("marks", F.lit(0)).cast("decimal(20,0)").alias("marks"),
        numbers.get("withdrawn", none).alias("withdrawn"),
        numbers.get("path", F.lit(None).cast("string")).alias("path"),
    )


def entries(events: DataFrame, *parts: Column) -> DataFrame:
    named = F.filter(F.array(*parts), lambda part: part["name"].isNotNull())
    return events.select(F.explode(named).alias("entry")).select("entry.*")


@dataclass
class Arrivals:
    """A running audit. ``roster`` are the keyed rows that are there at the start, ``folder`` is where the files are to go.

    ``state`` is a folder in shared storage that holds its tables and the progress of the stream. Started again on the
    same folder, with the same roster, it goes on where it was.
    """

    roster: DataFrame
    folder: str
    state: str
    suffixes: Sequence[str] = DEFAULT_SUFFIXES
    zeros: bool = False
    limits: Limits = Limits()

    def __post_init__(self) -> None:
        self.spark: SparkSession = self.roster.sparkSession
        counts, targets = f"{self.state}/counts", f"{self.state}/targets"
        self.progress = f"{self.state}/progress"
        # What the roster counts before anything has changed is stored once, the second table last.
        if not is_file(f"{targets}/_SUCCESS"):
            key_counts(self.roster).write.mode("overwrite").parquet(counts)
            target_counts(self.roster).write.mode("overwrite").parquet(targets)
        self.key_counts, self.target_counts = self.spark.read.parquet(counts), self.spark.read.parquet(targets)
        self.incoming: str | None = None
        self.incoming_rows: str | None = None

    def start(
        self, incoming: str, most_files: int | None = None, rows: str | None = None, **trigger
    ) -> StreamingQuery:
        """Follow a folder of parquet listings (``FILES``); by default work off what is there, then stop.

        ``rows`` is a folder of changes to the roster (``ROWS``). ``most_files`` listings are one batch at most. A stream that has been started with or
        without ``rows`` goes on that way.
        """
        self.incoming, self.incoming_rows = incoming, rows
        source = self.spark.readStream.options(**({"maxFilesPerTrigger": most_files} if most_files else {}))
        added = self._of_files(source.schema(FILES).parquet(incoming))
        if rows:
            added = added.unionByName(self._of_rows(source.schema(ROWS).parquet(rows)))
        names = ("n_rows", "n_assets", "marks", "withdrawn")
        kept = added.groupBy("kind", "name").agg(*(F.sum(name).alias(name) for name in names), F.min("path").alias("path"))
        return (
            kept.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", self.progress)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def counts(self) -> DataFrame:
        """The state after the last batch: kind, name, n_rows, n_assets, marks, withdrawn, path. Counts the changes alone."""
        names = "kind string, name string, n_rows bigint, n_assets bigint, marks decimal(30,0), withdrawn bigint, path string"
        if not is_folder(f"{self.progress}/state"):
            return self.spark.createDataFrame([], names)
        state = self.spark.read.format("statestore").load(self.progress)
        values = F.col("value").cast(STATE)
        fields = [values[name].alias(name) for name in ("n_rows", "n_assets", "marks", "withdrawn", "path")]
        return state.select("key.kind", "key.name", *fields)

    def audit(self, stage: Stage | None = None) -> DataFrame:
        """The audit as of the last batch, equal to that of a batch match of the rows and files that are there now."""
        stage = stage or Stage(self.spark)
        state = stage.save(self.counts(), "state")
        files, rows = self._files(state), self._rows(state)
        ledger, targets, rows = stage.save_all(
            ledger=self._ledger(state, files), targets=repeated(self._targets(state), "n_targets"), rows=rows
        )
        counts = Counts(ledger, targets, stage.save(open_groups(ledger), "groups"))
        left = orphans(self._present(files), counts, self.limits)
        return audit_table(decide(rows, counts, self.folder, self.limits), left).select(*COLUMNS, "key")

    def _of_files(self, events: DataFrame) -> DataFrame:
        change = F.coalesce("change", F.lit(1)).cast("bigint")
        marked = marked_assets(events, self.suffixes, self.zeros, [change.alias("change"), _listing()])
        gone = F.col("change") < 0
        key = entry(
            KEY,
            F.col("key"),
            n_assets=F.col("change"),
            marks=mark(F.col("path")) * F.col("change").cast("decimal(2,0)"),
            withdrawn=gone.cast("bigint"),
            path=F.when(~gone, F.col("path")),
        )
        return entries(marked, entry(LISTING, F.col("listing")), key)

    def _of_rows(self, events: DataFrame) -> DataFrame:
        change = F.coalesce("change", F.lit(1)).cast("bigint")
        keyed = keyed_roster(events, self.zeros, [change.alias("change"), _listing()])
        folded = fold_case(F.col("target"))
        return entries(
            keyed,
            entry(LISTING, F.col("listing")),
            entry(KEY, F.when(F.col("key") != "", F.col("key")), n_rows=F.col("change")),
            entry(TARGET, F.when(F.col("target") != "", folded), n_rows=F.col("change")),
        )

    def _taken(self, state: DataFrame, folder: str | None, schema: str) -> DataFrame | None:
        """The events that the state counts."""
        if folder is None:
            return None
        listed = state.filter(F.col("kind") == LISTING).select(F.col("name").alias("listing"))
        events = self.spark.read.schema(schema).parquet(folder)
        return events.select("*", _listing()).join(listed, "listing", "left_semi")

    def _files(self, state: DataFrame) -> DataFrame:
        """Files that came or were withdrawn, with their keys."""
        events = self._taken(state, self.incoming, FILES)
        if events is None:
            events = self.spark.createDataFrame([], FILES)
        change = F.coalesce("change", F.lit(1)).cast("bigint").alias("change")
        return marked_assets(events, self.suffixes, self.zeros, [change]).filter(F.col("key").isNotNull())

    def _present(self, files: DataFrame) -> DataFrame:
        """The files that are there. Only paths that were withdrawn at some time are counted."""
        columns = [name for name in files.columns if name != "change"]
        withdrawn = files.filter("change < 0").select("path").distinct()
        never = files.join(withdrawn, "path", "left_anti").select(*columns)
        net = files.join(withdrawn, "path", "left_semi").groupBy("path", "key").agg(
            F.sum("change").alias("n"), *(F.max(name).alias(name) for name in columns if name not in ("path", "key"))
        )
        again = net.filter("n > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        return never.unionByName(again.select(*columns))

    def _rows(self, state: DataFrame) -> DataFrame:
        """The rows that are there: those of the roster that no event names, and what the events leave of the others."""
        events = self._taken(state, self.incoming_rows, ROWS)
        if events is None:
            return self.roster
        change = F.coalesce("change", F.lit(1)).cast("bigint").alias("change")
        changes = keyed_roster(events, self.zeros, [change])
        named = changes.select("row_number").distinct()
        own = self.roster.select(*ROW_COLUMNS)
        before = own.join(named, "row_number", "left_semi").withColumn("change", F.lit(1).cast("bigint"))
        net = before.unionByName(changes).groupBy(*ROW_COLUMNS).agg(F.sum("change").alias("n"))
        return own.join(named, "row_number", "left_anti").unionByName(net.filter("n > 0").select(*ROW_COLUMNS))

    def _ledger(self, state: DataFrame, files: DataFrame) -> DataFrame:
        """key, n_rows, n_assets, path, as a batch match counts them."""
        none = F.lit(0).cast("bigint")
        changed = state.filter(F.col("kind") == KEY).withColumnRenamed("name", "key").drop("kind")
        start = self.key_counts.select(
            "key", "n_rows", none.alias("n_assets"), F.lit(0).cast("decimal(30,0)").alias("marks"), none.alias("withdrawn"),
            F.lit(None).cast("string").alias("path"),
        )
        both = start.unionByName(changed).groupBy("key").agg(
            *(F.sum(name).alias(name) for name in ("n_rows", "n_assets", "marks", "withdrawn")), F.min("path").alias("path")
        )
        both = both.filter("n_rows > 0 or n_assets > 0")
        # One file is left of several: the sum of the marks is the mark of its path.
        sought = both.filter("n_assets = 1 and withdrawn > 0").select("key", "marks")
        left = files.filter("change > 0").select("key", "path", mark(F.col("path")).cast("decimal(30,0)").alias("marks"))
        found = left.join(sought, ["key", "marks"]).groupBy("key").agg(F.min("path").alias("last"))
        path = F.when(F.col("n_assets") > 0, F.coalesce("last", "path"))
        return both.join(found, "key", "left").select("key", "n_rows", "n_assets", path.alias("path"))

    def _targets(self, state: DataFrame) -> DataFrame:
        changed = state.filter(F.col("kind") == TARGET).select(F.col("name").alias("folded"), F.col("n_rows").alias("n_targets"))
        return self.target_counts.unionByName(changed).groupBy("folded").agg(F.sum("n_targets").alias("n_targets"))


def _listing() -> Column:
    """The file that an event came in."""
    return F.col("_metadata.file_path").alias("listing")
