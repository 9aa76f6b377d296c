"""Registered queries that go through real files.

Every query writes its files in tasks, from whole tables, into a folder of its own below the shared folder of the
session, and reads or copies them with the operators under test.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymatch import fixtures as X
from tallymatch import labels as L
from tallymatch.operators import audit as A
from tallymatch.operators import sinks
from tallymatch.operators.files import copy_files, tasks_for
from tallymatch.operators.keyed import keyed_roster
from tallymatch.plans.reconcile import reconcile
from tallymatch.plans.run import Settings, apply, run
from tallymatch.plans.staging import Stage
from tallymatch.sources import archives, listing
from tallymatch.sources.folders import list_folder
from tallymatch.sources.sheets import read_sheet
from tallymatch.sources.storage import Aside, content_hash, make_folder, open_store, plain_path, write_into_place
from tallymatch.streaming.arrivals import Arrivals

Query = Callable[[SparkSession, str], DataFrame]

TASKS = 8
#: The files that are withdrawn in ``reconcile_changes``.
WITHDRAWN = "size % 70 = 0"


def write_files(table: DataFrame, stage: Stage) -> DataFrame:
    """(path, content) -> one file per distinct path, written by the tasks that hold the rows."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Aside(str(TaskContext.get().taskAttemptId())) as aside:
            for batch in batches:
                for path, content in zip(batch["path"], batch["content"]):
                    write_into_place(io.BytesIO(content.encode()), path, aside)
                yield batch[["path"]]

    # Written again, a file would be replaced, for which the file system holds its folder until the new bytes have their place on disk.
    spread = table.repartition(table.sparkSession.sparkContext.defaultParallelism, "path").dropDuplicates(["path"])
    return stage.save(spread.mapInPandas(write, "path string"), "written")


def asset_files(spark: SparkSession, folder: str, stage: Stage) -> str:
    """The assets as real files; the content of each says which file it is. Returns the folder."""
    root = plain_path(stage.path("assets"))
    listing = X.view(spark, folder, X.ASSETS).select(
        F.concat(F.lit(f"{root}/"), "path").alias("path"), F.concat(F.lit("img "), "path").alias("content")
    )
    write_files(listing, stage)
    return root


def roster_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the sheet, dealt out: a table in one small file would else be cleaned by one task."""
    return X.view(spark, folder, X.ROSTER).repartition(spark.sparkContext.defaultParallelism, "row_number")


def below(root: str, path: str) -> Column:
    """The path without the folder of this run."""
    return F.when(F.col(path).startswith(f"{root}/"), F.substr(F.col(path), F.lit(len(root) + 2))).otherwise(F.col(path))


def folder_scan_recursive(spark: SparkSession, folder: str) -> DataFrame:
    stage = Stage(spark)
    root = asset_files(spark, folder, stage)
    return list_folder(spark, root, stage, recursive=True).select(below(root, "path").alias("path"), "size")


def folder_scan(spark: SparkSession, folder: str) -> DataFrame:
    stage = Stage(spark)
    root = asset_files(spark, folder, stage)
    # Folders below it are not looked into: those of the assets, and one with a copy of every listed name.
    deeper = list_folder(spark, f"{root}/files/a", stage)
    deeper = deeper.select(F.regexp_replace("path", "/files/a/", "/files/a/deeper/").alias("path"), F.lit("x").alias("content"))
    write_files(deeper, stage)
    flat = list_folder(spark, f"{root}/files/a", stage).unionByName(list_folder(spark, f"{root}/files/a-x", stage))
    return flat.unionByName(list_folder(spark, f"{root}/files", stage)).select(below(root, "path").alias("path"), "size")


def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    """The tree as a data source, with a filter that the source applies itself."""
    stage = Stage(spark)
    root = asset_files(spark, folder, stage)
    listing.register(spark)
    table = spark.read.format(listing.NAME).options(path=root, recursive=True, depth=1).load()
    return table.filter(F.col("suffix").isin(".jpg", ".jpeg")).select(below(root, "path").alias("path"), "name", "suffix", "size")


def run_on_files(spark: SparkSession, folder: str, runs: list[Settings]) -> tuple[DataFrame, str, str, Stage]:
    """The roster against real files, applied once per entry of ``runs``; the audit of the last one."""
    stage = Stage(spark)
    root, out = asset_files(spark, folder, stage), plain_path(stage.path("out"))
    listing = list_folder(spark, root, stage, recursive=True)
    match = reconcile(roster_rows(spark, folder), listing, out, stage=stage)
    decided = stage.save(match.decided, "decided")
    for settings in runs:
        outcome = apply(decided, out, settings, stage, match.assets)
    table = A.audit_table(outcome, match.orphans)
    columns = [name for name in A.COLUMNS if name not in ("source", "destination")]
    result = table.select(
        *columns, below(root, "source").alias("source"),
        F.when(F.col("destination") != "", F.concat(F.lit("out/"), below(out, "destination")))
        .otherwise("").alias("destination"),
    )
    return result, root, out, stage


def copies_applied(spark: SparkSession, folder: str) -> DataFrame:
    return run_on_files(spark, folder, [Settings()])[0]


def copies_repeated(spark: SparkSession, folder: str) -> DataFrame:
    return run_on_files(spark, folder, [Settings(), Settings(verify=True)])[0]


def copies_conflict(spark: SparkSession, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Where other files, of other sizes, are at the destinations of every third row."""
    stage = Stage(spark)
    root, out = asset_files(spark, folder, stage), plain_path(stage.path("out"))
    match = reconcile(roster_rows(spark, folder), list_folder(spark, root, stage, recursive=True), out, stage=stage)
    decided = stage.save(match.decided, "decided")
    others = decided.filter((F.col("status") == L.PLANNED) & (F.col("row_number") % 3 == 0))
    write_files(others.select(F.col("destination").alias("path"), F.lit("another file").alias("content")), stage)
    outcome = stage.save(apply(decided, out, settings, stage, match.assets), "outcome")
    there = hashed(list_folder(spark, out, stage)).select(F.col("path").alias("destination"), "sha256")
    return outcome.filter("destination <> ''").join(there, "destination", "left").select("row_number", "status", "detail", "sha256")


def copies_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    return copies_conflict(spark, folder, Settings(overwrite=True))


def copies_failed(spark: SparkSession, folder: str) -> DataFrame:
    """Where the files of every third row are gone before they are copied."""
    stage = Stage(spark)
    root, out = asset_files(spark, folder, stage), plain_path(stage.path("out"))
    match = reconcile(roster_rows(spark, folder), list_folder(spark, root, stage, recursive=True), out, stage=stage)
    gone = F.when(F.col("row_number") % 3 == 0, F.concat("source", F.lit(".gone"))).otherwise(F.col("source"))
    planned = F.col("status") == L.PLANNED
    decided = match.decided.withColumn("source", F.when(planned, gone).otherwise(F.col("source")))
    outcome = apply(stage.save(decided, "decided"), out, Settings(), stage, match.assets)
    word = F.regexp_extract("detail", "^[A-Za-z]+", 0)
    detail = F.when(F.col("status") == L.COPY_FAILED, word).otherwise(F.col("detail"))
    return outcome.select("row_number", "status", detail.alias("detail"))


def run_on_tables(spark: SparkSession, folder: str) -> DataFrame:
    """A whole run, without copies, on a table of rows and a table of files."""
    stage = Stage(spark)
    rows, files = X.view(spark, folder, X.ROSTER), X.view(spark, folder, X.ASSETS)
    return run(spark, files, rows, "out", Settings(dry_run=True), stage=stage).audit.select(*A.COLUMNS)


def copies_dry(spark: SparkSession, folder: str) -> DataFrame:
    return run_on_files(spark, folder, [Settings(dry_run=True)])[0]


def existing_scan(spark: SparkSession, folder: str) -> DataFrame:
    _, _, out, stage = run_on_files(spark, folder, [Settings()])
    there = hashed(list_folder(spark, out, stage))
    return there.select(F.concat(F.lit("out/"), below(out, "path")).alias("destination"), "size", "sha256")


def hashed(listing: DataFrame) -> DataFrame:
    """The files with the SHA-256 of their bytes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(sha256=[content_hash(path) for path in batch["path"]])

    files = listing.select("path", "size")
    files = files.repartition(tasks_for(files.sparkSession, files.count()))
    return files.mapInPandas(read, "path string, size bigint, sha256 string")


def sheet_scan(spark: SparkSession, folder: str) -> DataFrame:
    stage = Stage(spark)
    rows = X.view(spark, folder, X.ROSTER)

    def quoted(column: str) -> Column:
        return F.concat(F.lit('"'), F.regexp_replace(column, '"', '""'), F.lit('"'))

    # Record 1 is the header, a blank line follows every row, every tenth row is short and every ninth has a cell too many.
    number = F.col("row_number") * 2
    line = (
        F.when(F.col("row_number") % 10 == 0, F.col("key_raw"))
        .when(F.col("row_number") % 9 == 0, F.concat_ws(",", "key_raw", "target_raw", quoted("name"), F.lit("x")))
        .otherwise(F.concat_ws(",", quoted("key_raw"), "target_raw", "name"))
    )
    records = rows.select(number.alias("at"), line.alias("value")).unionByName(
        rows.select((number + 1).alias("at"), F.when(F.col("row_number") % 2 == 0, " , ,").otherwise("").alias("value"))
    )
    top = spark.createDataFrame([(1, "KEY no.,Target-No,Name"), (2, ""), (3, "")], "at bigint, value string")
    path = stage.path("sheet")
    records.unionByName(top).repartitionByRange(TASKS, "at").sortWithinPartitions("at").select("value").write.text(path)
    return read_sheet(spark, path, "Key No", "target no", "NAME")


def archive_scan(spark: SparkSession, folder: str) -> DataFrame:
    stage = Stage(spark)
    entries = archives.archive_entries(document_archives(spark, folder, stage))
    safe = archives.safe_entries(entries)
    return entries.join(safe.select("archive", "ordinal", "place"), ["archive", "ordinal"], "left").select(
        "entry", "size", "place"
    )


def archive_extract(spark: SparkSession, folder: str) -> DataFrame:
    stage = Stage(spark)
    root = plain_path(stage.path("extracted"))
    entries = archives.archive_entries(document_archives(spark, folder, stage))
    written = stage.save(archives.extract(entries, root, TASKS), "extracted-files")
    found = hashed(list_folder(spark, root, stage, recursive=True))
    return found.join(written, ["path", "size"]).select(below(root, "path").alias("path"), "size", "sha256")


def document_archives(spark: SparkSession, folder: str, stage: Stage) -> DataFrame:
    """The documents in zip archives, one per task, with an unsafe entry, a step back and a folder here and there."""
    root = plain_path(stage.path("archives"))
    make_folder(root)
    name = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    entry = (
        F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("../"), name))
        .when(F.col("doc_id") % 10 == 4, F.concat(F.lit("/"), name))
        .when(F.col("doc_id") % 10 == 5, F.concat(F.lit("x/./../"), name))
        .otherwise(name)
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = f"{root}/part-{TaskContext.get().partitionId()}.zip"
        store, inner = open_store(path)
        with store.open_output_stream(inner) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as opened:
            opened.writestr("lang/", b"")
            for batch in batches:
                for entry, text in zip(batch["entry"], batch["text"]):
                    opened.writestr(entry, text)
        yield pd.DataFrame({"path": [path]})

    documents = X.table(spark, folder, "documents").select(entry.alias("entry"), "text").repartition(TASKS, "entry")
    return stage.save(documents.mapInPandas(pack, "path string"), "archive-paths")


def report_csv(spark: SparkSession, folder: str) -> DataFrame:
    stage = Stage(spark)
    path = stage.path("report")
    match = reconcile(X.view(spark, folder, X.ROSTER), X.view(spark, folder, X.ASSETS), "out", stage=stage)
    sinks.write_report(match.audit, path)
    texts = ", ".join(f"{name} string" for name in A.COLUMNS)
    read = spark.read.schema(texts).options(header=True, quote='"', escape='"', nullValue="\0").csv(path)
    return read.withColumns({name: F.coalesce(name, F.lit("")) for name in A.COLUMNS})


def report_one_file(spark: SparkSession, folder: str) -> DataFrame:
    """The report as one file, read back."""
    stage = Stage(spark)
    path = f"{plain_path(stage.path('report'))}.csv"
    match = reconcile(X.view(spark, folder, X.ROSTER), X.view(spark, folder, X.ASSETS), "out", stage=stage)
    sinks.write_report_file(match.audit, path, stage, files=TASKS)
    texts = ", ".join(f"{name} string" for name in A.COLUMNS)
    read = spark.read.schema(texts).options(header=True, quote='"', escape='"', nullValue="\0").csv(path)
    return read.withColumns({name: F.coalesce(name, F.lit("")) for name in A.COLUMNS})


def copies_by_size(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of files of very unequal size: the texts of all documents, the longer ones in ranges; what is at the destinations then."""
    stage = Stage(spark)
    root, out = plain_path(stage.path("texts")), plain_path(stage.path("out"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    texts = X.table(spark, folder, "documents").select(F.concat(F.lit(f"{root}/"), name).alias("path"), F.col("text").alias("content"))
    write_files(texts, stage)
    make_folder(out)
    rows = list_folder(spark, root, stage).select(
        F.col("path").alias("source"), F.concat(F.lit(f"{out}/"), F.substring_index("path", "/", -1)).alias("destination"),
        "size", F.lit("").alias("status"), F.lit("").alias("detail"),
    )
    copied = copy_files(rows, stage, range_bytes=4_000)
    there = hashed(list_folder(spark, out, stage)).withColumnRenamed("path", "destination")
    found = copied.drop("size").join(there, "destination", "full")
    return found.select(below(out, "destination").alias("name"), "size", "sha256", "status", "detail")


def audit_store(spark: SparkSession, folder: str) -> DataFrame:
    stage = Stage(spark)
    path = stage.path("audit")
    match = reconcile(X.view(spark, folder, X.ROSTER), X.view(spark, folder, X.ASSETS), "out", stage=stage)
    sinks.write_audit(match.audit, path)
    return sinks.read_audit(spark, path).select(*A.COLUMNS)


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    stage = Stage(spark)
    incoming = stage.path("incoming")
    listing = X.view(spark, folder, X.ASSETS)
    # Files of one key come in different listings, so that later batches change earlier decisions. A listing grows with the input, the
    # number of batches does not: each costs a commit of every partition of the state.
    listing.repartition(TASKS, "path").write.parquet(incoming)
    running = Arrivals(keyed_roster(X.view(spark, folder, X.ROSTER)), "out", stage.path("state"))
    # One listing a batch.
    stream = running.start(incoming, most_files=1)
    stream.awaitTermination()
    return running.audit().select(*A.COLUMNS)


def reconcile_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides change: all files arrive, every seventh is withdrawn; every fifth row goes, every sixth gets a new target."""
    stage = Stage(spark)
    incoming, changes = stage.path("incoming"), stage.path("changes")
    listing, rows = X.view(spark, folder, X.ASSETS), X.view(spark, folder, X.ROSTER)
    comes, goes = F.lit(1).alias("change"), F.lit(-1).alias("change")
    listing.select("*", comes).repartition(2, "path").write.parquet(incoming)
    number = F.col("row_number")
    old = rows.filter((number % 5 == 0) | (number % 6 == 0)).select("*", goes)
    new = rows.filter((number % 5 != 0) & (number % 6 == 0)).withColumn("target_raw", F.concat("target_raw", F.lit("b"))).select("*", comes)
    old.coalesce(1).write.parquet(changes)
    running = Arrivals(keyed_roster(rows), "out", stage.path("state"))
    running.start(incoming, most_files=1, rows=changes).awaitTermination()
    listing.filter(WITHDRAWN).select("*", goes).coalesce(1).write.mode("append").parquet(incoming)
    new.coalesce(1).write.mode("append").parquet(changes)
    running.start(incoming, most_files=1, rows=changes).awaitTermination()
    return running.audit(stage).select(*A.COLUMNS)


def queries() -> dict[str, Query]:
    return {
        "folder_scan": folder_scan,
        "folder_scan_recursive": folder_scan_recursive,
        "file_listing": file_listing,
        "sheet_scan": sheet_scan,
        "archive_scan": archive_scan,
        "archive_extract": archive_extract,
        "copies_applied": copies_applied,
        "copies_repeated": copies_repeated,
        "copies_dry": copies_dry,
        "copies_conflict": copies_conflict,
        "copies_overwrite": copies_overwrite,
        "copies_failed": copies_failed,
        "run_on_tables": run_on_tables,
        "existing_scan": existing_scan,
        "report_csv": report_csv,
        "report_one_file": report_one_file,
        "copies_by_size": copies_by_size,
        "audit_store": audit_store,
        "arrivals": arrivals,
        "reconcile_changes": reconcile_changes,
    }


def oracle_sql(both: str) -> dict[str, str]:
    """``both`` holds the common tables of the match, up to ``decided``, ``orphans`` and ``audit``."""

    def applied(status: str, detail: str) -> str:
        return f"""
            {both} select row_number, key_raw, target_raw, name, source, destination,
              case status when 'PLANNED' then '{status}' else status end as status,
              case status when 'PLANNED' then '{detail}' else detail end as detail
            from audit"""

    files = f"with listing as ({X.ASSETS}) select distinct path, cast(strlen(path) + 4 as bigint) as size from listing"
    named = """
        with named as (select doc_id, text, concat(lang, '/', doc_id, '.txt') as name from documents),
        entries as (
          select case doc_id % 10 when 3 then concat('../', name) when 4 then concat('/', name)
                                  when 5 then concat('x/./../', name) else name end as entry,
            cast(strlen(text) as bigint) as size, sha256(text) as sha256, case when doc_id % 10 not in (3, 4) then name end as place
          from named)"""
    return {
        "folder_scan": files,
        "folder_scan_recursive": files,
        "file_listing": f"""
            with listed as ({files}), named as (select *, split_part(path, '/', -1) as name from listed)
            select path, name, lower(regexp_extract(name, '.(\\.[^.]+)$', 1)) as suffix, size from named
            where lower(regexp_extract(name, '.(\\.[^.]+)$', 1)) in ('.jpg', '.jpeg')""",
        "sheet_scan": f"""
            {both} select row_number * 2 as row_number, key_raw,
              case when row_number % 10 = 0 then '' else target_raw end as target_raw,
              case when row_number % 10 = 0 then '' else name end as name
            from roster where key_raw <> '' or row_number % 10 <> 0""",
        "archive_scan": f"{named} select entry, size, place from entries",
        "archive_extract": f"{named} select place as path, size, sha256 from entries where place is not null",
        "copies_applied": applied(L.APPLIED, ""),
        "copies_repeated": applied(L.ALREADY_DONE, "Destination already holds this file"),
        "copies_dry": applied(L.PLANNED, "Dry run: nothing written"),
        "copies_conflict": f"""
            {both} select row_number, case when row_number % 3 = 0 then 'TARGET_CONFLICT' else 'APPLIED' end as status,
              case when row_number % 3 = 0 then 'Destination holds another file' else '' end as detail,
              sha256(case when row_number % 3 = 0 then 'another file' else concat('img ', source) end) as sha256
            from decided where status = 'PLANNED'""",
        "copies_overwrite": f"""
            {both} select row_number, 'APPLIED' as status, '' as detail, sha256(concat('img ', source)) as sha256
            from decided where status = 'PLANNED'""",
        "copies_failed": f"""
            {both} select row_number,
              case when status <> 'PLANNED' then status when row_number % 3 = 0 then 'COPY_FAILED' else 'APPLIED' end as status,
              case when status = 'PLANNED' and row_number % 3 = 0 then 'FileNotFoundError' else detail end as detail
            from decided""",
        "run_on_tables": applied(L.PLANNED, "Dry run: nothing written"),
        "existing_scan": f"""
            {both} select destination, cast(strlen(source) + 4 as bigint) as size, sha256(concat('img ', source)) as sha256
            from decided
            where status = 'PLANNED'""",
        "report_csv": f"""
            {both} select coalesce(cast(row_number as varchar), '') as row_number, key_raw, target_raw, name, status,
              source, destination, detail
            from audit""",
        "report_one_file": f"""
            {both} select coalesce(cast(row_number as varchar), '') as row_number, key_raw, target_raw, name, status,
              source, destination, detail
            from audit""",
        "copies_by_size": """
            select concat(doc_id, '.txt') as name, cast(strlen(text) as bigint) as size, sha256(text) as sha256,
              'APPLIED' as status, '' as detail
            from documents""",
        "audit_store": f"{both} select * from audit",
        "arrivals": f"{both} select * from audit",
        "reconcile_changes": both.replace(
            X.ROSTER,
            "select row_number, key_raw, case when row_number % 6 = 0 then concat(target_raw, 'b') else target_raw end as target_raw, name"
            f" from ({X.ROSTER}) where row_number % 5 <> 0",
        ).replace(X.ASSETS, f"select * from ({X.ASSETS}) where not ({WITHDRAWN})") + " select * from audit",
    }
