"""

Queries start from whole tables, through the inputs defined in ``tallymatch.fixtures``. The SQL below is written on its
own terms (windows and scalar subqueries rather than the ledger and the skew-safe lookups), so that it is a real check.
"""

from __future__ import annotations

import sys
import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The driver may load this file from anywhere.
sys.path.insert(0, str(Path(__file__).resolve().parent))

import file_queries
from tallymatch import fixtures as X
from tallymatch import labels as L
from tallymatch.functions import hashing, paths, text
from tallymatch.operators import audit as A
from tallymatch.operators import groups, keyed, matching, outcomes
from tallymatch.plans.reconcile import Reconciliation, reconcile
from tallymatch.plans.staging import Stage

try:
    import corpus_pipeline
    from tallymatch.llm import queries as llm
except ModuleNotFoundError as missing:  # these two may be left out together, or need a library that is not there
    if missing.name not in {"corpus_pipeline", "tallymatch.llm", "tallymatch.llm.queries"}:
        warnings.warn(f"The queries of tallymatch.llm are left out: {missing}", stacklevel=1)
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

OUT = "out"
FOLDER = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """The audit of the roster against the assets."""
    return audit(spark, FOLDER)


# Inputs.


def roster(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.keyed_roster(X.view(spark, folder, X.ROSTER))


def assets(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.keyed_assets(X.view(spark, folder, X.ASSETS))


def match(spark: SparkSession, folder: str) -> Reconciliation:
    """The match as a job runs it: what several steps read is written to the shared folder once."""
    return reconcile(X.view(spark, folder, X.ROSTER), X.view(spark, folder, X.ASSETS), OUT, stage=Stage(spark))


def audit_lazy(spark: SparkSession, folder: str) -> DataFrame:
    """The same as one plan that writes nothing."""
    lazy = reconcile(X.view(spark, folder, X.ROSTER), X.view(spark, folder, X.ASSETS), OUT)
    return lazy.audit.select(*A.COLUMNS)


def audit(spark: SparkSession, folder: str) -> DataFrame:
    return match(spark, folder).audit.select(*A.COLUMNS)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return groups.key_ledger(roster(spark, folder), assets(spark, folder))


# Column functions.


def clean_cell(spark: SparkSession, folder: str) -> DataFrame:
    rows = X.view(spark, folder, X.ROSTER)
    return rows.select(
        "row_number",
        text.clean_cell("key_raw").alias("key_text"),
        text.clean_cell("target_raw").alias("target_text"),
        text.clean_cell("name").alias("name_text"),
    )


def clean_cell_typed(spark: SparkSession, folder: str) -> DataFrame:
    orders = X.table(spark, folder, "orders")
    cells = orders.select(
        "o_orderkey",
        "o_custkey",
        F.col("o_custkey").cast("double").alias("as_double"),
        (-F.col("o_custkey") * 1e5).alias("as_large"),
        (F.col("o_orderkey") + F.lit(0.5)).alias("as_half"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("as_null"),
        (F.col("o_orderstatus") == "P").alias("as_flag"),
        F.concat(F.lit("\t "), F.col("o_orderkey").cast("string"), F.lit(".00 \n")).alias("as_text"),
        F.concat(F.lit("-"), F.col("o_orderkey").cast("string"), F.lit(".0")).alias("as_negative"),
    )
    named = ["o_custkey", "as_double", "as_large", "as_half", "as_null", "as_flag", "as_text", "as_negative"]
    return text.clean_cells(cells, named)


def clean_cell_texts(spark: SparkSession, folder: str) -> DataFrame:
    documents = X.table(spark, folder, "documents")
    return documents.select("doc_id", text.clean_cell("text").alias("cell"))


def clean_key(spark: SparkSession, folder: str) -> DataFrame:
    rows = X.view(spark, folder, X.ROSTER)
    return rows.select("row_number", text.clean_key("key_raw").alias("key"))


def clean_key_texts(spark: SparkSession, folder: str) -> DataFrame:
    documents = X.table(spark, folder, "documents")
    return documents.select("doc_id", F.md5(text.clean_key("text")).alias("key_md5"))


def strip_zeros(spark: SparkSession, folder: str) -> DataFrame:
    lines = X.table(spark, folder, "lineitem")
    padded = F.lpad(F.col("l_partkey").cast("string"), 12, "0")
    mixed = F.concat(padded, F.when(F.col("l_linenumber") == 1, "x").otherwise(""))
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        text.clean_key(mixed, zeros=True).alias("stripped"),
        text.clean_key(F.repeat(F.lit("0"), F.col("l_linenumber")), zeros=True).alias("only_zeros"),
    )


def clean_target(spark: SparkSession, folder: str) -> DataFrame:
    rows = X.view(spark, folder, X.ROSTER)
    return rows.select("row_number", text.clean_target("target_raw").alias("target"))


def safe_name(spark: SparkSession, folder: str) -> DataFrame:
    pages = X.view(spark, folder, X.PAGE_PATHS)
    last = paths.file_name(F.col("path"))
    return pages.select(
        "page_id",
        text.is_safe_name(F.col("url")).alias("url_is_safe"),
        text.is_safe_name(last).alias("last_is_safe"),
        text.is_safe_name(F.concat(last, F.lit("\x1f"))).alias("control_is_safe"),
        text.is_safe_name(F.repeat(F.lit("."), (F.col("page_id") + 1).cast("int"))).alias("dots_are_safe"),
    )


def header_token(spark: SparkSession, folder: str) -> DataFrame:
    documents = X.table(spark, folder, "documents")
    return documents.select("doc_id", text.header_token(F.col("text")).alias("token"))


def fold_case(spark: SparkSession, folder: str) -> DataFrame:
    documents = X.table(spark, folder, "documents")
    return documents.select("doc_id", F.md5(text.fold_case(F.col("text"))).alias("folded_md5"))


def file_parts(spark: SparkSession, folder: str) -> DataFrame:
    pages = X.view(spark, folder, X.PAGE_PATHS)
    name = paths.file_name(F.col("path"))
    host = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)
    return pages.select(
        "page_id",
        name.alias("file_name"),
        paths.file_stem(name).alias("stem"),
        paths.file_suffix(name).alias("suffix"),
        paths.file_stem(host).alias("host_stem"),
        paths.file_suffix(host).alias("host_suffix"),
    )


def target_path(spark: SparkSession, folder: str) -> DataFrame:
    listing = X.view(spark, folder, X.ASSETS)
    name = paths.file_name(F.col("path"))
    target = F.concat(F.lit("T"), F.col("size").cast("string"))
    return listing.select("path", paths.target_path("out/", target, name).alias("destination"))


def resolves_inside(spark: SparkSession, folder: str) -> DataFrame:
    pages = X.view(spark, folder, X.PAGE_PATHS)
    # Steps up in front and in the middle, as many as the page number says.
    inner = F.concat(
        F.repeat(F.lit("../"), (F.col("page_id") % 3).cast("int")), F.ltrim(F.col("path"), F.lit("/")),
        F.repeat(F.lit("/.."), (F.col("page_id") % 5).cast("int")),
    )
    return pages.select(
        "page_id",
        paths.resolves_inside(F.col("path")).alias("absolute"),
        paths.resolves_inside(inner).alias("relative"),
        paths.resolves_inside(F.concat(F.lit("../"), inner)).alias("one_up"),
        paths.resolves_inside(F.concat(inner, F.lit("/../../.."))).alias("down_and_up"),
        paths.resolves_inside(F.concat(F.lit("a/./../"), inner)).alias("and_back"),
    )


def content_sha256(spark: SparkSession, folder: str) -> DataFrame:
    documents = X.table(spark, folder, "documents")
    return documents.select(
        "doc_id",
        hashing.content_sha256(F.col("text")).alias("sha256"),
        hashing.content_size(F.col("text")).alias("size"),
    )


def content_identity(spark: SparkSession, folder: str) -> DataFrame:
    hashed = content_sha256(spark, folder)
    return hashed.groupBy("sha256", "size").agg(F.count(F.lit(1)).alias("n"))


# Keyed sides and counts.


def keyed_roster(spark: SparkSession, folder: str) -> DataFrame:
    return roster(spark, folder)


def keyed_assets(spark: SparkSession, folder: str) -> DataFrame:
    return assets(spark, folder)


def scan_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.scan_metrics(X.view(spark, folder, X.ASSETS))


def blank_rows(spark: SparkSession, folder: str) -> DataFrame:
    from tallymatch.sources.sheets import roster_from_table

    rows = X.view(spark, folder, X.ROSTER).select(
        F.col("row_number").alias("record"),
        F.col("name").alias("Key No."),
        F.col("key_raw").alias(" KEY  no"),
        F.when(F.trim("key_raw") != "", F.col("target_raw")).alias("Target_No"),
    )
    # The last of the two equal headers counts; a row is dropped where all of its cells are blank.
    rows = rows.withColumn("Key No.", F.when(F.trim(" KEY  no") != "", F.col("`Key No.`")))
    return roster_from_table(rows, "key no", "TARGET NO", "absent", row_number="record")


def key_counts(spark: SparkSession, folder: str) -> DataFrame:
    return groups.repeated(groups.key_counts(roster(spark, folder)), "n_rows")


def target_counts(spark: SparkSession, folder: str) -> DataFrame:
    return groups.repeated(groups.target_counts(roster(spark, folder)), "n_targets")


def multimap(spark: SparkSession, folder: str) -> DataFrame:
    return groups.multimap(assets(spark, folder), Stage(spark)).select("key", "n_assets", "position", "file_name")


def asset_listing(spark: SparkSession, folder: str) -> DataFrame:
    listing = groups.asset_listing(assets(spark, folder))
    return listing.select("key", "n_assets", "path", "file_name")


def referenced_keys(spark: SparkSession, folder: str) -> DataFrame:
    return ledger(spark, folder).filter("n_rows > 0").select("key")


def orphan_keys(spark: SparkSession, folder: str) -> DataFrame:
    return ledger(spark, folder).filter("n_rows = 0").select("key")


# Matching.


def probe(spark: SparkSession, folder: str) -> DataFrame:
    return matching.probe(roster(spark, folder), assets(spark, folder)).select("row_number", "key", "n_assets", "path")


def repeats(spark: SparkSession, folder: str) -> DataFrame:
    return matching.with_repeats(roster(spark, folder)).select("row_number", "key", "target", "n_rows", "n_targets")


def orphans(spark: SparkSession, folder: str) -> DataFrame:
    files = assets(spark, folder)
    return matching.orphans(files, matching.Counts.of(roster(spark, folder), files))


def row_decision(spark: SparkSession, folder: str) -> DataFrame:
    return match(spark, folder).decided


def reject_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    decided = match(spark, folder).decided
    rejected = A.pick_statuses(decided, [L.DUPLICATE_KEY, L.DUPLICATE_TARGET])
    return rejected.select("row_number", "key", "target", "status", "detail")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    return match(spark, folder).candidates()


# Audit.


def audit_zeros(spark: SparkSession, folder: str) -> DataFrame:
    # Keys padded to two widths on the two sides: they meet only because leading zeros are dropped.
    rows = X.view(spark, folder, X.ROSTER).withColumn("key_raw", F.lpad("key_raw", 9, "0"))
    files = X.view(spark, folder, X.ASSETS)
    return reconcile(rows, files, OUT, zeros=True, stage=Stage(spark)).audit.select(*A.COLUMNS)


def summary(spark: SparkSession, folder: str) -> DataFrame:
    return A.summary(match(spark, folder).audit)


def all_ok(spark: SparkSession, folder: str) -> DataFrame:
    return A.all_ok(match(spark, folder).audit)


def plan_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return A.plan_metrics(match(spark, folder).audit)


def statuses(spark: SparkSession, folder: str) -> DataFrame:
    return A.statuses(match(spark, folder).audit)


def status_filter(spark: SparkSession, folder: str) -> DataFrame:
    picked = A.pick_statuses(match(spark, folder).audit, [L.NO_ASSET, L.ORPHAN_ASSET])
    return picked.select("status", "row_number", "source")


def success_rows(spark: SparkSession, folder: str) -> DataFrame:
    good = A.pick_statuses(match(spark, folder).audit, L.SUCCESS)
    return good.select("row_number", "source", "destination")


def relabelled(spark: SparkSession, folder: str) -> DataFrame:
    names = {L.NO_ASSET: "MISSING", L.ORPHAN_ASSET: "LEFT_OVER"}
    own = A.relabel(match(spark, folder).audit, names, {"key_raw": "code", "target_raw": "new_code"})
    return own.select("row_number", "code", "new_code", "status")


def report(spark: SparkSession, folder: str) -> DataFrame:
    return A.in_report_order(match(spark, folder).audit)


# Outcomes.


def compared(spark: SparkSession, folder: str, verify: bool) -> DataFrame:
    def measured(sql: str, *keep: str) -> DataFrame:
        sha256 = [hashing.content_sha256(F.col("content")).alias("sha256")] if verify else []
        size = hashing.content_size(F.col("content")).alias("size")
        return X.view(spark, folder, sql).select(*keep, size, *sha256)

    planned = measured(X.PLANNED_CONTENT, "row_number", "destination")
    return outcomes.with_existing(planned, measured(X.EXISTING_CONTENT, "path"), verify)


def outcome(verify: bool = False, overwrite: bool = False, dry_run: bool = False) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        settled = outcomes.settle(compared(spark, folder, verify), overwrite, dry_run)
        return settled.select("row_number", "destination", "status", "detail")

    return query


def same_content(spark: SparkSession, folder: str) -> DataFrame:
    return compared(spark, folder, verify=True).select("row_number", "found", "same")


def outcome_merge(spark: SparkSession, folder: str) -> DataFrame:
    decided = match(spark, folder).decided
    orders = X.table(spark, folder, "orders")
    # Outcomes for the rows of all customers with orders, as another job might deliver them.
    done = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished")
    )
    delivered = done.select(
        (F.col("o_custkey") + 2).alias("row_number"),
        F.when(F.col("finished") == F.col("n"), L.ALREADY_DONE).otherwise(L.COPY_FAILED).alias("status"),
        F.concat(F.col("finished").cast("string"), F.lit(" of "), F.col("n").cast("string")).alias("detail"),
    )
    merged = outcomes.merge_outcomes(decided, delivered)
    return merged.select("row_number", "key", "status", "source", "detail")


def queries() -> dict[str, Query]:
    """One entry per operator."""
    return own_queries() | ({**llm.QUERIES, "pipeline": corpus_pipeline.run} if llm else {})


def oracle_sql() -> dict[str, str]:
    """The query of the same name in SQL, for all that SQL can express."""
    return own_sql() | (llm.SQL if llm else {})


def own_queries() -> dict[str, Query]:
    return {
        "audit": audit,
        "audit_lazy": audit_lazy,
        "clean_cell": clean_cell,
        "clean_cell_typed": clean_cell_typed,
        "clean_cell_texts": clean_cell_texts,
        "clean_key": clean_key,
        "clean_key_texts": clean_key_texts,
        "strip_zeros": strip_zeros,
        "clean_target": clean_target,
        "safe_name": safe_name,
        "header_token": header_token,
        "fold_case": fold_case,
        "file_parts": file_parts,
        "target_path": target_path,
        "resolves_inside": resolves_inside,
        "content_sha256": content_sha256,
        "content_identity": content_identity,
        "keyed_roster": keyed_roster,
        "keyed_assets": keyed_assets,
        "scan_metrics": scan_metrics,
        "blank_rows": blank_rows,
        "key_counts": key_counts,
        "target_counts": target_counts,
        "multimap": multimap,
        "asset_listing": asset_listing,
        "ledger": ledger,
        "referenced_keys": referenced_keys,
        "orphan_keys": orphan_keys,
        "probe": probe,
        "repeats": repeats,
        "orphans": orphans,
        "row_decision": row_decision,
        "reject_duplicates": reject_duplicates,
        "candidates": candidates,
        "audit_zeros": audit_zeros,
        "summary": summary,
        "all_ok": all_ok,
        "plan_metrics": plan_metrics,
        "statuses": statuses,
        "status_filter": status_filter,
        "success_rows": success_rows,
        "relabelled": relabelled,
        "report": report,
        "outcome_default": outcome(),
        "outcome_verify": outcome(verify=True),
        "outcome_overwrite": outcome(overwrite=True),
        "outcome_overwrite_verify": outcome(verify=True, overwrite=True),
        "outcome_dry": outcome(dry_run=True),
        "outcome_dry_overwrite_verify": outcome(verify=True, overwrite=True, dry_run=True),
        "same_content": same_content,
        "outcome_merge": outcome_merge,
        **file_queries.queries(),
    }


# The same in SQL.

WITH_ROSTER = f"""
raw_rows as ({X.ROSTER}),
rows_text as (
  select cast(row_number as bigint) as row_number,
    regexp_replace(trim(key_raw), '^(\\d+)\\.0+$', '\\1') as key_raw,
    regexp_replace(trim(target_raw), '^(\\d+)\\.0+$', '\\1') as target_raw,
    trim(name) as name
  from raw_rows),
roster as (
  select *, upper(replace(key_raw, ' ', '')) as key, replace(target_raw, ' ', '') as target from rows_text)
"""

WITH_ASSETS = f"""
listing as ({X.ASSETS}),
named as (
  select path, size, split_part(path, '/', -1) as file_name,
    lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) as suffix
  from listing),
stems as (
  select *, trim(left(file_name, length(file_name) - length(suffix))) as stem from named),
assets as (
  select path, size, file_name, suffix, upper(replace(regexp_replace(stem, '^(\\d+)\\.0+$', '\\1'), ' ', '')) as key
  from stems where suffix in ('.jpg', '.jpeg') and stem <> '')
"""

WITH_DECIDED = """
in_group as (
  select *, string_split(path, '/') as parts, count(*) over (partition by key) as n_assets from assets),
per_key as (
  select key, max(n_assets) as n_assets, min(path) as path
  from in_group group by key),
counted as (
  select r.*,
    count(*) over (partition by r.key) as n_rows,
    sum(case when target <> '' then 1 else 0 end) over (partition by lower(target)) as n_targets,
    coalesce(p.n_assets, 0) as n_assets, p.path
  from roster r left join per_key p on r.key = p.key),
stated as (
  select *,
    case when key = '' then 'BLANK_KEY'
         when target = '' then 'BLANK_TARGET'
         when target in ('.', '..') or regexp_matches(target, '[<>:"/\\\\|?*\\x00-\\x1f]') then 'INVALID_TARGET'
         when n_rows > 1 then 'DUPLICATE_KEY'
         when n_targets > 1 then 'DUPLICATE_TARGET'
         when n_assets = 0 then 'NO_ASSET'
         when n_assets > 1 then 'DUPLICATE_ASSET'
         else 'PLANNED' end as status
  from counted),
decided as (
  select row_number, key_raw, target_raw, name, key, target, status,
    case when status = 'PLANNED' then path else '' end as source,
    case when status = 'PLANNED'
         then concat('out/', target, lower(regexp_extract(path, '\\.[^./]+$'))) else '' end as destination,
    case status when 'INVALID_TARGET' then 'Target cannot be used as a file name'
                when 'DUPLICATE_KEY' then concat('Key is on ', n_rows, ' rows')
                when 'DUPLICATE_TARGET' then concat('Target is on ', n_targets, ' rows')
                when 'DUPLICATE_ASSET' then concat(n_assets, ' files carry this key')
                else '' end as detail
  from stated),
orphans as (
  select key, path, size from assets where key not in (select key from roster where key <> '')),
audit as (
  select row_number, key_raw, target_raw, name, status, source, destination, detail from decided
  union all
  select null, '', '', '', 'ORPHAN_ASSET', path, '', 'No row has this key' from orphans)
"""

BOTH = f"with {WITH_ROSTER}, {WITH_ASSETS}, {WITH_DECIDED}"


def outcome_sql(verify: bool = False, overwrite: bool = False, dry_run: bool = False) -> str:
    equal = "p.content = e.content" if verify else "strlen(p.content) = strlen(e.content)"
    conflict = "false" if overwrite else "e.path is not null"
    last = "PLANNED" if dry_run else "APPLIED"
    last_detail = "Dry run: nothing written" if dry_run else ""
    return f"""
    with p as ({X.PLANNED_CONTENT}), e as ({X.EXISTING_CONTENT}),
    c as (select p.row_number, p.destination,
            case when {equal} then 'ALREADY_DONE' when {conflict} then 'TARGET_CONFLICT' else '{last}' end as status
          from p left join e on p.destination = e.path)
    select *, case status when 'ALREADY_DONE' then 'Destination already holds this file'
                          when 'TARGET_CONFLICT' then 'Destination holds another file'
                          else '{last_detail}' end as detail
    from c"""


def own_sql() -> dict[str, str]:
    rows, files = f"with {WITH_ROSTER}", f"with {WITH_ASSETS}"
    return {
        "audit": f"{BOTH} select * from audit",
        "audit_lazy": f"{BOTH} select * from audit",
        "clean_cell": f"{rows} select row_number, key_raw as key_text, target_raw as target_text, name as name_text"
        " from rows_text",
        "clean_cell_typed": r"""
            select o_orderkey, cast(o_custkey as varchar) as o_custkey, cast(o_custkey as varchar) as as_double,
              cast(-o_custkey * 100000 as varchar) as as_large,
              concat(o_orderkey, '.5') as as_half,
              case when o_orderstatus = 'P' then '' else o_orderstatus end as as_null,
              case when o_orderstatus = 'P' then 'True' else 'False' end as as_flag,
              cast(o_orderkey as varchar) as as_text, concat('-', o_orderkey, '.0') as as_negative
            from orders""",
        "clean_cell_texts": r"""
            select doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^(\d+)\.0+$', '\1') as cell
            from documents""",
        "clean_key": f"{rows} select row_number, key from roster",
        "clean_key_texts": r"""
            select doc_id, md5(upper(replace(regexp_replace(text, '\s+', '', 'g'), 'ß', 'ss'))) as key_md5
            from documents""",
        "strip_zeros": """
            select l_orderkey, l_linenumber,
              case when l_linenumber = 1 then concat(lpad(cast(l_partkey as varchar), 12, '0'), 'X')
                   else cast(l_partkey as varchar) end as stripped,
              '0' as only_zeros
            from lineitem""",
        "clean_target": f"{rows} select row_number, target from roster",
        "safe_name": f"""
            with p as ({X.PAGE_PATHS})
            select page_id, not regexp_matches(url, '[<>:"/\\\\|?*]') as url_is_safe,
              split_part(path, '/', -1) not in ('', '.', '..') as last_is_safe,
              false as control_is_safe, page_id >= 2 as dots_are_safe
            from p""",
        "header_token": "select doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as token from documents",
        "fold_case": "select doc_id, md5(replace(lower(text), 'ß', 'ss')) as folded_md5 from documents",
        "file_parts": f"""
            with p as ({X.PAGE_PATHS}),
            n as (select page_id, split_part(path, '/', -1) as file_name, split_part(url, '/', 3) as host from p),
            s as (select *, case when regexp_matches(file_name, '.\\.[^.]+$')
                                 then regexp_extract(file_name, '\\.[^.]+$') else '' end as suffix,
                    regexp_extract(host, '\\.[^.]+$') as host_suffix from n)
            select page_id, file_name, left(file_name, length(file_name) - length(suffix)) as stem, suffix,
              left(host, length(host) - length(host_suffix)) as host_stem, host_suffix
            from s""",
        "target_path": f"""
            {files} select path, concat('out/T', size, suffix) as destination from named""",
        "resolves_inside": f"""
            with p as ({X.PAGE_PATHS}),
            n as (select page_id, path, len(regexp_extract_all(path, '[^/]+')) as depth, page_id % 3 as up,
                    page_id % 5 as back from p)
            select page_id, not starts_with(path, '/') as absolute, up = 0 and back <= depth as relative,
              false as one_up, up = 0 and back + 3 <= depth as down_and_up, up = 0 and back <= depth as and_back
            from n""",
        "content_sha256": """
            select doc_id, sha256(text) as sha256, cast(strlen(text) as bigint) as size from documents""",
        "content_identity": """
            select sha256(text) as sha256, cast(strlen(text) as bigint) as size, count(*) as n
            from documents group by all""",
        "keyed_roster": f"{rows} select * from roster",
        "keyed_assets": f"{files} select path, size, file_name, suffix, key from assets",
        "scan_metrics": f"""
            {files} select (select count(*) from listing) as scanned,
              (select count(*) from listing) - (select count(*) from assets) as skipped,
              (select count(*) from assets) as indexed, (select count(distinct key) from assets) as distinct_keys""",
        "blank_rows": f"""
            {rows} select r.row_number, r.key_raw, r.target_raw, '' as name from rows_text r where r.key_raw <> ''""",
        "key_counts": f"""
            {rows} select key, count(*) as n_rows from roster where key <> '' group by key having count(*) > 1""",
        "target_counts": f"""
            {rows} select lower(target) as folded, count(*) as n_targets from roster where target <> ''
            group by 1 having count(*) > 1""",
        "multimap": f"""
            {BOTH} select key, n_assets, row_number() over (partition by key order by parts) as position, file_name
            from in_group""",
        "asset_listing": f"{BOTH} select key, n_assets, path, file_name from in_group",
        "ledger": f"""
            {BOTH}, k as (select key, count(*) as n_rows from roster where key <> '' group by key)
            select coalesce(k.key, p.key) as key, coalesce(n_rows, 0) as n_rows, coalesce(n_assets, 0) as n_assets, path
            from k full join per_key p on k.key = p.key""",
        "referenced_keys": f"{rows} select distinct key from roster where key <> ''",
        "orphan_keys": f"{BOTH} select distinct key from orphans",
        "probe": f"{BOTH} select row_number, r.key, p.n_assets, p.path from roster r left join per_key p on r.key = p.key",
        "repeats": f"""
            {BOTH} select row_number, key, target,
              case when key <> '' and n_rows > 1 then n_rows end as n_rows,
              cast(case when n_targets > 1 then n_targets end as bigint) as n_targets
            from counted""",
        "orphans": f"{BOTH} select key, path from orphans",
        "row_decision": f"{BOTH} select * from decided",
        "reject_duplicates": f"""
            {BOTH} select row_number, key, target, status, detail from decided
            where status in ('DUPLICATE_KEY', 'DUPLICATE_TARGET')""",
        "candidates": f"""
            {BOTH} select d.row_number, d.key, a.path, a.file_name from decided d join assets a on a.key = d.key
            where d.status = 'DUPLICATE_ASSET'""",
        "audit_zeros": BOTH.replace(
            X.ROSTER, f"select row_number, lpad(key_raw, 9, '0') as key_raw, target_raw, name from ({X.ROSTER})"
        ).replace(
            "upper(replace(key_raw, ' ', '')) as key",
            "case when regexp_matches(replace(key_raw, ' ', ''), '^\\d+$')"
            " then coalesce(nullif(ltrim(replace(key_raw, ' ', ''), '0'), ''), '0')"
            " else upper(replace(key_raw, ' ', '')) end as key",
        ) + " select * from audit",
        "summary": f"{BOTH} select status, count(*) as n from audit group by status",
        "all_ok": f"""
            {BOTH} select coalesce(bool_and(status in ('APPLIED', 'PLANNED', 'ALREADY_DONE')), true) as all_ok
            from audit where row_number is not null""",
        "plan_metrics": f"""
            {BOTH} select count(*) filter (status = 'PLANNED') as tasks,
              count(*) filter (row_number is not null and status <> 'PLANNED') as row_issues,
              count(*) filter (row_number is null) as orphans
            from audit""",
        "statuses": f"{BOTH} select distinct status from audit",
        "status_filter": f"""
            {BOTH} select status, row_number, source from audit where status in ('NO_ASSET', 'ORPHAN_ASSET')""",
        "success_rows": f"{BOTH} select row_number, source, destination from audit where status = 'PLANNED'",
        "relabelled": f"""
            {BOTH} select row_number, key_raw as code, target_raw as new_code,
              case status when 'NO_ASSET' then 'MISSING' when 'ORPHAN_ASSET' then 'LEFT_OVER' else status end as status
            from audit""",
        "report": f"{BOTH} select * from audit",
        "outcome_default": outcome_sql(),
        "outcome_verify": outcome_sql(verify=True),
        "outcome_overwrite": outcome_sql(overwrite=True),
        "outcome_overwrite_verify": outcome_sql(verify=True, overwrite=True),
        "outcome_dry": outcome_sql(dry_run=True),
        "outcome_dry_overwrite_verify": outcome_sql(verify=True, overwrite=True, dry_run=True),
        "same_content": f"""
            with p as ({X.PLANNED_CONTENT}), e as ({X.EXISTING_CONTENT})
            select p.row_number, e.path is not null as found, coalesce(p.content = e.content, false) as same
            from p left join e on p.destination = e.path""",
        "outcome_merge": f"""
            {BOTH}, done as (select o_custkey + 2 as row_number, count(*) as n,
                               sum(case when o_orderstatus = 'F' then 1 else 0 end) as finished
                             from orders group by 1)
            select d.row_number, d.key, d.source,
              case when n is null then d.status when finished = n then 'ALREADY_DONE' else 'COPY_FAILED' end as status,
              case when n is null then d.detail else concat(cast(finished as bigint), ' of ', n) end as detail
            from decided d left join done on d.row_number = done.row_number""",
        **file_queries.oracle_sql(BOTH),
    }
