"""Inputs for checks and benchmarks, derived from whole tables of the test data.

The definitions are plain SQL that Spark and DuckDB read alike, so both sides of a check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Blank and whitespace-only keys, repeated keys, decimals, inner spaces, letter case; blank, unsafe and colliding targets.
ROSTER = """
select c_custkey + 2 as row_number,
  case when c_custkey % 50 = 0 then '' when c_custkey % 50 = 1 then '   '
       when c_custkey % 40 = 3 then concat(' ', cast(c_custkey - 1 as string), ' ')
       when c_custkey % 7 = 0 then concat(cast(c_custkey as string), '.0')
       when c_custkey % 11 = 0 then concat('a ', cast(c_custkey as string))
       else cast(c_custkey as string) end as key_raw,
  case when c_custkey % 53 = 0 then ''
       when c_custkey % 59 = 0 then concat('TGT/', cast(c_custkey as string))
       when c_custkey % 61 = 0 then concat('tgt ', cast(c_custkey - 1 as string))
       else concat('TGT', cast(c_custkey as string)) end as target_raw,
  c_name as name
from customer
"""

# One file per part: two folders, wanted and foreign suffixes, keys with two files, keys without a row, blank stems.
ASSETS = """
select concat(case when p_partkey % 2 = 0 then 'files/a/' else 'files/a-x/' end,
  case when p_partkey % 65 = 13 then ' '
       when p_partkey % 11 = 0 and p_partkey % 7 <> 0 then concat('A', cast(p_partkey as string))
       when p_partkey % 17 = 5 then cast(p_partkey - 1 as string)
       else cast(p_partkey as string) end,
  case when p_partkey % 65 = 13 then '.jpg'
       when p_partkey % 13 = 0 then '.txt'
       when p_size % 5 = 0 then '.png' when p_size % 5 = 1 then '.JPEG'
       when p_size % 5 = 2 then '.jpeg' else '.jpg' end) as path,
  cast(p_partkey * 10 as bigint) as size
from part
"""

# What is to be written, and what is at the destination: the same, other bytes of the same size, another size, elsewhere.
PLANNED_CONTENT = """
select p_partkey as row_number, concat('out/', cast(p_partkey as string)) as destination,
  concat('img', lpad(cast(p_partkey as string), 8, '0')) as content
from part
"""
EXISTING_CONTENT = """
select case when p_partkey % 4 = 3 then concat('old/', cast(p_partkey as string))
            else concat('out/', cast(p_partkey as string)) end as path,
  case p_partkey % 4 when 0 then concat('img', lpad(cast(p_partkey as string), 8, '0'))
                     when 1 then concat('imx', lpad(cast(p_partkey as string), 8, '0'))
                     else concat('longer-img', lpad(cast(p_partkey as string), 8, '0')) end as content
from part
"""

# The address of each page without scheme, host, query and fragment, and an entry that climbs out for every other page.
PAGE_PATHS = """
select page_id, url, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*', '') as path from pages
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """One of the definitions above as a DataFrame."""
    source = sql.split()[-1]
    return spark.sql(sql.replace(f"from {source}", "from {source}"), source=table(spark, folder, source))
