"""Tables written to the shared folder, so that later steps neither recompute nor lose them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SHARED_FOLDER = "spark.checkpoint.dir"
#: What a finished execution has shuffled is removed; a stage that is needed again after all is run again.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read and write, as the session names it.

    Only a local session, where driver and executors are one process, may do without the setting; its tables go below the
    warehouse then.
    """
    named = spark.conf.get(SHARED_FOLDER, None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tallymatch-stages"
    raise ValueError(f"Set {SHARED_FOLDER} to a folder that all executors share")


class Stage:
    """A folder of its own below the shared folder, for the tables of one run."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        # A saved table is read from its files; what was shuffled to make it would only take up local disks.
        spark.conf.set(REMOVE_SHUFFLES, "true")
        self.folder = f"{folder or shared_folder(spark)}/run-{uuid.uuid4().hex}"
        #: What was counted while tables were written, by the name of the table.
        self.figures: dict[str, dict] = {}

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *_) -> None:
        self.remove()

    def remove(self) -> None:
        """Delete all tables of the run. What was read from them and not stored elsewhere is gone."""
        self.drop(self.folder)

    def drop(self, path: str) -> None:
        """Delete a table of the run that no later step reads, by its path below the folder."""
        if path != self.folder and not path.startswith(f"{self.folder}/"):
            raise ValueError(f"{path} is not a table of this run")
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(found, True)

    def path(self, name: str) -> str:
        """A path below the folder that nothing else uses."""
        return f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, table: DataFrame, name: str) -> DataFrame:
        """Write the table once and give it back as read from there: short lineage, exact sizes, prunable columns."""
        path = self.path(name)
        table.write.parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)

    @contextmanager
    def counting(self, table: DataFrame, name: str, **figures: Column) -> Iterator[DataFrame]:
        """The table, to be written once within the block, with aggregates of its rows that are taken on the way: no job of their own.

        They are in ``figures`` under the name afterwards.
        """
        seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
        yield table.observe(seen, *[figure.alias(key) for key, figure in figures.items()])
        self.figures[name] = seen.get

    def save_all(self, **tables: DataFrame) -> list[DataFrame]:
        """Write tables that do not depend on each other at the same time, so that one fills the gaps of another."""
        with ThreadPoolExecutor(len(tables)) as pool:
            return list(pool.map(self.save, tables.values(), tables))
