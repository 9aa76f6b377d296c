"""Session settings that suit these plans. They are ordinary Spark settings; nothing here is needed for right results."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Joins and partition sizes are settled at run time, from measured sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    # Where every partition of one side is this small, hash it instead of sorting both sides. Not below the size above.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # The call site of every column expression is of use for debugging only.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
}


def configured(builder: SparkSession.Builder, shuffle_partitions: int | None = None) -> SparkSession.Builder:
    """The builder with the settings above.

    With AQE, ``shuffle_partitions`` is the finest split of a shuffle: set it so that the largest shuffle divided by it
    is a few hundred megabytes, about 100,000 for 30 TB. AQE merges what turns out smaller.
    """
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder
