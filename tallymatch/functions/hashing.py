"""Content hashes of table columns. Files are hashed by ``operators.files``, which reads them as streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_sha256(content: Column) -> Column:
    """Hex SHA-256 of all bytes of a text or binary column."""
    return F.sha2(content.cast("binary"), 256)


def content_size(content: Column) -> Column:
    """Size in bytes."""
    return F.octet_length(content).cast("bigint")
