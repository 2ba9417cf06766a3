"""Times as numbers, for timestamps with and without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: str | Column) -> Column:
    return F.unix_micros(_column(c).cast("timestamp"))


def seconds(c: str | Column) -> Column:
    return F.unix_seconds(_column(c).cast("timestamp"))
