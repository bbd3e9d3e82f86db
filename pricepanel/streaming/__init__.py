"""Snapshots as streams: keyed ingest, weekly means, change detection, late data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricepanel.functions.scalars import column


def instant(wall_clock: str | Column) -> Column:
    """Event time for watermarks: a zone-less timestamp read as UTC, in any session zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), column(wall_clock)).cast("timestamp")


def wall_clock(moment: str | Column) -> Column:
    """Back to a zone-less UTC timestamp."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), column(moment).cast("timestamp_ntz"))
