"""Streaming forms: what needs one record only runs unchanged; counts are kept as state, and reads are grouped by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters


def running_histogram(stream: DataFrame) -> DataFrame:
    """Counts by mapping quality so far; for the complete or update output mode.  The state has a row a quality."""
    return filters.countable(stream).groupBy("mapq").agg(F.count(F.lit(1)).alias("n"))


def running_contig_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("rname").agg(F.count(F.lit(1)).alias("n"))


def windowed_coverage_starts(stream: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes", width: int = 1 << 16) -> DataFrame:
    """Reads by arrival window and bin of their start; a window is given out once, after the watermark has passed it."""
    timed = filters.countable(stream).withWatermark(time, late)
    return timed.groupBy(F.window(time, window), "rname", F.floor(F.col("pos") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def first_of_each_read(stream: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """One record a read name within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["qname"])
