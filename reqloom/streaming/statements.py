"""The row-local operators on streams, and windowed counts of events with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqloom.operators import quality
from reqloom.operators.extract import extract


def enrich_stream(statements: DataFrame) -> DataFrame:
    """Flat table of a stream of statements (ord, id, text); the same plan as on a table."""
    return quality.flat_table(extract(statements), ["ord", "id", "text"])


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events per type and window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
