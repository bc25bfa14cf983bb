"""Entity features over a stream: trailing sums by event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.values import key, moment, names_of, number


def windowed_totals(events: DataFrame, id_columns, date_column: str, aggregation_columns, width: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums per entity and sliding window; rows later than the watermark are dropped. Works on a stream
    and, with the same result, on a table."""
    ids = names_of(id_columns)
    timed = events.withColumn("_t", moment(events, date_column).cast("timestamp")).withWatermark("_t", late)
    totals = [F.count(F.lit(1)).alias("events")] + [F.sum(number(events, c)).alias(f"{c}_sum") for c in names_of(aggregation_columns)]
    grouped = timed.groupBy(F.window("_t", width, slide).alias("w"), *(key(events, c).alias(c) for c in ids)).agg(*totals)
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *ids, "events", *(f"{c}_sum" for c in names_of(aggregation_columns)))
