"""Date and time features: calendar parts, cycles, recency, differences, position in time."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.values import average_ranks, days_between, divided, micros, moment, names_of, one_row
from quarry.operators.rows import Step, with_columns

# Names of the calendar parts and their order.
DATE_PARTS = ("year", "quarter", "month", "week", "day", "dayofweek", "dayofyear", "hour", "minute", "is_weekend", "is_month_start", "is_month_end", "is_quarter_start", "days_in_month")
CYCLES = (("month", 12), ("dayofweek", 7), ("dayofyear", 365), ("hour", 24))
MONTH_DAYS = 30.44


def part(t: Column, name: str) -> Column:
    """A calendar part of a moment, as an integer."""
    month, day = F.month(t), F.dayofmonth(t)
    last = F.dayofmonth(F.last_day(t))
    hour = F.hour(t)
    table = {
        "year": F.year(t),
        "quarter": F.quarter(t),
        "month": month,
        "week": F.weekofyear(t),
        "day": day,
        "dayofweek": F.weekday(t),
        "dayofyear": F.dayofyear(t),
        "hour": hour,
        "minute": F.minute(t),
        "is_weekend": (F.weekday(t) >= 5).cast("int"),
        "is_month_start": (day == 1).cast("int"),
        "is_month_end": (day == last).cast("int"),
        "is_quarter_start": ((day == 1) & (month % 3 == 1)).cast("int"),
        "is_quarter_end": ((day == last) & (month % 3 == 0)).cast("int"),
        "days_in_month": last,
        "week_of_month": F.floor((day - 1) / 7).cast("int") + 1,
        "days_to_month_end": last - day,
        "season": F.floor((month % 12) / 3).cast("int"),
        "minute_of_day": hour * 60 + F.minute(t),
        "part_of_day": F.floor(hour / 6).cast("int"),
        "is_business_hour": ((F.weekday(t) < 5) & (hour >= 9) & (hour < 18)).cast("int"),
    }
    return table[name].cast("int")


def date_parts(df: DataFrame, date_columns=(), parts=None) -> Step:
    """``{column}_{part}`` of each date column."""
    return with_columns(df, {f"{c}_{p}": part(moment(df, c), p) for c in names_of(date_columns) for p in names_of(parts) or DATE_PARTS})


def cyclical_dates(df: DataFrame, date_columns=()) -> Step:
    """Sine and cosine of month, weekday, day of year and hour."""
    new = {}
    for c in names_of(date_columns):
        for p, period in CYCLES:
            angle = part(moment(df, c), p) * F.lit(2 * math.pi / period)
            new[f"{c}_{p}_sin"], new[f"{c}_{p}_cos"] = F.sin(angle), F.cos(angle)
    return with_columns(df, new)


def recency(df: DataFrame, date_columns=(), reference_date=None) -> Step:
    """Days, weeks and months since each date until a reference (default: the column's latest); empty columns are
    skipped."""
    columns = names_of(date_columns)
    latest = one_row(df, *(F.max(moment(df, c)).alias(c) for c in columns)) if columns else {}
    new = {}
    for c in columns:
        if latest[c] is None:
            continue
        reference = F.lit(str(reference_date or latest[c])).cast("timestamp_ntz")
        days = days_between(reference, moment(df, c))
        new |= {f"{c}_days_since": days, f"{c}_weeks_since": days / 7, f"{c}_months_since": days / MONTH_DAYS}
    return with_columns(df, new)


def date_differences(df: DataFrame, date_columns=()) -> Step:
    """``{a}_to_{b}_days`` of each pair of date columns in list order."""
    return with_columns(df, {f"{a}_to_{b}_days": days_between(moment(df, b), moment(df, a)) for a, b in combinations(names_of(date_columns), 2)})


def relative_time(df: DataFrame, columns: list[str], marker: str = "__") -> Step:
    """Days since the first and until the last date, position in the span, and rank in time (mean of ties)."""
    names = []
    facts = one_row(df, *(f for c in columns for f in (F.min(moment(df, c)).alias(f"a {c}"), F.max(moment(df, c)).alias(f"z {c}"), F.count(moment(df, c)).alias(f"n {c}")))) if columns else {}
    for c in columns:
        if facts[f"n {c}"] < 2:
            continue
        a, z = (F.lit(str(facts[f"{k} {c}"])).cast("timestamp_ntz") for k in "az")
        t = moment(df, c)
        rank = f"{c}{marker}chronological_rank"
        ranks = average_ranks(df.select(micros(t).alias("v"))).select(F.col("value").alias("_v"), divided(F.col("rank"), F.col("n") - 1).alias(rank))
        df = df.withColumns({f"{c}{marker}days_since_first": days_between(t, a), f"{c}{marker}days_until_last": days_between(z, t), f"{c}{marker}span_position": divided(days_between(t, a), days_between(z, a))})
        df = df.withColumn("_t", micros(moment(df, c))).join(ranks, F.col("_t") == F.col("_v"), "left").drop("_t", "_v")
        names += [f"{c}{marker}{f}" for f in ("days_since_first", "days_until_last", "span_position", "chronological_rank")]
    return df, names
