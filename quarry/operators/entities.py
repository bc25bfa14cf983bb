"""Features of entities: aggregates, lags, trailing windows, trends, entity tables and RFM scores.

An entity is the trimmed text of its id columns. Totals of an entity are partial aggregates joined back, so an entity
that holds a large share of the rows is summed before the shuffle; ordered features are windows over an entity's rows
by date (undated last), then the table's own order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.values import DAY, average_ranks, days_between, divided, exact_sum, key, micros, missing, moment, names_of, number, numbers_of, one_row, ordered, quoted
from quarry.operators.rows import Step, with_columns

FUNCTIONS = ("count", "sum", "mean", "max", "std")
ENTITY_FUNCTIONS = ("count", "sum", "mean", "median", "min", "max", "std", "last")


def aggregate(df: DataFrame, column: str, function: str, order: list[str]) -> Column:
    """One named aggregate of a column: numbers only, but for counts, nunique, first and last (in the rows' order)."""
    x = number(df, column)
    there = ~missing(df, column)
    place = F.struct(*map(quoted, order)) if order else F.monotonically_increasing_id()
    n = F.count(x)
    table = {
        "count": lambda: F.count(F.lit(1)),
        "count_non_missing": lambda: F.count_if(there),
        "nunique": lambda: F.count_distinct(F.when(there, key(df, column))),
        "sum": lambda: F.sum(x),
        "mean": lambda: F.avg(x),
        "median": lambda: F.percentile(x, F.lit(0.5)),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "std": lambda: F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(x)),
        "var": lambda: F.when(n == 1, F.lit(0.0)).otherwise(F.var_samp(x)),
        "range": lambda: F.max(x) - F.min(x),
        "first": lambda: F.min_by(quoted(column), F.when(there, place)),
        "last": lambda: F.max_by(quoted(column), F.when(there, place)),
    }
    if function not in table:
        raise ValueError(f"unknown function: {function}")
    return table[function]()


def _keys(df: DataFrame, ids: list[str]) -> list[Column]:
    return [key(df, c).alias(f"_k{i}") for i, c in enumerate(ids)] or [F.lit("").alias("_k0")]


def joined_totals(df: DataFrame, ids: list[str], totals: dict[str, Column]) -> DataFrame:
    """``df`` with each row's entity totals."""
    if not totals:
        return df
    keys = _keys(df, ids)
    names = [f"_k{i}" for i in range(len(keys))]
    grouped = df.groupBy(*keys).agg(*(v.alias(n) for n, v in totals.items()))
    kept = df.select("*", *keys)
    return kept.join(grouped, names).drop(*names)


def group_aggregates(df: DataFrame, id_columns=(), aggregation_columns=(), functions=FUNCTIONS, order=None) -> Step:
    """``row_count_by_{ids}`` and ``{column}_{function}_by_{ids}`` on every row."""
    ids = names_of(id_columns)
    suffix = "_".join(ids) or "all"
    totals = {f"row_count_by_{suffix}": F.count(F.lit(1))}
    for c in names_of(aggregation_columns):
        totals |= {f"{c}_{f}_by_{suffix}": aggregate(df, c, f, ordered(df, order)) for f in names_of(functions) if f != "count"}
    return joined_totals(df, ids, totals), list(totals)


def group_relative(df: DataFrame, id_columns=(), aggregation_columns=()) -> Step:
    """A value against its entity: ratio to the mean, difference, z-score (sample), share of the sum."""
    ids, columns = names_of(id_columns), names_of(aggregation_columns)
    suffix = "_".join(ids) or "all"
    totals = {}
    for i, c in enumerate(columns):
        x = number(df, c)
        totals |= {f"_m{i}": F.avg(x), f"_s{i}": F.stddev_samp(x), f"_t{i}": F.sum(x)}
    out = joined_totals(df, ids, totals)
    new = {}
    for i, c in enumerate(columns):
        x = number(df, c)
        mean, spread, total = F.col(f"_m{i}"), F.col(f"_s{i}"), F.col(f"_t{i}")
        new |= {f"{c}_ratio_to_{suffix}_mean": divided(x, mean), f"{c}_minus_{suffix}_mean": x - mean, f"{c}_zscore_in_{suffix}": divided(x - mean, spread), f"{c}_share_of_{suffix}_sum": divided(x, total)}
    out, names = with_columns(out, new)
    return out.drop(*totals), names


def entity_window(df: DataFrame, ids: list[str], dates: list[str], order=None):
    """An entity's rows by its first date column (undated last), then the table's order."""
    by = [moment(df, dates[0]).asc_nulls_last()] if dates else []
    by += [quoted(c).asc() for c in ordered(df, order)]
    w = Window.partitionBy(*(k for k in map(lambda c: key(df, c), ids))) if ids else Window.partitionBy(F.lit(""))
    return w.orderBy(*by) if by else w.orderBy(F.monotonically_increasing_id())


def lags(df: DataFrame, id_columns=(), date_columns=(), aggregation_columns=(), lags=(1,), order=None) -> Step:
    """The value some rows before, the difference and the relative change."""
    w = entity_window(df, names_of(id_columns), names_of(date_columns), order)
    new = {}
    for c in names_of(aggregation_columns):
        for k in map(int, numbers_of(lags, (1,))):
            before = F.lag(number(df, c), k).over(w)
            new |= {f"{c}_lag_{k}": before, f"{c}_diff_{k}": number(df, c) - before, f"{c}_pct_change_{k}": divided(number(df, c) - before, before)}
    return with_columns(df, new)


def rolling_windows(df: DataFrame, id_columns=(), date_columns=(), aggregation_columns=(), windows=(7, 30, 90), order=None) -> Step:
    """Events, sums and means of an entity's last days, (t - w, t]; undated rows have none.

    Rows with the same moment follow the table's order: an earlier one does not see a later one. The range window
    counts all of them, so what the later ones add (a row window inside the tie) is taken off again.
    """
    ids, dates = names_of(id_columns), names_of(date_columns)
    if not dates:
        return df, []
    t = micros(moment(df, dates[0]))
    keys = [key(df, c) for c in ids] or [F.lit("")]
    place = [quoted(c) for c in ordered(df, order)] or [F.monotonically_increasing_id()]
    span = Window.partitionBy(*keys).orderBy(t.asc_nulls_last())
    later = Window.partitionBy(*keys, t).orderBy(*place).rowsBetween(1, Window.unboundedFollowing)
    new: dict[str, Column] = {}
    for width in map(int, numbers_of(windows, (7, 30, 90))):
        w = span.rangeBetween(-(width * DAY - 1), 0)
        new[f"events_last_{width}d"] = F.when(t.isNotNull(), F.count(F.lit(1)).over(w) - F.count(F.lit(1)).over(later))
        for c in names_of(aggregation_columns):
            x = number(df, c)
            total = F.coalesce(F.sum(x).over(w), F.lit(0.0)) - F.coalesce(F.sum(x).over(later), F.lit(0.0))
            n = F.count(x).over(w) - F.count(x).over(later)
            new[f"{c}_sum_last_{width}d"] = F.when(t.isNotNull(), F.when(n > 0, total).otherwise(F.lit(0.0)))
            new[f"{c}_mean_last_{width}d"] = F.when(t.isNotNull() & (n > 0), total / n)
    return with_columns(df, new)


def cumulative(df: DataFrame, id_columns=(), date_columns=(), aggregation_columns=(), order=None) -> Step:
    """An entity's event number, running sum (0 before the first value), mean and greatest value."""
    w = entity_window(df, names_of(id_columns), names_of(date_columns), order).rowsBetween(Window.unboundedPreceding, 0)
    new: dict[str, Column] = {"event_number": F.count(F.lit(1)).over(w)}
    for c in names_of(aggregation_columns):
        x = number(df, c)
        new |= {f"{c}_cumsum": F.coalesce(F.sum(x).over(w), F.lit(0.0)), f"{c}_cummean": F.avg(x).over(w), f"{c}_cummax": F.max(x).over(w)}
    return with_columns(df, new)


def event_gaps(df: DataFrame, id_columns=(), date_columns=(), order=None) -> Step:
    """Days since the entity's previous and first event, its mean gap, and the gap against that mean."""
    ids, dates = names_of(id_columns), names_of(date_columns)
    if not dates:
        return df, []
    t = moment(df, dates[0])
    out = joined_totals(df, ids, {"_first": F.min(t), "_last": F.max(t), "_n": F.count(t)})
    t = moment(out, dates[0])
    before = F.lag(t).over(entity_window(out, ids, dates, order))
    mean = F.when(F.col("_n") > 1, days_between(F.col("_last"), F.col("_first")) / (F.col("_n") - 1))
    out = out.withColumn("days_since_previous_event", days_between(t, before))
    new = {"days_since_first_event": days_between(t, F.col("_first")), "mean_event_gap_days": F.when(t.isNotNull(), mean), "event_gap_ratio": divided(F.col("days_since_previous_event"), F.when(t.isNotNull(), mean))}
    out, names = with_columns(out, new)
    return out.drop("_first", "_last", "_n"), ["days_since_previous_event", *names]


def _slope(df: DataFrame, column: str, date: str) -> Column:
    """Least-squares slope per day. Days count from a fixed day near the data, so squares keep their digits."""
    days = days_between(moment(df, date), F.lit("2000-01-01").cast("timestamp_ntz"))
    return F.regr_slope(number(df, column), days)


def trend(df: DataFrame, id_columns=(), date_columns=(), aggregation_columns=()) -> Step:
    """``{column}_trend_by_{ids}``: slope per day; null with under two points or no spread in time."""
    ids, dates = names_of(id_columns), names_of(date_columns)
    if not dates:
        return df, []
    suffix = "_".join(ids) or "all"
    totals = {f"{c}_trend_by_{suffix}": _slope(df, c, dates[0]) for c in names_of(aggregation_columns)}
    return joined_totals(df, ids, totals), list(totals)


# ---------------------------------------------------------------- one row an entity


def _iso(t: Column) -> Column:
    """A moment as ISO text, without zero fractions."""
    return F.regexp_replace(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def entity_table(df: DataFrame, id_columns=(), date_columns=(), aggregation_columns=(), functions=ENTITY_FUNCTIONS, windows=(), reference_date=None, order=None) -> Step:
    """One row an entity: ids as text, events, aggregates, trends, dates, and sums before the reference date (default:
    the latest of the first date column)."""
    ids, dates, columns = names_of(id_columns), names_of(date_columns), names_of(aggregation_columns)
    place = ordered(df, order)
    reference = _reference(df, dates, reference_date)
    out: dict[str, Column] = {"event_count": F.count(F.lit(1))}
    for c in columns:
        out |= {f"{c}_{f}": aggregate(df, c, f, place) for f in names_of(functions)}
        if dates:
            out[f"{c}_trend"] = _slope(df, c, dates[0])
    for d in dates:
        t = moment(df, d)
        span = days_between(F.max(t), F.min(t))
        out |= {f"{d}_first": _iso(F.min(t)), f"{d}_last": _iso(F.max(t)), f"{d}_span_days": span, f"{d}_recency_days": days_between(reference, F.max(t)), f"{d}_active_days": F.count_distinct(F.to_date(t)), f"{d}_mean_gap_days": F.when(F.count(t) > 1, span / (F.count(t) - 1))}
    for width in map(int, numbers_of(windows, ())) if dates else ():
        t = moment(df, dates[0])
        recent = (micros(t) > micros(reference) - F.lit(width * DAY)) & (t <= reference)
        out[f"events_last_{width}d"] = F.count_if(recent)
        out |= {f"{c}_sum_last_{width}d": F.coalesce(F.sum(F.when(recent, number(df, c))), F.lit(0.0)) for c in columns}
    keys = [key(df, c).alias(c) for c in ids] or [F.lit("").alias("all")]
    return df.groupBy(*keys).agg(*(v.alias(n) for n, v in out.items())), list(out)


def _reference(df: DataFrame, dates: list[str], given) -> Column:
    if given is None and dates:
        given = one_row(df, F.max(moment(df, dates[0])).alias("t"))["t"]
    return F.lit(None if given is None else str(given)).cast("timestamp_ntz")


def rfm(df: DataFrame, id_columns=(), date_columns=(), aggregation_columns=(), reference_date=None, buckets: int = 5) -> Step:
    """Recency, frequency and monetary value of each entity, their scores by mean percentile rank, and a segment.

    The monetary sum is exact, since scores are joined by value: a sum that varies with the order of rows finds none."""
    ids, dates, columns = names_of(id_columns), names_of(date_columns), names_of(aggregation_columns)
    reference = _reference(df, dates, reference_date)
    x = number(df, columns[0]) if columns else F.lit(None).cast("double")
    t = moment(df, dates[0]) if dates else F.lit(None).cast("timestamp_ntz")
    keys = [key(df, c).alias(c) for c in ids]
    base = df.groupBy(*keys).agg(
        days_between(reference, F.max(t)).alias("recency_days"),
        F.count(F.lit(1)).alias("frequency"),
        F.coalesce(exact_sum(df, x), F.lit(0.0)).alias("monetary_sum"),
        F.coalesce(F.avg(x), F.lit(0.0)).alias("monetary_mean"),
        F.coalesce(F.max(x), F.lit(0.0)).alias("monetary_max"),
    )
    out = base
    for source, name, reverse in (("recency_days", "r_score", True), ("frequency", "f_score", False), ("monetary_sum", "m_score", False)):
        share = F.coalesce(divided(F.col("rank"), F.col("n") - 1), F.lit(0.0))
        share = 1 - share if reverse else share
        scores = average_ranks(base.select(source)).select(F.col("value").alias("_v"), F.least(F.lit(buckets), F.floor(share * buckets) + 1).cast("int").alias(name))
        out = out.join(scores, F.col(source) == F.col("_v"), "left").drop("_v")
    r, f = F.col("r_score"), F.col("f_score")
    high = buckets - 1
    segment = F.when(r.isNull() | f.isNull(), "unknown").when((r >= high) & (f >= high), "champion").when(f >= high, "at_risk").when(r >= high, "new_or_promising").when((r <= 2) & (f <= 2), "lost").otherwise("needs_attention")
    score = F.concat(*(F.coalesce(F.col(s).cast("string"), F.lit("0")) for s in ("r_score", "f_score", "m_score")))
    out = out.withColumns({"rfm_score": score, "rfm_segment": segment})
    return out, [c for c in out.columns if c not in ids]


def entity_rates(entities: DataFrame, date_columns, aggregation_columns) -> Step:
    """Events per day and per active day; each column's sum per day and per event."""
    dates = names_of(date_columns)
    if not dates:
        return entities, []
    span, active = F.col(f"{dates[0]}_span_days"), F.col(f"{dates[0]}_active_days")
    new = {"events_per_day": divided(F.col("event_count"), span), "events_per_active_day": divided(F.col("event_count"), active)}
    for c in names_of(aggregation_columns):
        new |= {f"{c}_per_day": divided(F.col(f"{c}_sum"), span), f"{c}_per_event": divided(F.col(f"{c}_sum"), F.col("event_count"))}
    return with_columns(entities, new)


def generic_entity_features(df: DataFrame, id_columns=(), date_columns=(), aggregation_columns=(), reference_date=None, windows=(7, 30, 90), order=None) -> Step:
    """The entity table with trailing windows, RFM scores and rates."""
    ids = names_of(id_columns)
    table, names = entity_table(df, ids, date_columns, aggregation_columns, windows=windows, reference_date=reference_date, order=order)
    if ids:
        scores, more = rfm(df, ids, date_columns, aggregation_columns, reference_date)
        table, names = table.join(scores, ids, "left"), names + more
    table, rates = entity_rates(table, date_columns, aggregation_columns)
    return table, names + rates


def composed(df: DataFrame, steps) -> Step:
    """Several steps one after another; their new names joined."""
    return reduce(lambda state, step: (lambda out: (out[0], state[1] + out[1]))(step(state[0])), steps, (df, []))
