"""Analyzers: profiles of a table as small DataFrames, one row per column, level, pair or period."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.values import BOOLEAN_TOKENS, ORDER, columns_of, days_between, key, missing, moment, names_of, not_token, number, one_row, quantiles, quoted, stripped
from quarry.operators.cleaning import bounds
from quarry.operators.missing import missing_patterns

TYPED_SHARE, TEXT_RATIO, TEXT_LENGTH = 0.8, 0.9, 20
REDUNDANT, LEAKING, SKEWED, HEAVY = 0.95, 0.98, 1.0, 2.0
ID_NAME = re.compile(r"(^|_)(id|key|code|uuid|guid)$", re.I)
POSITIVE = ("1", "true", "yes", "y", "t")


def per_column(df: DataFrame, columns: list[str], facts) -> DataFrame:
    """One aggregate over a table, one row per column: ``facts(column)`` gives its named aggregates."""
    if not columns:
        raise ValueError("no columns to look at")
    each = [F.struct(F.lit(c).alias("column"), *(v.alias(n) for n, v in facts(c).items())) for c in columns]
    return df.agg(F.array(*each).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def column_kinds(df: DataFrame, columns=None) -> dict[str, str]:
    """empty, constant, boolean, numeric, date, text or categorical, from all rows."""
    columns = columns_of(df, columns)

    def facts(c: str) -> dict[str, Column]:
        there, k = ~missing(df, c), key(df, c)
        if isinstance(df.schema[c].dataType, T.NumericType):  # only "one value" and "zeros and ones" matter: no values are counted
            cell = F.when(there, quoted(c))
            odd = F.count_if(not_token(df, c, BOOLEAN_TOKENS))
            distinct = F.when(F.count(cell) == 0, 0).when(F.min(cell) == F.max(cell), 1).when(odd == 0, 2).otherwise(3)
            return {"n": F.count_if(there), "distinct": distinct.cast("long"), "odd": odd, "numbers": F.count_if(there), "dates": F.lit(0).cast("long"), "length": F.lit(None).cast("double")}
        return {"n": F.count_if(there), "distinct": F.count_distinct(F.when(there, k)), "odd": F.count_if(there & ~F.lower(k).isin(*BOOLEAN_TOKENS)), "numbers": F.count_if(there & number(df, c).isNotNull()), "dates": F.count_if(there & moment(df, c).isNotNull()), "length": F.avg(F.when(there, F.length(k)))}

    out = {}
    for r in per_column(df, columns, facts).collect():
        n, stamp = r["n"], isinstance(df.schema[r["column"]].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        if not n:
            kind = "empty"
        elif r["distinct"] == 1:
            kind = "constant"
        elif r["distinct"] <= 2 and not r["odd"]:
            kind = "boolean"
        elif r["numbers"] >= TYPED_SHARE * n:
            kind = "numeric"
        elif stamp or r["dates"] >= TYPED_SHARE * n:
            kind = "date"
        else:
            kind = "text" if r["distinct"] > TEXT_RATIO * n and (r["length"] or 0) > TEXT_LENGTH else "categorical"
        out[r["column"]] = kind
    return {c: out[c] for c in columns}


def column_roles(df: DataFrame, id_columns=None, date_columns=None, target: str | None = None) -> dict:
    """Columns as ids, dates, numbers to aggregate, categories, text, constant and empty."""
    kinds = column_kinds(df)
    n = df.count()
    named = [c for c in kinds if ID_NAME.search(c) and kinds[c] not in ("empty", "constant")]
    texts = [c for c in kinds if kinds[c] in ("categorical", "text") and c not in named]
    distinct = one_row(df, *(F.count_distinct(F.when(~missing(df, c), key(df, c))).alias(c) for c in texts)) if texts else {}
    ids = names_of(id_columns) or named or [c for c in texts if n and distinct[c] == n]
    taken = {*ids, target}
    of = lambda *ks: [c for c, k in kinds.items() if k in ks and c not in taken]
    return {"ids": ids, "dates": names_of(date_columns) or of("date"), "aggregation": of("numeric"), "categorical": of("categorical", "boolean"), "text": of("text"), "constant": of("constant"), "empty": of("empty"), "target": target}


def describe(df: DataFrame, columns=None) -> DataFrame:
    """Per column: rows, holes, rate, distinct values, and of its numbers the usual statistics."""
    columns = columns_of(df, columns)
    quarters = quantiles(df, {c: number(df, c) for c in columns}, [0.25, 0.5, 0.75])

    def facts(c: str) -> dict[str, Column]:
        x, hole = number(df, c), missing(df, c)
        q = [F.lit(v).cast("double") for v in quarters[c] or [None] * 3]
        n = F.count(x)
        return {
            "n_rows": F.count(F.lit(1)),
            "n_missing": F.count_if(hole),
            "n_distinct": F.count_distinct(F.when(~hole, key(df, c))),
            "mean": F.avg(x),
            "std": F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(x)),
            "min": F.min(x),
            "p25": q[0],
            "median": q[1],
            "p75": q[2],
            "max": F.max(x),
            "sum": F.sum(x),
            "zeros": F.count_if(x == 0),
            "negatives": F.count_if(x < 0),
            "skew": F.when(n >= 3, F.skewness(x)),
        }

    out = per_column(df, columns, facts)
    return out.withColumn("missing_rate", F.coalesce(F.try_divide(F.col("n_missing"), F.col("n_rows")), F.lit(0.0)))


def category_profile(df: DataFrame, column: str, top: int = 5) -> DataFrame:
    """The commonest levels of a column by count, then text."""
    return df.where(~missing(df, column)).groupBy(key(df, column).alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "level").limit(top)


def date_profile(df: DataFrame, columns) -> DataFrame:
    """Per date column: first, last, span in days, distinct days, unreadable cells."""

    def facts(c: str) -> dict[str, Column]:
        t = moment(df, c)
        return {"first": F.min(t), "last": F.max(t), "span_days": days_between(F.max(t), F.min(t)), "distinct_days": F.count_distinct(F.to_date(t)), "unreadable": F.count_if(~missing(df, c) & t.isNull())}

    return per_column(df, columns_of(df, columns), facts)


def missing_values(df: DataFrame, max_missing_rate: float = 0.5, patterns: int = 3) -> tuple[DataFrame, DataFrame]:
    """Per-column holes (with a mark over the threshold), and the commonest sets missing together."""
    out = per_column(df, columns_of(df, None), lambda c: {"n_missing": F.count_if(missing(df, c)), "n_rows": F.count(F.lit(1))})
    rate = F.coalesce(F.try_divide(F.col("n_missing"), F.col("n_rows")), F.lit(0.0))
    return out.withColumn("missing_rate", rate).withColumn("too_many", F.col("missing_rate") > max_missing_rate), missing_patterns(df, top=patterns)


def duplicates(df: DataFrame, subset=None, keys=None) -> DataFrame:
    """Repeated rows over the subset (``rows``) and, per key column, distinct, duplicated and most repeated values
    (missing counts as a value)."""

    def of(name: str, by: list[Column]) -> DataFrame:
        g = df.groupBy(*(b.alias(f"k{i}") for i, b in enumerate(by))).agg(F.count(F.lit(1)).alias("n"))
        return g.agg(F.lit(name).alias("key"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), F.count_if(F.col("n") > 1).alias("n_duplicated"), F.coalesce(F.max("n"), F.lit(0)).alias("max_repeats"))

    out = of("rows", [key(df, c) for c in columns_of(df, subset)])
    for c in names_of(keys):
        out = out.unionByName(of(c, [key(df, c)]))
    return out.withColumn("n_repeated", F.col("n_rows") - F.col("n_distinct"))


def outliers(df: DataFrame, columns=None, method: str = "iqr", factor: float = 1.5) -> DataFrame:
    """Per numeric column with spread and over two values: bounds, rows below and above, their rate."""
    numeric = [c for c, k in column_kinds(df, columns).items() if k == "numeric"]
    many = one_row(df, *(F.count_distinct(number(df, c)).alias(c) for c in numeric)) if numeric else {}
    found = bounds(df, [c for c in numeric if many[c] > 2], method, factor)
    if not found:
        return df.sparkSession.createDataFrame([], "column string, lower double, upper double, n long, n_below long, n_above long, rate double")
    out = per_column(df, list(found), lambda c: {"lower": F.lit(found[c][0]), "upper": F.lit(found[c][1]), "n": F.count(number(df, c)), "n_below": F.count_if(number(df, c) < found[c][0]), "n_above": F.count_if(number(df, c) > found[c][1])})
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("n_below") + F.col("n_above"), F.col("n")), F.lit(0.0)))


def distributions(df: DataFrame, columns=None) -> DataFrame:
    """Per numeric column: shape (binary, discrete, continuous), skew, excess kurtosis, a suggested transform."""
    numeric = [c for c, k in column_kinds(df, columns).items() if k in ("numeric", "boolean") and k != "empty"]

    def facts(c: str) -> dict[str, Column]:
        x = number(df, c)
        n, spread = F.count(x), F.stddev_pop(x)
        whole = F.count_if(x != F.floor(x)) == 0
        distinct = F.count_distinct(x)
        return {"n": n, "distinct": distinct, "shape": F.when(distinct <= 2, "binary").when((distinct <= 20) & whole, "discrete").otherwise("continuous"), "skew": F.when((n >= 3) & (spread > 0), F.skewness(x)), "kurtosis": F.when((n >= 4) & (spread > 0), F.kurtosis(x)), "zeros": F.count_if(x == 0), "negatives": F.count_if(x < 0), "least": F.min(x)}

    out = per_column(df, numeric, facts)
    skew = F.abs(F.coalesce("skew", F.lit(0.0)))
    advice = F.when((F.col("shape") == "binary") | (skew < SKEWED), "none").when((F.col("least") <= -1) & (skew >= 2), "binning").when(F.col("least") > -1, "log1p").otherwise("zscore")
    return out.withColumns({"suggested_transform": advice, "is_skewed": (skew >= SKEWED) & (F.col("shape") != "binary")}).drop("least")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """``bin``, its edges and count: equal widths, the last one closed; one bin when all values are equal."""
    x = number(df, column)
    f = one_row(df, F.min(x).alias("low"), F.max(x).alias("high"))
    if f["low"] is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    bins = bins if f["high"] > f["low"] else 1
    width = (f["high"] - f["low"]) / bins
    at = F.least(F.floor((x - F.lit(f["low"])) / F.lit(width)).cast("int"), F.lit(bins - 1)) if width else F.lit(0)
    counted = df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    low = F.lit(f["low"]) + F.col("bin") * F.lit(width)
    return every.join(counted, "bin", "left").select("bin", low.alias("lower"), (low + F.lit(width)).alias("upper"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r of complete pairs; null under three pairs or without spread."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count(a) >= 3, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def pearson_pairs(df: DataFrame, pairs: list[tuple[str, str]], least: int = 3) -> DataFrame:
    """``a``, ``b``, ``r`` of pairs of columns over the rows where both are numbers, by sums of products in one aggregate
    over the columns' distances from their means; null under ``least`` rows or without spread."""
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    mean = one_row(df, *(F.avg(number(df, c)).alias(c) for c in names))
    x = {c: F.col(f"x{i}") for i, c in enumerate(names)}
    moved = df.select(*((number(df, c) - F.lit(mean[c])).alias(f"x{i}") for i, c in enumerate(names)))
    sums = []
    for i, (a, b) in enumerate(pairs):
        p, q = F.when(x[b].isNotNull(), x[a]), F.when(x[a].isNotNull(), x[b])
        sums += [F.count(x[a] + x[b]).alias(f"n{i}"), F.sum(p).alias(f"a{i}"), F.sum(q).alias(f"b{i}"), F.sum(p * p).alias(f"aa{i}"), F.sum(q * q).alias(f"bb{i}"), F.sum(x[a] * x[b]).alias(f"ab{i}")]
    each = []
    for i, (a, b) in enumerate(pairs):
        n, sa, sb, saa, sbb, sab = (F.col(f"{k}{i}") for k in ("n", "a", "b", "aa", "bb", "ab"))
        r = F.try_divide(sab - sa * sb / n, F.sqrt(F.greatest((saa - sa * sa / n) * (sbb - sb * sb / n), F.lit(0.0))))
        r = F.when(n >= least, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
        each.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")))
    return moved.agg(*sums).select(F.explode(F.array(*each)).alias("c")).select("c.*")


def _ranked_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """Average ranks of both columns over their complete pairs, by counts of distinct values."""
    from quarry.functions.values import average_ranks

    both = df.select(number(df, a).alias("x"), number(df, b).alias("y")).where("x is not null and y is not null")
    rx = average_ranks(both.select("x")).select(F.col("value").alias("x"), F.col("rank").alias("rx"))
    ry = average_ranks(both.select("y")).select(F.col("value").alias("y"), F.col("rank").alias("ry"))
    return both.join(rx, "x").join(ry, "y").select("rx", "ry")


def correlations(df: DataFrame, columns=None, method: str = "pearson", top: int | None = 10) -> DataFrame:
    """``a``, ``b``, ``r`` and whether they are redundant, strongest first: all pairs of numeric columns in one
    aggregate (pearson), or over each pair's own ranks (spearman)."""
    numeric = [c for c, k in column_kinds(df, columns).items() if k in ("numeric", "boolean")]
    pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double, redundant boolean")
    if method == "pearson":
        out = pearson_pairs(df, pairs)
    elif method == "spearman":
        parts = [_ranked_pair(df, a, b).agg(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(F.col("rx"), F.col("ry")).alias("r")) for a, b in pairs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
    else:
        raise ValueError(f"unknown method: {method}")
    out = out.where("r is not null").withColumn("redundant", F.abs("r") >= REDUNDANT).orderBy(F.desc(F.abs("r")), "a", "b")
    return out.limit(top) if top else out


def correlation_ratio(df: DataFrame, x: Column, group: Column) -> DataFrame:
    """``eta`` of a number by a level: root of the share of its variance between groups (n >= 3, two groups)."""
    g = df.select(x.alias("x"), group.alias("g")).where("x is not null and g is not null").groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    whole = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.greatest(F.col("ss") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))
    return whole.select(F.when((F.col("n") >= 3) & (F.col("k") >= 2), F.sqrt(F.try_divide(between, between + F.col("within")))).alias("eta"))


def target_kind(df: DataFrame, target: str) -> str:
    k = key(df, target)
    f = one_row(df, F.count_distinct(F.when(~missing(df, target), k)).alias("levels"), F.count_if(~missing(df, target)).alias("n"), F.count(number(df, target)).alias("numbers"))
    return "binary" if f["levels"] == 2 else "numeric" if f["numbers"] >= TYPED_SHARE * f["n"] and f["levels"] > 20 else "multiclass"


def positive_class(df: DataFrame, target: str) -> str | None:
    """The first level spelled like yes, else the rarer one."""
    counted = df.where(~missing(df, target)).groupBy(key(df, target).alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy("n", "level").limit(2).collect()
    yes = [r["level"] for r in counted if r["level"].lower() in POSITIVE]
    return yes[0] if yes else counted[0]["level"] if counted else None


def target_summary(df: DataFrame, target: str, top: int = 10) -> DataFrame:
    """``column``, ``method`` and ``association`` with the target: |r| against a binary or numeric one, else the
    correlation ratio; ids, dates, text and categories with more levels than half the rows are left out."""
    roles, kind = column_roles(df, target=target), target_kind(df, target)
    out = None
    y = number(df, target) if kind == "numeric" else (key(df, target) == F.lit(positive_class(df, target))).cast("double")
    y = F.when(~missing(df, target), y)
    many = one_row(df, F.count(F.lit(1)).alias(" n"), *(F.count_distinct(key(df, c)).alias(c) for c in roles["categorical"]))
    for c in [x for x in (*roles["aggregation"], *roles["categorical"]) if x not in roles["ids"] and many.get(x, 0) <= 0.5 * many[" n"]]:
        numeric = c in roles["aggregation"]
        if numeric and kind != "multiclass":
            part = df.agg(F.lit(c).alias("column"), F.lit("pearson").alias("method"), F.abs(correlation(number(df, c), y)).alias("association"))
        else:
            x, g = (number(df, c), F.when(~missing(df, target), key(df, target))) if numeric else (y, F.when(~missing(df, c), key(df, c)))
            part = correlation_ratio(df, x, g).select(F.lit(c).alias("column"), F.lit("correlation_ratio").alias("method"), F.col("eta").alias("association"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.sparkSession.createDataFrame([], "column string, method string, association double, leaking boolean")
    return out.where("association is not null").withColumn("leaking", F.col("association") >= LEAKING).orderBy(F.desc("association"), "column").limit(top)


def target_balance(df: DataFrame, target: str) -> DataFrame:
    """``level``, ``n`` and ``share`` of the target's levels."""
    g = df.where(~missing(df, target)).groupBy(key(df, target).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("_all")))).select("level", "n", (F.col("n") / F.col("_all")).alias("share"))


def timeline(df: DataFrame, date_columns=None, reference_date=None) -> DataFrame:
    """Per date column: span, distinct days, unparsed cells, largest gap in days between dates, rows after the
    reference (default: now). Gaps are taken between distinct moments, month by month, so no task sorts all of them."""
    columns = names_of(date_columns) or column_roles(df)["dates"]
    reference = F.lit(str(reference_date)).cast("timestamp_ntz") if reference_date is not None else F.localtimestamp()
    out = None
    for c in columns:
        t = moment(df, c)
        days = df.where(t.isNotNull()).select(t.alias("t")).distinct().withColumn("month", F.date_trunc("month", "t"))
        inside = days.withColumn("gap", days_between(F.col("t"), F.lag("t").over(Window.partitionBy("month").orderBy("t"))))
        months = inside.groupBy("month").agg(F.min("t").alias("a"), F.max("t").alias("z"), F.max("gap").alias("gap"))
        across = months.withColumn("step", days_between(F.col("a"), F.lag("z").over(Window.orderBy("month"))))  # a row a month
        gap = across.agg(F.greatest(F.max("gap"), F.max("step")).alias("largest_gap_days"))
        facts = df.agg(F.lit(c).alias("column"), F.min(t).alias("first"), F.max(t).alias("last"), days_between(F.max(t), F.min(t)).alias("span_days"), F.count_distinct(F.to_date(t)).alias("distinct_days"), F.count_if(~missing(df, c) & t.isNull()).alias("unparsed"), F.count_if(t > reference).alias("after_reference"))
        part = facts.crossJoin(F.broadcast(gap))
        out = part if out is None else out.unionByName(part)
    return out


def periods(df: DataFrame, date_column: str, most: int = 12) -> DataFrame:
    """Rows per month, the last ``most`` months."""
    month = F.date_format(F.date_trunc("month", moment(df, date_column)), "yyyy-MM")
    return df.where(moment(df, date_column).isNotNull()).groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("month")).limit(most)


def grain(df: DataFrame, id_columns=None, date_columns=None) -> DataFrame:
    """Entities, repeated ones, a verdict, and rows and days per entity."""
    roles = column_roles(df, id_columns, date_columns)
    ids, dates = roles["ids"], roles["dates"]
    if not ids:
        return df.agg(F.lit(None).cast("long").alias("entities"), F.count(F.lit(1)).alias("n_rows"), F.lit("unknown").alias("verdict"))
    t = moment(df, dates[0]) if dates else F.lit(None).cast("timestamp_ntz")
    g = df.groupBy(*(key(df, c).alias(f"k{i}") for i, c in enumerate(ids))).agg(F.count(F.lit(1)).alias("n"), days_between(F.max(t), F.min(t)).alias("span"))
    at = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    out = g.agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.avg("n").alias("mean_rows"), F.percentile("n", at)[1].alias("median_rows"), F.max("n").alias("max_rows"), F.percentile("span", at)[1].alias("median_span_days"))
    return out.withColumn("verdict", F.when(F.col("n_repeated") == 0, "one row per entity").when(F.lit(bool(dates)), "event log").otherwise("unknown"))


def windows_for(median_span_days: float | None) -> list[int]:
    """Trailing windows no longer than half an entity's usual span."""
    return [w for w in (7, 30, 90) if median_span_days and w <= median_span_days / 2]


ANALYZERS = {f.__name__: f for f in (describe, missing_values, duplicates, outliers, distributions, correlations, target_summary, timeline, grain)}
