"""Row-level numeric features: transforms, scaling, bins, outliers, pairs of columns, statistics across a row.

Each step takes a table and returns it with new columns and their names. Statistics of whole columns come from one
aggregate; everything else is a projection.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.values import average_ranks, columns_of, divided, is_numeric, missing, names_of, number, one_row, quantiles, quoted, unused

Step = tuple[DataFrame, list[str]]


def _null() -> Column:
    return F.lit(None).cast("double")


def with_columns(df: DataFrame, new: dict[str, Column]) -> Step:
    return (df.withColumns(new) if new else df), list(new)


def transformed(x: Column, operation: str) -> Column:
    """One value under a named operation; null outside its domain."""
    big = F.abs(x) < 1e154
    table = {
        "log": F.when(x > 0, F.ln(x)),
        "log1p": F.when(x > -1, F.log1p(x)),
        "sqrt": F.when(x >= 0, F.sqrt(x)),
        "square": F.when(big, x * x),
        "cube_root": F.cbrt(x),
        "reciprocal": F.try_divide(F.lit(1.0), x),
        "abs": F.abs(x),
        "sign": F.signum(x),
        "exp_decay": F.when(x >= -700, F.exp(-x)),
    }
    if operation not in table:
        raise ValueError(f"unknown operation: {operation}")
    return table[operation]


def math_transformations(df: DataFrame, columns=(), operations=("log1p", "sqrt", "square")) -> Step:
    """``{column}_{operation}`` of each column."""
    new = {f"{c}_{o}": transformed(number(df, c), o) for c in names_of(columns) for o in names_of(operations)}
    return with_columns(df, new)


def quantiles_of(df: DataFrame, columns: list[str], at: list[float]) -> dict[str, list[float] | None]:
    """Exact interpolated quantiles of each column's numbers."""
    return quantiles(df, {c: number(df, c) for c in columns}, at)


def scaling(df: DataFrame, columns=(), method: str = "zscore") -> Step:
    """``{column}_{method}``: zscore (sample deviation), minmax, robust (median, quartiles) or rank (mean rank of ties
    over n - 1). No spread gives 0; a column without numbers is skipped."""
    columns = names_of(columns)
    x = {c: number(df, c) for c in columns}
    facts = one_row(df, *(f for c in columns for f in (F.count(x[c]).alias(f"n {c}"), F.avg(x[c]).alias(f"avg {c}"), F.stddev_samp(x[c]).alias(f"sd {c}"), F.min(x[c]).alias(f"min {c}"), F.max(x[c]).alias(f"max {c}")))) if columns else {}
    quarters = quantiles_of(df, columns, [0.25, 0.5, 0.75]) if method == "robust" else {}
    names = []
    for c in columns:
        n = facts[f"n {c}"]
        if not n:
            continue
        name = f"{c}_{method}"
        names.append(name)
        if method == "rank":
            ranks = average_ranks(df.select(x[c].alias("v"))).select(F.col("value").alias("_v"), divided(F.col("rank"), F.col("n") - 1).alias(name))
            df = df.withColumn("_x", x[c]).join(ranks, F.col("_x") == F.col("_v"), "left").drop("_x", "_v")
            if n == 1:
                df = df.withColumn(name, F.when(number(df, c).isNotNull(), F.lit(0.0)))
            continue
        if method == "zscore":
            centre, spread = facts[f"avg {c}"], facts[f"sd {c}"] or 0.0
        elif method == "minmax":
            centre, spread = facts[f"min {c}"], facts[f"max {c}"] - facts[f"min {c}"]
        elif method == "robust":
            centre, spread = quarters[c][1], quarters[c][2] - quarters[c][0]
        else:
            raise ValueError(f"unknown method: {method}")
        df = df.withColumn(name, (x[c] - F.lit(centre)) / F.lit(spread) if spread else F.when(x[c].isNotNull(), F.lit(0.0)))
    return df, names


def _edges(low: float, high: float, quantiles: list[float], bins: int, strategy: str) -> list[float]:
    if strategy == "quantile":
        return quantiles
    if strategy == "uniform":
        return [low + (high - low) * i / bins for i in range(1, bins)]
    raise ValueError(f"unknown strategy: {strategy}")


def binning(df: DataFrame, columns=(), bins: int = 4, strategy: str = "quantile") -> Step:
    """``{column}_bin``: how many inner edges lie strictly below the value; skipped with fewer values than bins."""
    columns = names_of(columns)
    x = {c: number(df, c) for c in columns}
    facts = one_row(df, *(f for c in columns for f in (F.count(x[c]).alias(f"n {c}"), F.min(x[c]).alias(f"low {c}"), F.max(x[c]).alias(f"high {c}")))) if columns else {}
    inner = quantiles_of(df, columns, [i / bins for i in range(1, bins)]) if strategy == "quantile" else {}
    new = {}
    for c in columns:
        if facts[f"n {c}"] >= bins:
            edges = _edges(facts[f"low {c}"], facts[f"high {c}"], inner.get(c), bins, strategy)
            new[f"{c}_bin"] = sum(((x[c] > F.lit(e)).cast("int") for e in edges), F.lit(0))
            new[f"{c}_bin"] = F.when(x[c].isNotNull(), new[f"{c}_bin"])
    return with_columns(df, new)


def outliers(df: DataFrame, columns=(), lower: float = 0.01, upper: float = 0.99) -> Step:
    """``{column}_winsorized`` (clipped to two quantiles) and ``{column}_is_outlier``; skipped under three values."""
    columns = names_of(columns)
    x = {c: number(df, c) for c in columns}
    many = one_row(df, *(F.count(x[c]).alias(c) for c in columns)) if columns else {}
    columns = [c for c in columns if many[c] >= 3]
    ends = quantiles_of(df, columns, [lower, upper])
    new = {}
    for c in columns:
        low, high = ends[c]
        new[f"{c}_winsorized"] = F.when(x[c].isNotNull(), F.least(F.greatest(x[c], F.lit(low)), F.lit(high)))
        new[f"{c}_is_outlier"] = ((x[c] < low) | (x[c] > high)).cast("int")
    return with_columns(df, new)


def ratios(df: DataFrame, columns=(), max_features: int = 12) -> Step:
    """``{a}_per_{b}`` of ordered pairs, the first ``max_features``."""
    pairs = list(permutations(names_of(columns), 2))[:max_features]
    return with_columns(df, {f"{a}_per_{b}": divided(number(df, a), number(df, b)) for a, b in pairs})


def interactions(df: DataFrame, columns=(), operations=("product", "difference"), max_features: int = 12) -> Step:
    """Products, differences and sums of pairs of columns, of the first ``max_features`` pairs."""
    ways = {"product": lambda a, b: a * b, "difference": lambda a, b: a - b, "sum": lambda a, b: a + b}
    new = {}
    for a, b in list(combinations(names_of(columns), 2))[:max_features]:
        for o in names_of(operations):
            new[f"{a}_{o[:4]}_{b}"] = ways[o](number(df, a), number(df, b))
    return with_columns(df, new)


def row_statistics(df: DataFrame, columns=()) -> Step:
    """Total, mean, greatest, least, sample deviation and number of non-zeros across two or more columns."""
    columns = names_of(columns)
    if len(columns) < 2:
        return df, []
    df = df.withColumn("_row", F.array_compact(F.array(*(number(df, c) for c in columns))))
    n = F.size("_row")
    total = F.aggregate("_row", F.lit(0.0), lambda s, v: s + v)
    some = n > 0
    mean = total / F.greatest(n, F.lit(1))
    squares = F.aggregate("_row", F.lit(0.0), lambda s, v: s + (v - F.col("row_mean")) * (v - F.col("row_mean")))
    df = df.withColumns({"row_total": F.when(some, total), "row_mean": F.when(some, mean), "row_max": F.array_max("_row"), "row_min": F.array_min("_row")})
    df = df.withColumns({"row_std": F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(squares / F.greatest(n - 1, F.lit(1)))), "row_nonzero_count": F.size(F.filter("_row", lambda v: v != 0))})
    return df.drop("_row"), ["row_total", "row_mean", "row_max", "row_min", "row_std", "row_nonzero_count"]


# ---------------------------------------------------------------- cleaning's transform


def transform(df: DataFrame, transformations=()) -> tuple[DataFrame, dict]:
    """Named transformations of numeric columns (``{column, operation, as, bins}``); never overwrites a column.

    zscore uses the population deviation, bucket inclusive quantile edges; without spread, range or enough values all
    cells are null and the entry is noted as skipped.
    """
    original = {c for c in df.columns if is_numeric(df, c)}
    names, skipped = [], []
    for t in transformations:
        c, operation = t["column"], t["operation"]
        if c not in original:
            raise ValueError(f"not a numeric column: {c}")
        x = number(df, c)
        name = unused(df, t.get("as") or f"{c}_{operation}")
        if operation in ("zscore", "minmax", "bucket"):
            bins = int(t.get("bins", 4))
            f = one_row(df, F.count(x).alias("n"), F.avg(x).alias("avg"), F.stddev_pop(x).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"))
            if operation == "zscore":
                value = (x - F.lit(f["avg"])) / F.lit(f["sd"]) if f["sd"] else None
            elif operation == "minmax":
                value = (x - F.lit(f["low"])) / F.lit(f["high"] - f["low"]) if f["n"] and f["high"] > f["low"] else None
            else:
                edges = quantiles(df, {c: x}, [i / bins for i in range(1, bins)])[c] if f["n"] >= bins else []
                value = F.when(x.isNotNull(), sum(((x > F.lit(e)).cast("int") for e in edges), F.lit(0)).cast("double")) if edges else None
            if value is None:
                skipped.append(name)
                value = _null()
        else:
            value = transformed(x, operation)
        df = df.withColumn(name, value)
        names.append(name)
    undefined = one_row(df, *(F.count_if(quoted(n).isNull()).alias(n) for n in names)) if names else {}
    return df, {"added": names, "skipped": skipped, "undefined": undefined}


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in columns_of(df, None) if isinstance(df.schema[c].dataType, T.NumericType)]


def missing_to_null(df: DataFrame, column: str) -> Column:
    return F.when(~missing(df, column), quoted(column))
