"""Cleaning steps: each takes a table and returns a new one with what it did."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.values import DECIMAL, INTEGER, MISSING_TOKENS, ORDER, columns_of, is_numeric, key, missing, names_of, number, one_row, ordered, quantiles, quoted, stripped
from quarry.operators.missing import modes
from quarry.operators.rows import transform as _transform

Done = tuple[DataFrame, dict]


def tidy(name: str, lowercase: bool) -> str:
    text = re.sub(r"[^0-9a-zA-Z]+", "_", name).strip("_")
    text = f"column_{text}" if text[:1].isdigit() or not text else text
    return text.lower() if lowercase else text


def normalize_columns(df: DataFrame, lowercase: bool = True, replacements: dict | None = None) -> Done:
    """Plain names: explicit renames, other signs as ``_``, no leading digit, collisions numbered."""
    taken: set[str] = set()
    renamed = {}
    for c in df.columns:
        new = c if c == ORDER else (replacements or {}).get(c) or tidy(c, lowercase)
        base, k = new, 2
        while new in taken:
            new, k = f"{base}_{k}", k + 1
        taken.add(new)
        renamed[c] = new
    return df.toDF(*renamed.values()), {"renamed": {a: b for a, b in renamed.items() if a != b}}


def strip_whitespace(df: DataFrame, columns=None, empty_as_missing: bool = True) -> Done:
    """Trims texts; empty and missing-token texts become null."""
    texts = [c for c in columns_of(df, columns) if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return df, {"stripped": {}, "emptied": {}}
    trim = {c: stripped(quoted(c)) for c in texts}
    hole = {c: F.lower(trim[c]).isin(*MISSING_TOKENS) for c in texts}
    facts = one_row(df, *(F.count_if(trim[c] != quoted(c)).alias(f"s {c}") for c in texts), *(F.count_if(hole[c]).alias(f"e {c}") for c in texts))
    out = df.withColumns({c: F.when(~hole[c], trim[c]) if empty_as_missing else trim[c] for c in texts})
    return out, {"stripped": {c: facts[f"s {c}"] for c in texts}, "emptied": {c: facts[f"e {c}"] if empty_as_missing else 0 for c in texts}}


def as_boolean(df: DataFrame, column: str):
    text = F.lower(stripped(quoted(column).cast("string")))
    return F.when(text.isin("true", "yes", "y", "1", "t", "1.0"), True).when(text.isin("false", "no", "n", "0", "f", "0.0"), False)


def cast_to(df: DataFrame, column: str, kind: str):
    """A cell as int (by way of float), float, bool, str, date or datetime; null when it cannot be."""
    if kind == "int":
        x = number(df, column)
        return F.when(F.abs(x) < 9e18, F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))).cast("long")
    if kind == "float":
        return number(df, column)
    if kind == "bool":
        return as_boolean(df, column)
    if kind == "str":
        return quoted(column).cast("string")
    if kind in ("date", "datetime"):
        from quarry.functions.values import moment

        return moment(df, column).cast("date") if kind == "date" else moment(df, column)
    raise ValueError(f"unknown type: {kind}")


def coerce_types(df: DataFrame, schema: dict | None = None, columns=None) -> Done:
    """Casts to a schema (cells that cannot be become null, counted), or infers bool, int or float of text columns
    whose present values all convert. Dates are never inferred."""
    if schema:
        columns_of(df, list(schema))
        new = {c: cast_to(df, c, k) for c, k in schema.items()}
        lost = one_row(df, *(F.count_if(~missing(df, c, tokens=False) & v.isNull()).alias(c) for c, v in new.items()))
        return df.withColumns(new), {"cast": dict(schema), "lost": lost}
    texts = [c for c in columns_of(df, columns) if isinstance(df.schema[c].dataType, T.StringType)]
    tests = {}
    for c in texts:
        t = stripped(quoted(c))
        tests |= {f"n {c}": F.count(t), f"bool {c}": F.count_if(F.lower(t).isin("true", "false")), f"int {c}": F.count_if(t.rlike(INTEGER) & t.try_cast("long").isNotNull()), f"float {c}": F.count_if(t.rlike(DECIMAL))}
    facts = one_row(df, *(v.alias(k) for k, v in tests.items())) if tests else {}
    found = {c: next((k for k in ("bool", "int", "float") if facts[f"n {c}"] and facts[f"{k} {c}"] == facts[f"n {c}"]), None) for c in texts}
    found = {c: k for c, k in found.items() if k}
    types = {"bool": "boolean", "int": "long", "float": "double"}
    return (df.withColumns({c: stripped(quoted(c)).try_cast(types[k]) for c, k in found.items()}) if found else df), {"cast": found, "lost": {}}


def drop_duplicates(df: DataFrame, subset=None, keep: str = "first", order=None) -> Done:
    """One row a key (nulls equal): the first or last in the table's order. With an order it is exact; a last row
    takes the first one's place. Rows of a key are combined before the shuffle, however many there are."""
    columns = columns_of(df, subset)
    place = ordered(df, order)
    n = df.count()
    if not place:
        return (out := df.dropDuplicates(columns)), {"removed": n - out.count()}
    by = [F.to_json(quoted(c)) if isinstance(df.schema[c].dataType, T.MapType) else quoted(c) for c in columns]
    at = F.struct(*(quoted(p).alias(f"p{i}") for i, p in enumerate(place)))  # nulls come first, as in a sort
    best = (F.max_by if keep == "last" else F.min_by)(F.struct(*map(quoted, df.columns)), at)
    first = [F.min(ORDER).alias("_first")] if keep == "last" and ORDER in df.columns else []
    out = df.groupBy(*(b.alias(f"_k{i}") for i, b in enumerate(by))).agg(best.alias("_row"), *first)
    out = out.select("_row.*", "_first").withColumn(ORDER, F.col("_first")).drop("_first") if first else out.select("_row.*")
    return out, {"removed": n - out.count()}


def drop_missing_rows(df: DataFrame, columns=None, how: str = "any") -> Done:
    """Drops rows with any (or all) of the columns missing."""
    holes = [missing(df, c, tokens=False) for c in columns_of(df, columns)]
    hit = holes[0]
    for h in holes[1:]:
        hit = hit | h if how == "any" else hit & h
    return df.where(~hit), {}


def drop_missing_columns(df: DataFrame, max_missing_rate: float = 0.5) -> Done:
    """Drops columns with a higher share of holes."""
    columns = columns_of(df, None)
    row = one_row(df, F.count(F.lit(1)).alias(" n"), *(F.count_if(missing(df, c, tokens=False)).alias(c) for c in columns))
    gone = [c for c in columns if row[" n"] and row[c] / row[" n"] > max_missing_rate]
    return df.drop(*gone), {"dropped": gone}


def drop_constant_columns(df: DataFrame, drop_empty: bool = True) -> Done:
    """Drops columns with one present value (or none, if ``drop_empty``)."""
    columns = columns_of(df, None)
    there = {c: F.when(~missing(df, c, tokens=False), key(df, c)) for c in columns}
    row = one_row(df, *(F.min(v).alias(f"a {c}") for c, v in there.items()), *(F.max(v).alias(f"z {c}") for c, v in there.items()))
    gone = [c for c in columns if (row[f"a {c}"] is None and drop_empty) or (row[f"a {c}"] is not None and row[f"a {c}"] == row[f"z {c}"])]
    return df.drop(*gone), {"dropped": gone}


def drop_columns(df: DataFrame, columns=()) -> Done:
    """Drops the columns that are there."""
    gone = [c for c in names_of(columns) if c in df.columns]
    return df.drop(*gone), {"dropped": gone}


def bounds(df: DataFrame, columns: list[str], method: str, factor: float) -> dict[str, tuple[float, float]]:
    """Outlier bounds of each column: quartiles and their range (iqr), or mean and population deviation (zscore)."""
    out = {}
    facts = one_row(df, *(f for c in columns for x in (number(df, c),) for f in (F.avg(x).alias(f"m {c}"), F.stddev_pop(x).alias(f"s {c}")))) if columns else {}
    quarters = quantiles(df, {c: number(df, c) for c in columns}, [0.25, 0.75]) if method == "iqr" else {}
    for c in columns:
        if facts[f"m {c}"] is None:
            continue
        if method == "iqr":
            low, high = quarters[c]
            reach = factor * (high - low)
        elif method == "zscore":
            low = high = facts[f"m {c}"]
            reach = factor * facts[f"s {c}"]
        else:
            raise ValueError(f"unknown method: {method}")
        if reach > 0:
            out[c] = (low - reach, high + reach)
    return out


def clip_outliers(df: DataFrame, columns=None, method: str = "iqr", factor: float = 1.5, action: str = "clip") -> Done:
    """Clips cells to bounds learned from the data as given, or drops their rows. Columns with two values or fewer
    and without spread are left."""
    numeric = [c for c in columns_of(df, columns) if is_numeric(df, c)]
    many = one_row(df, *(F.count_distinct(number(df, c)).alias(c) for c in numeric)) if numeric else {}
    found = bounds(df, [c for c in numeric if many[c] > 2], method, factor)
    if action == "clip":
        new = {c: F.when(number(df, c).isNotNull(), F.least(F.greatest(number(df, c), F.lit(a)), F.lit(z))) for c, (a, z) in found.items()}
        return (df.withColumns(new) if new else df), {"bounds": found}
    for c, (a, z) in found.items():
        df = df.where(number(df, c).isNull() | number(df, c).between(a, z))
    return df, {"bounds": found}


def fill_missing(df: DataFrame, strategy: str = "auto", columns=None, value=None, order=None) -> Done:
    """Fills holes: auto (median of numbers, else mode), median, mean, mode, zero or constant."""
    columns = columns_of(df, columns)
    numeric = [c for c in columns if is_numeric(df, c)]
    if strategy in ("zero", "constant"):
        fills = {c: 0 if strategy == "zero" else value for c in columns}
    elif strategy in ("auto", "median", "mean"):
        if strategy == "mean":
            fills = one_row(df, *(F.avg(number(df, c)).alias(c) for c in numeric)) if numeric else {}
        else:
            fills = {c: q and q[0] for c, q in quantiles(df, {c: number(df, c) for c in numeric}, [0.5]).items()}
        fills |= modes(df, [c for c in columns if c not in numeric], order)
    elif strategy == "mode":
        fills = modes(df, columns, order)
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    holes = one_row(df, *(F.count_if(missing(df, c, tokens=False)).alias(c) for c in columns)) if columns else {}
    fills = {c: v for c, v in fills.items() if v is not None and holes[c]}
    new = {}
    for c, v in fills.items():
        kind = df.schema[c].dataType
        own = F.when(~missing(df, c, tokens=False), quoted(c))
        whole = isinstance(kind, T.IntegralType) and (not isinstance(v, float) or v == int(v))
        new[c] = F.coalesce(own, F.lit(v).cast(kind)) if whole or not isinstance(kind, T.IntegralType) else F.coalesce(own.cast("double"), F.lit(v))
    return (df.withColumns(new) if new else df), {"filled": {c: {"value": fills[c], "holes": holes[c]} for c in fills}}


def transform(df: DataFrame, transformations=()) -> Done:
    return _transform(df, transformations)


STEPS = {f.__name__: f for f in (normalize_columns, strip_whitespace, coerce_types, drop_duplicates, drop_missing_rows, fill_missing, drop_missing_columns, drop_constant_columns, drop_columns, clip_outliers, transform)}
TRANSFORMATIONS = ("log", "log1p", "sqrt", "square", "abs", "reciprocal", "zscore", "minmax", "bucket")
DEFAULT_STEPS = ("normalize_columns", "strip_whitespace", "coerce_types", "drop_duplicates", "drop_constant_columns", "fill_missing")
