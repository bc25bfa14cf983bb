"""Categorical encodings and missing flags. Levels are counted by partial aggregates and joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.values import columns_of, divided, key, missing, names_of, one_row, places, quoted, sanitized
from quarry.operators.rows import Step, with_columns


def levels(df: DataFrame, column: str) -> DataFrame:
    """``level`` (trimmed text, empty for missing) and ``n``."""
    return df.select(key(df, column).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def top_levels(df: DataFrame, column: str, most: int) -> list[str]:
    """The commonest present levels, by count, then name."""
    return [r["level"] for r in levels(df, column).where("level <> ''").orderBy(F.desc("n"), "level").limit(most).collect()]


def _with_level(df: DataFrame, column: str, facts: DataFrame) -> DataFrame:
    return df.withColumn("_level", key(df, column)).join(facts.withColumnRenamed("level", "_of"), F.col("_level") == F.col("_of"), "left").drop("_level", "_of")


def frequency_encoding(df: DataFrame, categorical_columns=()) -> Step:
    """``{column}_frequency`` and its share of all rows; missing is a level of its own."""
    names = []
    for c in names_of(categorical_columns):
        counted = levels(df, c)
        total = df.agg(F.count(F.lit(1)).alias("_all"))
        facts = counted.crossJoin(F.broadcast(total)).select("level", F.col("n").alias(f"{c}_frequency"), divided(F.col("n"), F.col("_all")).alias(f"{c}_frequency_ratio"))
        df = _with_level(df, c, facts)
        names += [f"{c}_frequency", f"{c}_frequency_ratio"]
    return df, names


def one_hot_encoding(df: DataFrame, categorical_columns=(), max_categories: int = 10) -> Step:
    """``{column}_is_{level}`` of the commonest levels; missing cells are 0 in all. Levels whose names come out alike
    share a column, where the last one counts."""
    new = {}
    for c in names_of(categorical_columns):
        for level in top_levels(df, c, max_categories):
            new[f"{c}_is_{sanitized(level)}"] = (key(df, c) == F.lit(level)).cast("int")
    return with_columns(df, new)


def ordinal_encoding(df: DataFrame, categorical_columns=()) -> Step:
    """``{column}_ordinal``: 0 for the commonest level (ties by name), null when missing.

    Levels are ranked range by range, so a column of many rare levels does not end in one task.
    """
    names = []
    for c in names_of(categorical_columns):
        facts = places(levels(df, c).where("level <> ''")).select("level", F.col("place").cast("int").alias(f"{c}_ordinal"))
        df = _with_level(df, c, facts)
        names.append(f"{c}_ordinal")
    return df, names


def rare_category_grouping(df: DataFrame, categorical_columns=(), min_frequency: float = 0.01) -> Step:
    """``{column}_grouped``: the level, or ``other`` if it has under max(1, int(share of rows))."""
    names = []
    for c in names_of(categorical_columns):
        least = max(1, int(min_frequency * df.count()))
        facts = levels(df, c).select("level", F.when(F.col("n") < least, F.lit("other")).otherwise(F.col("level")).alias(f"{c}_grouped"))
        df = _with_level(df, c, facts)
        names.append(f"{c}_grouped")
    return df, names


def missing_indicators(df: DataFrame, columns=()) -> Step:
    """``{column}_is_missing`` of columns with holes, and ``row_missing_count`` over all columns looked at."""
    columns = columns_of(df, columns)
    holes = one_row(df, *(F.count_if(missing(df, c)).alias(c) for c in columns)) if columns else {}
    new = {f"{c}_is_missing": missing(df, c).cast("int") for c in columns if holes[c]}
    new["row_missing_count"] = sum((missing(df, c).cast("int") for c in columns), F.lit(0))
    return with_columns(df, new)


def boolean_flag(df: DataFrame, column: str, true_tokens) -> Column:
    text = F.lower(F.trim(quoted(column).cast("string")))
    return F.when(~missing(df, column), text.isin(*true_tokens).cast("int"))
