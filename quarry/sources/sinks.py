"""Sinks: CSV, JSON and Parquet tables, and reports as JSON."""

from __future__ import annotations

import datetime
import decimal
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.values import ORDER, missing, quoted


def _written(df: DataFrame, round_to: int | None) -> DataFrame:
    """Cells as a file holds them: missing as null, dates as ISO text, nested cells as JSON."""
    new = {}
    for f in df.drop(ORDER).schema.fields:
        c = F.when(~missing(df, f.name, tokens=False), quoted(f.name))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and round_to is not None:
            c = F.round(c, round_to)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.lower(F.hex(c))
        new[f.name] = c
    out = df.orderBy(ORDER) if ORDER in df.columns else df
    return out.select(*(c.alias(n) for n, c in new.items()))


def write_csv(df: DataFrame, path: str, delimiter: str = ",", single: bool = False) -> str:
    """Comma-separated files with a header in folder ``path``; one file only if the contract asks for it."""
    out = _written(df, None)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    return path


def write_data(df: DataFrame, path: str) -> str:
    """JSON lines, Parquet or CSV by the path's suffix; floats rounded to six digits in text."""
    if path.endswith(".parquet"):
        df.drop(ORDER).write.mode("overwrite").parquet(path)
    elif path.endswith((".json", ".jsonl")):
        _written(df, 6).write.mode("overwrite").json(path)
    else:
        _written(df, 6).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def default_output_path(source: str, suffix: str) -> str:
    """``{source}__{suffix}`` beside the source, as CSV unless it is JSON."""
    stem, extension = os.path.splitext(source)
    return f"{stem}__{suffix}{extension if extension.lower() in ('.csv', '.json') else '.csv'}"


def json_safe(value):
    """A value as JSON holds it: dates ISO, decimals as numbers, bytes as hex, nested values too."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_safe(v) for v in value]
    if isinstance(value, (datetime.date, datetime.time)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return None if isinstance(value, float) and value != value else value


def write_report(report: dict, path: str) -> str:
    """A report as a JSON file on the driver."""
    with open(path, "w", encoding="utf-8") as out:
        json.dump(json_safe(report), out, indent=2, ensure_ascii=False)
    return path
