"""Readers: delimited text, JSON, JSON Lines, Parquet, Excel, SQL; format detection; one router.

Text cells are typed by a projection that Spark runs (missing tokens to null; a column becomes boolean, long or double
if all its present cells read as such, else trimmed text). Only format detection peeks at a file, through Spark's own
readers, so paths may be in any store that Spark reads.
"""

from __future__ import annotations

import csv
import inspect
import io
import time
import zipfile
from dataclasses import dataclass, replace
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.values import DECIMAL, INTEGER, MISSING_TOKENS, ORDER, names_of, one_row, quoted, stripped

PEEK = 64 * 1024
DELIMITERS = {".tsv": "\t", ".tab": "\t", ".psv": "|"}
SNIFFED = (".csv", ".txt", ".dat")
JSON_LINES = (".jsonl", ".ndjson")
PACKED = (".gz", ".bz2", ".xz")
EXCEL = (".xlsx", ".xlsm", ".xls")


@dataclass(frozen=True)
class Frame:
    """A table with where it came from."""

    df: DataFrame
    source: str = ""
    format: str = ""
    truncated: bool = False
    elapsed_seconds: float = 0.0

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ORDER]

    def select(self, columns) -> Frame:
        """The columns asked for, in that order; ValueError for unknown ones."""
        unknown = [c for c in names_of(columns) if c not in self.columns]
        if unknown:
            raise ValueError(f"unknown columns: {', '.join(unknown)}")
        return replace(self, df=self.df.select(*map(quoted, [*names_of(columns), *(c for c in (ORDER,) if c in self.df.columns)])))

    def head(self, limit: int = 5) -> list[dict]:
        """The first rows."""
        df = self.df.orderBy(ORDER) if ORDER in self.df.columns else self.df
        return [r.asDict() for r in df.limit(limit).drop(ORDER).collect()]

    def dtypes(self) -> dict[str, str]:
        """int, float, bool, date, datetime or str of each column; unknown when it has no present value."""
        holes = one_row(self.df, *(F.count(quoted(c)).alias(c) for c in self.columns)) if self.columns else {}
        return {c: _dtype(self.df.schema[c].dataType) if holes[c] else "unknown" for c in self.columns}

    def profile(self) -> dict:
        """Shape, names and types, and how it was read."""
        return {"rows": self.df.count(), "columns": self.dtypes(), "source": self.source, "format": self.format, "truncated": self.truncated, "elapsed_seconds": self.elapsed_seconds}


def _dtype(kind: T.DataType) -> str:
    for types, name in (((T.BooleanType,), "bool"), ((T.IntegralType,), "int"), ((T.NumericType,), "float"), ((T.DateType,), "date"), ((T.TimestampType, T.TimestampNTZType), "datetime")):
        if isinstance(kind, types):
            return name
    return "str"


def _limited(df: DataFrame, limit: int | None) -> tuple[DataFrame, bool]:
    """The first rows, and whether there were more: one more is asked for and counted."""
    if limit is None:
        return df, False
    df = df.orderBy(ORDER) if ORDER in df.columns else df
    return df.limit(limit), df.limit(limit + 1).count() > limit


def _ordered(df: DataFrame) -> DataFrame:
    """The position in the source: file by file, row by row."""
    return df.withColumn(ORDER, F.monotonically_increasing_id())


def _chosen(df: DataFrame, columns) -> DataFrame:
    wanted = names_of(columns)
    unknown = [c for c in wanted if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return df.select(*map(quoted, [*wanted, *(c for c in (ORDER,) if c in df.columns)])) if wanted else df


def unique_names(header: list[str]) -> list[str]:
    """Blank names by position, repeated ones numbered so that none collide."""
    out: list[str] = []
    for i, name in enumerate(header, 1):
        base = (name or "").strip() or f"column_{i}"
        new, k = base, 2
        while new in out or (new != base and new in header):
            new, k = f"{base}_{k}", k + 1
        out.append(new)
    return out


def coerced(df: DataFrame, columns: list[str], missing_values=None) -> DataFrame:
    """Typed columns: missing tokens become null, then booleans, whole and decimal numbers where every cell fits."""
    tokens = [t.lower() for t in names_of(missing_values)] or list(MISSING_TOKENS)
    cell = {c: F.when(~F.lower(stripped(quoted(c))).isin(*tokens), stripped(quoted(c))) for c in columns}
    facts = one_row(df, *(f for c, v in cell.items() for f in (F.count(v).alias(f"n {c}"), F.count_if(F.lower(v).isin("true", "false")).alias(f"b {c}"), F.count_if(v.rlike(INTEGER) & v.try_cast("long").isNotNull()).alias(f"i {c}"), F.count_if(v.rlike(DECIMAL)).alias(f"f {c}")))) if cell else {}
    new = {}
    for c, v in cell.items():
        n = facts[f"n {c}"]
        kind = "boolean" if n and facts[f"b {c}"] == n else "long" if n and facts[f"i {c}"] == n else "double" if n and facts[f"f {c}"] == n else "string"
        new[c] = v.try_cast(kind)
    return df.withColumns(new) if new else df


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for p in PACKED:
        name = name.removesuffix(p)
    return "." + name.rsplit(".", 1)[-1] if "." in name else ""


def _peek(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file (decompressed as text readers do)."""
    row = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, PEEK).alias("c")).limit(1).collect()
    if row and row[0]["path"].lower().endswith(PACKED):  # a packed file, or a folder of them
        lines = spark.read.text(path).limit(200).collect()
        return "\n".join(r[0] for r in lines).encode()[:PEEK]
    return bytes(row[0]["c"]) if row else b""


def sniffed_delimiter(sample: str) -> str:
    """The delimiter that the standard sniffer finds, else the commonest candidate in the first line, else a comma."""
    try:
        return csv.Sniffer().sniff(sample, ",;\t|").delimiter
    except csv.Error:
        first = sample.split("\n", 1)[0]
        best = max(",;\t|", key=first.count)
        return best if first.count(best) else ","


def detect_format(spark: SparkSession, path: str) -> str:
    """delimited, json, jsonl, parquet or excel, by suffix, magic bytes, then content."""
    suffix = _suffix(path)
    known = {".json": "json", ".parquet": "parquet", ".pq": "parquet"} | dict.fromkeys(JSON_LINES, "jsonl") | dict.fromkeys(EXCEL, "excel") | dict.fromkeys((*DELIMITERS, *SNIFFED), "delimited")
    if suffix in known:
        return known[suffix]
    head = _peek(spark, path)
    if head[:4] == b"PAR1":
        return "parquet"
    if head[:2] == b"PK":
        return "excel"
    text = head.decode("utf-8", "replace").lstrip("﻿ \t\r\n")
    if text[:1] in "{[" and text:
        import json

        try:
            return "jsonl" if isinstance(json.loads(text.split("\n", 1)[0]), dict) and "\n" in text.strip() else "json"
        except ValueError:
            return "json"
    return "delimited"


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "utf-8", has_header: bool = True, column_names=None, limit: int | None = None, columns=None, coerce: bool = True, missing_values=None) -> Frame:
    """Separated text, plain or packed. Ragged rows are padded or cut, blank lines skipped."""
    began = time.monotonic()
    if path.lower().endswith(".xz"):
        return _read_xz(spark, path, began, delimiter, encoding, has_header, column_names, limit, columns, coerce, missing_values)
    delimiter = delimiter or DELIMITERS.get(_suffix(path)) or sniffed_delimiter(_peek(spark, path).decode(encoding, "replace"))
    options = {"sep": delimiter, "quote": '"', "escape": '"', "encoding": encoding, "multiLine": "true", "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "enforceSchema": "true"}
    first = next((r for r in csv.reader(io.StringIO(_peek(spark, path).decode(encoding, "replace").lstrip("﻿")), delimiter=delimiter) if r), [])
    names = names_of(column_names) or (unique_names(first) if has_header else [f"column_{i}" for i in range(1, len(first) + 1)])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.options(**options, header=str(has_header).lower()).schema(schema).csv(path) if names else spark.createDataFrame([], "value string")
    return _finished(df, path, "delimited", began, names, limit, columns, coerce, missing_values)


def _read_xz(spark, path, began, delimiter, encoding, has_header, column_names, limit, columns, coerce, missing_values) -> Frame:
    """xz has no codec in Spark: each file is unpacked whole by one task, then read like any text."""
    import lzma

    def unpack(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame({"value": [ln for ln in lzma.decompress(content).decode(encoding).splitlines() if ln.strip()]})

    lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "value string")
    lines = _ordered(lines)
    head = [r["value"] for r in lines.orderBy(ORDER).limit(20).collect()]
    delimiter = delimiter or DELIMITERS.get(_suffix(path)) or sniffed_delimiter("\n".join(head))
    first = next(csv.reader(head, delimiter=delimiter), [])
    names = names_of(column_names) or (unique_names(first) if has_header else [f"column_{i}" for i in range(1, len(first) + 1)])
    body = lines.where(F.col(ORDER) > lines.agg(F.min(ORDER)).head()[0]) if has_header and head else lines
    schema = ", ".join(f"`{n}` string" for n in names)
    df = body.select(F.from_csv("value", schema, {"sep": delimiter, "quote": '"', "escape": '"'}).alias("r"), ORDER).select("r.*", ORDER)
    return _finished(df, path, "delimited", began, names, limit, columns, coerce, missing_values)


def _finished(df, path, kind, began, names, limit, columns, coerce=False, missing_values=None) -> Frame:
    df = df if ORDER in df.columns else _ordered(df)
    if names and kind == "delimited":
        blank = F.lit(True)
        for n in names:
            blank = blank & (quoted(n).isNull() | (quoted(n) == ""))
        df = df.where(~blank)
    df = _chosen(df, columns)
    df, truncated = _limited(df, limit)
    if coerce:
        df = coerced(df, [c for c in df.columns if c != ORDER], missing_values)
    return Frame(df, path, kind, truncated, time.monotonic() - began)


def _records(df: DataFrame, record_path: str | None) -> DataFrame:
    """The rows of a JSON document: a dotted path, the only array, or the document itself; scalars as ``value``."""
    if record_path:
        for part in record_path.split("."):
            if part not in df.columns:
                raise ValueError(f"no records at {record_path}")
            kind = df.schema[part].dataType
            df = df.select(F.explode(part).alias("r") if isinstance(kind, T.ArrayType) else quoted(part).alias("r"))
            df = df.select("r.*") if isinstance(df.schema["r"].dataType, T.StructType) else df.withColumnRenamed("r", "value")
        return df
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return _records(df, arrays[0]) if len(arrays) == 1 else df


def read_json(spark: SparkSession, path: str, encoding: str = "utf-8", record_path: str | None = None, limit: int | None = None, columns=None) -> Frame:
    """A JSON document: an array of objects, an object that holds one, or one object."""
    began = time.monotonic()
    raw = spark.read.option("wholetext", True).text(path)
    text = F.ltrim(F.regexp_replace("value", "^﻿", ""))
    array = bool(raw.where(text.startswith("[")).limit(1).count())
    df = spark.read.option("multiLine", True).option("encoding", encoding).option("primitivesAsString", False).json(path)
    if array and df.columns == ["_corrupt_record"]:  # an array of scalars
        df = raw.select(F.explode(F.from_json(text, "array<string>")).alias("value"))
    if not array or record_path:
        df = _records(df, record_path)
    return _finished(df, path, "json", began, [], limit, columns)


def read_jsonl(spark: SparkSession, path: str, encoding: str = "utf-8", limit: int | None = None, columns=None, skip_invalid: bool = False) -> Frame:
    """One JSON object a line; a bad line raises, or is left out with ``skip_invalid``."""
    began = time.monotonic()
    df = spark.read.option("encoding", encoding).option("mode", "DROPMALFORMED" if skip_invalid else "FAILFAST").json(path)
    return _finished(df, path, "jsonl", began, [], limit, columns)


def read_parquet(spark: SparkSession, path: str, limit: int | None = None, columns=None) -> Frame:
    """Parquet, only the columns asked for."""
    began = time.monotonic()
    df = spark.read.parquet(path)
    return _finished(_chosen(df, columns), path, "parquet", began, [], limit, None)


def read_excel(spark: SparkSession, path: str, sheet: str | int | None = None, has_header: bool = True, limit: int | None = None, columns=None, coerce: bool = False) -> Frame:
    """A worksheet's stored values, read from the workbook's own XML. A workbook holds at most 1,048,576 rows."""
    began = time.monotonic()
    content = spark.read.format("binaryFile").load(path).select("content").head()["content"]
    if bytes(content[:4]) == BINARY_WORKBOOK:
        raise ValueError(f"{path}: a workbook in the old binary format; save it as .xlsx")
    rows = [r for r in _sheet(bytes(content), sheet) if any(v is not None for v in r)]
    width = max(map(len, rows), default=0)
    rows = [[*r, *[None] * (width - len(r))] for r in rows]
    names = unique_names([str(v or "") for v in rows.pop(0)]) if has_header and rows else [f"column_{i}" for i in range(1, width + 1)]
    kinds = []
    for i in range(len(names)):
        seen = {type(r[i]) for r in rows if r[i] is not None}
        kinds.append("double" if seen and seen <= {int, float} else "boolean" if seen == {bool} else "string")
    data = [tuple(None if v is None else float(v) if k == "double" else v if k == "boolean" else str(v) for v, k in zip(r, kinds)) for r in rows]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)) + f", {ORDER} long")
    return _finished(df, path, "excel", began, [], limit, columns, coerce and "string" in kinds)


#: How workbooks of the old binary format begin (fixed by the format).
BINARY_WORKBOOK = b"\xd0\xcf\x11\xe0"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _sheet(content: bytes, sheet: str | int | None) -> list[list]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), links[s.get(f"{{{_NS['r']}}}id")]) for s in book.findall("m:sheets/m:sheet", _NS)]
        if isinstance(sheet, str) and sheet not in dict(sheets):
            raise ValueError(f"no sheet named {sheet}")
        view = book.find("m:bookViews/m:workbookView", _NS)
        active = int(view.get("activeTab", 0)) if view is not None else 0
        target = dict(sheets)[sheet] if isinstance(sheet, str) else sheets[active if sheet is None else sheet][1]
        texts = []
        if "xl/sharedStrings.xml" in z.namelist():
            texts = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        body = ElementTree.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/")))
    out = []
    for row in body.findall("m:sheetData/m:row", _NS):
        cells: list = []
        for c in row.findall("m:c", _NS):
            ref = "".join(ch for ch in c.get("r", "") if ch.isalpha())
            at = 0
            for ch in ref:
                at = at * 26 + ord(ch) - 64
            cells += [None] * (max(at - 1, len(cells)) - len(cells))
            v, kind = c.find("m:v", _NS), c.get("t")
            if kind == "inlineStr":
                cells.append("".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")))
            elif v is None or v.text is None:
                cells.append(None)
            elif kind == "s":
                cells.append(texts[int(v.text)])
            elif kind == "b":
                cells.append(v.text == "1")
            elif kind in ("str", "e"):
                cells.append(v.text)
            else:
                x = float(v.text)
                cells.append(int(x) if x.is_integer() else x)
        out.append(cells)
    return out


# JDBC address and driver of each engine.
ENGINES = {
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver", 5432),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver", 3306),
    "sqlite": ("jdbc:sqlite:{database}", "org.sqlite.JDBC", 0),
    "duckdb": ("jdbc:duckdb:{database}", "org.duckdb.DuckDBDriver", 0),
    "snowflake": ("jdbc:snowflake://{host}/?db={database}", "net.snowflake.client.jdbc.SnowflakeDriver", 443),
    "redshift": ("jdbc:redshift://{host}:{port}/{database}", "com.amazon.redshift.jdbc42.Driver", 5439),
    "bigquery": ("jdbc:bigquery://{host}:443;ProjectId={database}", "com.simba.googlebigquery.jdbc.Driver", 443),
}


def is_table_name(name: str) -> bool:
    """Whether a name is one to three plain identifiers (ASCII letters, digits, _ and $) between dots."""
    parts = name.split(".")
    return name.isascii() and 1 <= len(parts) <= 3 and all(p.replace("$", "_").isidentifier() and p[0] != "$" for p in parts)


def connector_options(db: str | None = None, connection: dict | None = None, configs: dict | None = None, settings: dict | None = None) -> dict[str, str]:
    """JDBC options of a connection given inline or named in ``configs``."""
    found = dict(connection or (configs or {}).get(db) or {})
    if not found:
        raise ValueError(f"no connection named {db}")
    engine = found.get("engine", db)
    if engine not in ENGINES:
        raise ValueError(f"unknown engine: {engine}")
    url, driver, port = ENGINES[engine]
    out = {"url": url.format(**{"host": "localhost", "port": port, "database": ""} | found), "driver": driver}
    out |= {k: str(found[k]) for k in ("user", "password") if k in found}
    return out | {k: str(v) for k, v in (settings or {}).items()}


def source_label(connection: dict, db: str | None = None) -> str:
    return f"{connection.get('engine', db)}://{connection.get('database', '')}"


def read_sql(spark: SparkSession, query: str, db: str | None = None, connection: dict | None = None, configs: dict | None = None, params: dict | None = None, settings: dict | None = None, limit: int | None = None, columns=None) -> Frame:
    """A query with bound parameters: on this session's tables, or on a database by JDBC."""
    began = time.monotonic()
    if db is None and connection is None:
        df, source = spark.sql(query, args=params) if params else spark.sql(query), "session"
    else:
        options = connector_options(db, connection, configs, settings)
        df, source = spark.read.format("jdbc").options(**options).option("query", query).load(), source_label(connection or configs[db], db)
    return _finished(df, source, "sql", began, [], limit, columns)


def read_table(spark: SparkSession, table: str, db: str | None = None, connection: dict | None = None, configs: dict | None = None, settings: dict | None = None, limit: int | None = None, columns=None) -> Frame:
    """A table or view, only the columns asked for; its name must be a plain identifier."""
    if not is_table_name(table):
        raise ValueError(f"not a table name: {table}")
    began = time.monotonic()
    if db is None and connection is None:
        df, source = spark.table(table), f"session.{table}"
    else:
        df = spark.read.format("jdbc").options(**connector_options(db, connection, configs, settings)).option("dbtable", table).load()
        source = f"{source_label(connection or configs[db], db)}/{table}"
    return _finished(_chosen(df, columns), source, "table", began, [], limit, None)


READERS = {"delimited": read_delimited, "json": read_json, "jsonl": read_jsonl, "parquet": read_parquet, "excel": read_excel, "sql": read_sql}


def accepted(fn, options: dict) -> dict:
    """The options that a function takes."""
    return {k: v for k, v in options.items() if k in inspect.signature(fn).parameters}


def read_dataset(spark: SparkSession, data_source: str | None = None, format: str | None = None, query: str | None = None, table: str | None = None, db: str | None = None, connection: dict | None = None, configs: dict | None = None, limit: int | None = None, columns=None, **options) -> Frame:
    """The reader that fits: a query, a table, or a file by its given or detected format. Options that it does not
    take are left out."""
    common = {"limit": limit, "columns": columns, **options}
    where = {"db": db, "connection": connection, "configs": configs}
    if query:
        return read_sql(spark, query, **where, **accepted(read_sql, common))
    if table or (db or connection) and data_source:
        return read_table(spark, table or data_source, **where, **accepted(read_table, common))
    if not data_source:
        raise ValueError("nothing to read")
    kind = {"csv": "delimited", "tsv": "delimited"}.get(format, format) or detect_format(spark, data_source)
    if kind not in READERS:
        raise ValueError(f"unknown format: {format}")
    return READERS[kind](spark, data_source, **accepted(READERS[kind], common))


def load_rows(spark: SparkSession, data) -> DataFrame:
    """A table from a Frame, DataFrame, path, rows, a mapping of columns, pandas data, or inline JSON or CSV text."""
    import json

    if isinstance(data, Frame):
        return data.df
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, str):
        text = data.strip()
        if text[:1] in "[{" and text:
            return load_rows(spark, json.loads(text))
        if "\n" in text:
            rows = list(csv.reader(io.StringIO(text), delimiter=sniffed_delimiter(text)))
            names = unique_names(rows[0])
            return load_rows(spark, [dict(zip(names, r)) for r in rows[1:] if r])
        return read_dataset(spark, data, coerce=False).df
    if isinstance(data, dict):
        for k in ("rows", "data", "records"):
            if isinstance(data.get(k), list):
                return load_rows(spark, data[k])
        length = max((len(v) for v in data.values()), default=0)
        return load_rows(spark, [{k: v[i] if i < len(v) else None for k, v in data.items()} for i in range(length)])
    if hasattr(data, "to_dict") and hasattr(data, "columns"):
        return _ordered(spark.createDataFrame(data))
    names = list(dict.fromkeys(k for r in data for k in r))
    from pyspark.sql import Row

    sample = [Row(**{n: r.get(n) for n in names}) for r in data]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(sample)], [*names, ORDER]) if sample else spark.createDataFrame([], f"{ORDER} long")
    return df
