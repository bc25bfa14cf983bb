"""Registered queries of the library's operators over whole tables, each with SQL that gives the same rows.

Doubles are rounded to six digits on both sides, integers are 64 bits wide. A small amount is added before rounding,
since means of cents often end in an exact half of the last digit, which two engines may round either way.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.values import ORDER
from quarry.operators import auto, categories, cleaning, dates, entities, missing, profile, rows, selection
from quarry.plans import registry
from quarry.sources import readers, sinks
from quarry.streaming import entities as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS, NUDGE = 6, 3.37e-8


def shown(df: DataFrame) -> DataFrame:
    """Columns as the comparison takes them."""
    out = []
    for f in df.drop(ORDER).schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") + F.lit(NUDGE), DIGITS)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int").cast("long")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shown(fn(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


# ---------------------------------------------------------------- pieces of SQL


def d(expr: str, name: str) -> str:
    return f"round(({expr})::DOUBLE + {NUDGE}, {DIGITS}) AS \"{name}\""


def i(expr: str, name: str) -> str:
    return f"({expr})::BIGINT AS \"{name}\""


def days(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0)"


EV = "event_id, user_id"
#: Events with holes: no value in every seventh row, no type in every eleventh.
HOLEY = "h AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)"


def holey(t) -> DataFrame:
    e = t("events")
    return e.select("event_id", "ts", "user_id", F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


W = "PARTITION BY user_id ORDER BY ts, event_id"


def rank_share(expr: str, partition: str = "") -> str:
    """Mean rank of ties over n - 1."""
    return f"((rank() OVER ({partition} ORDER BY {expr}) - 1 + (count(*) OVER ({partition + ' ,' if partition else 'PARTITION BY'} {expr}) - 1) / 2.0) / (count(*) OVER ({partition}) - 1))"


# ---------------------------------------------------------------- sources


@query("scan_parquet_projection", "SELECT p_partkey, p_brand FROM part")
def _(t):
    return readers.Frame(t("part")).select("p_partkey,p_brand").df


@query("sql_with_parameters", f"SELECT event_type, {i('count(*)', 'n')} FROM events WHERE value > 50 GROUP BY event_type")
def _(t):
    df = t("events")
    df.createOrReplaceTempView("quarry_events")
    return readers.read_sql(df.sparkSession, "SELECT event_type, count(*) AS n FROM quarry_events WHERE value > :least GROUP BY event_type", params={"least": 50}).df


@query("text_cells_coerced", f"SELECT event_id, {d('CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END', 'value')}, {i('user_id', 'user_id')}, event_type FROM events")
def _(t):
    text = t("events").select("event_id", F.when(F.col("event_id") % 7 == 0, " n/a ").otherwise(F.col("value").cast("string")).alias("value"), F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("user_id"), F.concat(F.col("event_type"), F.lit("  ")).alias("event_type"))
    return readers.coerced(text, ["value", "user_id", "event_type"])


@query("text_cells_with_leading_zeros", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '00' ELSE '' END || user_id AS code, (user_id / 4.0)::DOUBLE AS part, user_id::VARCHAR || 'e' AS odd FROM events")
def _(t):
    user = F.col("user_id").cast("string")
    text = t("events").select("event_id", F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("00")).otherwise(F.lit("")), user).alias("code"), (F.col("user_id") / 4).cast("string").alias("part"), F.concat(user, F.lit("e")).alias("odd"))
    return readers.coerced(text, ["code", "part", "odd"])


def _stored(df: DataFrame, name: str) -> str:
    """A path for files of a query's own, in the folder that driver and executors share."""
    context = df.sparkSession.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quarry-files-")
    return f"{folder}/files-{uuid.uuid4().hex}/{name}"


CUSTOMERS = "SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer"


def customers(t) -> DataFrame:
    return t("customer").select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))


@query("read_delimited", CUSTOMERS)
def _(t):
    df = customers(t)
    return readers.read_delimited(df.sparkSession, sinks.write_csv(df, _stored(df, "customers.csv"), ";")).df


@query("read_delimited_packed", "SELECT c_custkey, c_mktsegment FROM (" + CUSTOMERS + ")")
def _(t):
    df = customers(t)
    df.write.option("header", True).option("compression", "gzip").option("sep", "|").csv(path := _stored(df, "customers.psv"))
    return readers.read_delimited(df.sparkSession, path, columns=["c_custkey", "c_mktsegment"]).df


@query("read_json", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def _(t):
    df = t("nation").select("n_nationkey", "n_name")
    one = df.agg(F.to_json(F.struct(F.lit("nations").alias("title"), F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))).alias("value"))  # 25 rows
    one.coalesce(1).write.text(path := _stored(df, "nations.json"))
    return readers.read_json(df.sparkSession, path, record_path="rows").df


@query("read_jsonl", CUSTOMERS)
def _(t):
    df = customers(t)
    return readers.read_jsonl(df.sparkSession, sinks.write_data(df, _stored(df, "customers.jsonl"))).df


@query("read_parquet", "SELECT c_name, c_acctbal FROM customer")
def _(t):
    df = customers(t)
    return readers.read_parquet(df.sparkSession, sinks.write_data(df, _stored(df, "customers.parquet")), columns="c_name,c_acctbal").df


@query("read_table", "SELECT c_custkey, c_acctbal FROM customer")
def _(t):
    df = customers(t)
    df.createOrReplaceTempView("quarry_customers")
    return readers.read_table(df.sparkSession, "quarry_customers", columns=["c_custkey", "c_acctbal"]).df


@query("read_dataset", CUSTOMERS)
def _(t):
    df = customers(t)
    return readers.read_dataset(df.sparkSession, sinks.write_data(df, _stored(df, "customers.ndjson.parquet")), sheet="not taken").df


@query("load_rows_of_a_folder", "SELECT c_custkey::VARCHAR AS c_custkey, c_name FROM customer")
def _(t):
    df = customers(t).select("c_custkey", "c_name")
    return readers.load_rows(df.sparkSession, sinks.write_csv(df, _stored(df, "customers.tsv"), "\t"))


# ---------------------------------------------------------------- dates

PART_SQL = {
    "year": "year(ts)",
    "quarter": "quarter(ts)",
    "month": "month(ts)",
    "week": "week(ts)",
    "day": "day(ts)",
    "dayofweek": "isodow(ts) - 1",
    "dayofyear": "dayofyear(ts)",
    "hour": "hour(ts)",
    "minute": "minute(ts)",
    "is_weekend": "(isodow(ts) >= 6)::INT",
    "is_month_start": "(day(ts) = 1)::INT",
    "is_month_end": "(day(ts) = day(last_day(ts)))::INT",
    "is_quarter_start": "(day(ts) = 1 AND month(ts) % 3 = 1)::INT",
    "is_quarter_end": "(day(ts) = day(last_day(ts)) AND month(ts) % 3 = 0)::INT",
    "days_in_month": "day(last_day(ts))",
    "week_of_month": "(day(ts) - 1) // 7 + 1",
    "days_to_month_end": "day(last_day(ts)) - day(ts)",
    "season": "(month(ts) % 12) // 3",
    "minute_of_day": "hour(ts) * 60 + minute(ts)",
    "part_of_day": "hour(ts) // 6",
    "is_business_hour": "(isodow(ts) <= 5 AND hour(ts) >= 9 AND hour(ts) < 18)::INT",
}


@query("date_parts", "SELECT event_id, " + ", ".join(i(PART_SQL[p], f"ts_{p}") for p in dates.DATE_PARTS) + " FROM events")
def _(t):
    return dates.date_parts(t("events").select("event_id", "ts"), ["ts"])[0].drop("ts")


def _cycles() -> str:
    out = []
    for p, n in dates.CYCLES:
        angle = f"2 * pi() * ({PART_SQL[p]}) / {n}"
        out += [d(f"sin({angle})", f"ts_{p}_sin"), d(f"cos({angle})", f"ts_{p}_cos")]
    return ", ".join(out)


@query("cyclical_dates", f"SELECT event_id, {_cycles()} FROM events")
def _(t):
    return dates.cyclical_dates(t("events").select("event_id", "ts"), ["ts"])[0].drop("ts")


LATEST = "(SELECT max(ts) FROM events)"


@query("recency", f"SELECT event_id, {d(days(LATEST, 'ts'), 'ts_days_since')}, {d(days(LATEST, 'ts') + ' / 7', 'ts_weeks_since')}, {d(days(LATEST, 'ts') + ' / 30.44', 'ts_months_since')} FROM events")
def _(t):
    return dates.recency(t("events").select("event_id", "ts"), ["ts"])[0].drop("ts")


@query("date_differences", f"SELECT event_id, {d(days('ts + to_hours(event_id % 50)', 'ts'), 'ts_to_later_days')} FROM events")
def _(t):
    e = t("events").select("event_id", "ts", F.expr("ts + make_interval(0, 0, 0, 0, cast(event_id % 50 as int))").alias("later"))
    return dates.date_differences(e, ["ts", "later"])[0].drop("ts", "later")


@query("auto_calendar", "SELECT event_id, " + ", ".join(i(PART_SQL[p], f"ts__{p}") for p in (*auto.CALENDAR, *auto.CLOCK)) + " FROM events")
def _(t):
    return auto.auto_calendar(t("events").select("event_id", "ts"), ["ts"])[0].drop("ts")


FIRST = "(SELECT min(ts) FROM events)"


@query("auto_relative_time", f"SELECT event_id, {d(days('ts', FIRST), 'ts__days_since_first')}, {d(days(LATEST, 'ts'), 'ts__days_until_last')}, {d(days('ts', FIRST) + ' / ' + days(LATEST, FIRST), 'ts__span_position')}, {d(rank_share('ts'), 'ts__chronological_rank')} FROM events")
def _(t):
    return auto.auto_relative_time(t("events").select("event_id", "ts"), ["ts"])[0].drop("ts")


# ---------------------------------------------------------------- rows


@query(
    "math_transformations",
    "SELECT c_custkey, "
    + ", ".join(d(e, f"c_acctbal_{o}") for o, e in {"log1p": "CASE WHEN c_acctbal > -1 THEN ln(1 + c_acctbal) END", "sqrt": "CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END", "square": "c_acctbal * c_acctbal", "cube_root": "cbrt(c_acctbal)", "reciprocal": "1.0 / nullif(c_acctbal, 0)", "abs": "abs(c_acctbal)", "sign": "sign(c_acctbal)"}.items())
    + " FROM customer",
)
def _(t):
    return rows.math_transformations(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], ("log1p", "sqrt", "square", "cube_root", "reciprocal", "abs", "sign"))[0].drop("c_acctbal")


@query("exp_decay", f"SELECT event_id, {d('exp(-value)', 'value_exp_decay')} FROM events")
def _(t):
    return rows.math_transformations(t("events").select("event_id", "value"), ["value"], ["exp_decay"])[0].drop("value")


A = "c_acctbal"
SCALED = f"""SELECT c_custkey, {d(f'({A} - avg({A}) OVER ()) / stddev_samp({A}) OVER ()', f'{A}_zscore')}, {d(f'({A} - min({A}) OVER ()) / (max({A}) OVER () - min({A}) OVER ())', f'{A}_minmax')},
{d(f'({A} - quantile_cont({A}, 0.5) OVER ()) / (quantile_cont({A}, 0.75) OVER () - quantile_cont({A}, 0.25) OVER ())', f'{A}_robust')}, {d(rank_share(A), f'{A}_rank')} FROM customer"""


@query("scaling", SCALED)
def _(t):
    df = t("customer").select("c_custkey", A)
    for m in ("zscore", "minmax", "robust", "rank"):
        df, _ = rows.scaling(df, [A], m)
    return df.drop(A)


def below(x: str, edges: list[str]) -> str:
    return " + ".join(f"({x} > {e})::INT" for e in edges)


@query("binning_quantile", f"SELECT c_custkey, {i(below(A, [f'quantile_cont({A}, {q}) OVER ()' for q in (0.25, 0.5, 0.75)]), A + '_bin')} FROM customer")
def _(t):
    return rows.binning(t("customer").select("c_custkey", A), [A])[0].drop(A)


@query("binning_uniform", f"SELECT c_custkey, {i(below(A, [f'(min({A}) OVER () + (max({A}) OVER () - min({A}) OVER ()) * {k} / 5)' for k in (1, 2, 3, 4)]), A + '_bin')} FROM customer")
def _(t):
    return rows.binning(t("customer").select("c_custkey", A), [A], 5, "uniform")[0].drop(A)


@query("winsorized_outliers", f"SELECT c_custkey, {d(f'least(greatest({A}, quantile_cont({A}, 0.01) OVER ()), quantile_cont({A}, 0.99) OVER ())', A + '_winsorized')}, {i(f'({A} < quantile_cont({A}, 0.01) OVER () OR {A} > quantile_cont({A}, 0.99) OVER ())', A + '_is_outlier')} FROM customer")
def _(t):
    return rows.outliers(t("customer").select("c_custkey", A), [A])[0].drop(A)


@query("ratios", f"SELECT p_partkey, {d('p_size / nullif(p_retailprice, 0)', 'p_size_per_p_retailprice')}, {d('p_retailprice / nullif(p_size, 0)', 'p_retailprice_per_p_size')} FROM part")
def _(t):
    return rows.ratios(t("part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])[0].drop("p_size", "p_retailprice")


@query("interactions", f"SELECT p_partkey, {d('p_size * p_retailprice', 'p_size_prod_p_retailprice')}, {d('p_size - p_retailprice', 'p_size_diff_p_retailprice')}, {d('p_size + p_retailprice', 'p_size_sum_p_retailprice')} FROM part")
def _(t):
    return rows.interactions(t("part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], ("product", "difference", "sum"))[0].drop("p_size", "p_retailprice")


L = "[l_quantity, l_discount * 100, l_tax * 100]"


@query("row_statistics", f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {d(f'list_sum({L})', 'row_total')}, {d(f'list_avg({L})', 'row_mean')}, {d(f'list_max({L})', 'row_max')}, {d(f'list_min({L})', 'row_min')}, {d(f'list_stddev_samp({L})', 'row_std')}, {i(f'len(list_filter({L}, lambda x: x != 0))', 'row_nonzero_count')} FROM lineitem")
def _(t):
    x = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") * 100).alias("a"), (F.col("l_tax") * 100).alias("b"))
    return rows.row_statistics(x, ["l_quantity", "a", "b"])[0].drop("l_quantity", "a", "b")


@query(
    "cleaning_transform",
    f"""SELECT c_custkey, {d(f'CASE WHEN {A} > 0 THEN ln({A}) END', f'{A}_log')}, {d(f'({A} - avg({A}) OVER ()) / stddev_pop({A}) OVER ()', f'{A}_zscore')},
{d(f'({A} - min({A}) OVER ()) / (max({A}) OVER () - min({A}) OVER ())', 'scaled')}, {d(below(A, [f'quantile_cont({A}, {q}) OVER ()' for q in (0.25, 0.5, 0.75)]), f'{A}_bucket')} FROM customer""",
)
def _(t):
    return cleaning.transform(t("customer").select("c_custkey", A), [{"column": A, "operation": "log"}, {"column": A, "operation": "zscore"}, {"column": A, "operation": "minmax", "as": "scaled"}, {"column": A, "operation": "bucket"}])[0].drop(A)


# ---------------------------------------------------------------- entities

U = "OVER (PARTITION BY user_id)"


@query(
    "group_aggregates",
    f"""WITH g AS (SELECT user_id, count(*) AS c, sum(value) AS s, avg(value) AS m, quantile_cont(value, 0.5) AS md, min(value) AS mi, max(value) AS ma, stddev_samp(value) AS sd, var_samp(value) AS v, count(DISTINCT event_type) AS nu,
arg_min(value, event_id) AS f, arg_max(value, event_id) AS l FROM events GROUP BY user_id)
SELECT event_id, {i('c', 'row_count_by_user_id')}, {d('s', 'value_sum_by_user_id')}, {d('m', 'value_mean_by_user_id')}, {d('md', 'value_median_by_user_id')}, {d('mi', 'value_min_by_user_id')}, {d('ma', 'value_max_by_user_id')}, {d('CASE WHEN c = 1 THEN 0 ELSE sd END', 'value_std_by_user_id')},
{d('CASE WHEN c = 1 THEN 0 ELSE v END', 'value_var_by_user_id')}, {d('ma - mi', 'value_range_by_user_id')}, {d('f', 'value_first_by_user_id')}, {d('l', 'value_last_by_user_id')}, {i('nu', 'event_type_nunique_by_user_id')} FROM events JOIN g USING (user_id)""",
)
def _(t):
    e = t("events").select("event_id", "user_id", "value", "event_type")
    e, _ = entities.group_aggregates(e, ["user_id"], ["value"], ("sum", "mean", "median", "min", "max", "std", "var", "range", "first", "last"), order=["event_id"])
    return entities.group_aggregates(e.drop("row_count_by_user_id"), ["user_id"], ["event_type"], ("nunique",), order=["event_id"])[0].drop("user_id", "value", "event_type")


@query("group_relative", f"SELECT event_id, {d(f'value / nullif(avg(value) {U}, 0)', 'value_ratio_to_user_id_mean')}, {d(f'value - avg(value) {U}', 'value_minus_user_id_mean')}, {d(f'(value - avg(value) {U}) / nullif(stddev_samp(value) {U}, 0)', 'value_zscore_in_user_id')}, {d(f'value / nullif(sum(value) {U}, 0)', 'value_share_of_user_id_sum')} FROM events")
def _(t):
    return entities.group_relative(t("events").select("event_id", "user_id", "value"), ["user_id"], ["value"])[0].drop("user_id", "value")


def _lag(k: int) -> str:
    p = f"lag(value, {k}) OVER ({W})"
    return f"{d(p, f'value_lag_{k}')}, {d(f'value - {p}', f'value_diff_{k}')}, {d(f'(value - {p}) / nullif({p}, 0)', f'value_pct_change_{k}')}"


@query("lags", f"SELECT event_id, {_lag(1)}, {_lag(3)} FROM events")
def _(t):
    return entities.lags(t("events").select("event_id", "ts", "user_id", "value"), ["user_id"], ["ts"], ["value"], (1, 3), order=["event_id"])[0].drop("ts", "user_id", "value")


def _rolled(w: int) -> str:
    o = f"OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '{w * 86400 * 1000000 - 1} microseconds' PRECEDING AND CURRENT ROW)"
    return f"{i(f'count(*) {o}', f'events_last_{w}d')}, {d(f'coalesce(sum(value) {o}, 0)', f'value_sum_last_{w}d')}, {d(f'avg(value) {o}', f'value_mean_last_{w}d')}"


@query("rolling_windows", f"WITH {HOLEY} SELECT event_id, {_rolled(1)}, {_rolled(7)} FROM h")
def _(t):
    return entities.rolling_windows(holey(t), ["user_id"], ["ts"], ["value"], (1, 7), order=["event_id"])[0].drop("ts", "user_id", "value", "event_type")


TIES = "k AS (SELECT o_orderkey, o_custkey, date_trunc('month', o_orderdate) AS m, o_totalprice AS x FROM orders)"


@query(
    "rolling_windows_with_ties",
    f"""WITH {TIES} SELECT a.o_orderkey, {i('count(*)', 'events_last_90d')}, {d('sum(b.x)', 'x_sum_last_90d')}, {d('avg(b.x)', 'x_mean_last_90d')} FROM k a JOIN k b ON a.o_custkey = b.o_custkey AND b.m > a.m - INTERVAL 90 DAY
AND (b.m < a.m OR (b.m = a.m AND b.o_orderkey <= a.o_orderkey)) GROUP BY a.o_orderkey""",
)
def _(t):
    k = t("orders").select("o_orderkey", "o_custkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("m"), F.col("o_totalprice").alias("x"))
    return entities.rolling_windows(k, ["o_custkey"], ["m"], ["x"], (90,), order=["o_orderkey"])[0].drop("o_custkey", "m", "x")


C = f"OVER ({W} ROWS UNBOUNDED PRECEDING)"


@query("cumulative", f"WITH {HOLEY} SELECT event_id, {i(f'count(*) {C}', 'event_number')}, {d(f'coalesce(sum(value) {C}, 0)', 'value_cumsum')}, {d(f'avg(value) {C}', 'value_cummean')}, {d(f'max(value) {C}', 'value_cummax')} FROM h")
def _(t):
    return entities.cumulative(holey(t), ["user_id"], ["ts"], ["value"], order=["event_id"])[0].drop("ts", "user_id", "value", "event_type")


GAP = days("ts", f"lag(ts) OVER ({W})")
MEAN_GAP = f"(CASE WHEN count(*) {U} > 1 THEN {days(f'max(ts) {U}', f'min(ts) {U}')} / (count(*) {U} - 1) END)"


@query("event_gaps", f"SELECT event_id, {d(GAP, 'days_since_previous_event')}, {d(days('ts', f'min(ts) {U}'), 'days_since_first_event')}, {d(MEAN_GAP, 'mean_event_gap_days')}, {d(f'{GAP} / nullif({MEAN_GAP}, 0)', 'event_gap_ratio')} FROM events")
def _(t):
    return entities.event_gaps(t("events").select("event_id", "ts", "user_id"), ["user_id"], ["ts"], order=["event_id"])[0].drop("ts", "user_id")


X = days("ts", "TIMESTAMP '2024-01-01'")


@query("trend", f"WITH g AS (SELECT user_id, regr_slope(value, {X}) AS s FROM events GROUP BY user_id) SELECT event_id, {d('s', 'value_trend_by_user_id')} FROM events JOIN g USING (user_id)")
def _(t):
    return entities.trend(t("events").select("event_id", "ts", "user_id", "value"), ["user_id"], ["ts"], ["value"])[0].drop("ts", "user_id", "value")


ENTITY = f"""g AS (SELECT user_id::VARCHAR AS user_id, count(*) AS event_count, sum(value) AS value_sum, avg(value) AS value_mean, quantile_cont(value, 0.5) AS value_median, min(value) AS value_min, max(value) AS value_max,
CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(value) END AS value_std, arg_max(value, event_id) AS value_last, regr_slope(value, {X}) AS value_trend, min(ts) AS a, max(ts) AS z, {days('max(ts)', 'min(ts)')} AS ts_span_days,
{days(LATEST, 'max(ts)')} AS ts_recency_days, count(DISTINCT ts::DATE) AS ts_active_days, CASE WHEN count(*) > 1 THEN {days('max(ts)', 'min(ts)')} / (count(*) - 1) END AS ts_mean_gap_days,
count(*) FILTER (ts > {LATEST} - INTERVAL 7 DAY) AS events_last_7d, coalesce(sum(value) FILTER (ts > {LATEST} - INTERVAL 7 DAY), 0) AS value_sum_last_7d FROM events GROUP BY user_id)"""
ENTITY_OUT = ", ".join(["user_id", i("event_count", "event_count"), i("event_count", "value_count"), *(d(f"value_{f}", f"value_{f}") for f in ("sum", "mean", "median", "min", "max", "std", "last", "trend")), *(d(f"ts_{f}", f"ts_{f}") for f in ("span_days", "recency_days", "mean_gap_days")), i("ts_active_days", "ts_active_days"), i("events_last_7d", "events_last_7d"), d("value_sum_last_7d", "value_sum_last_7d")])


@query("entity_table", f"WITH {ENTITY} SELECT {ENTITY_OUT} FROM g")
def _(t):
    return entities.entity_table(t("events"), ["user_id"], ["ts"], ["value"], windows=(7,), order=["event_id"])[0].drop("ts_first", "ts_last")


def score(expr: str, reverse: bool = False) -> str:
    s = rank_share(expr)
    return f"least(5, floor(({'1 - ' + s if reverse else s}) * 5) + 1)"


RFM = f"""r AS (SELECT user_id::VARCHAR AS user_id, {days(LATEST, 'max(ts)')} AS recency_days, count(*) AS frequency, sum(value) AS monetary_sum, avg(value) AS monetary_mean, max(value) AS monetary_max FROM events GROUP BY user_id),
s AS (SELECT *, {score('recency_days', True)}::BIGINT AS r_score, {score('frequency')}::BIGINT AS f_score, {score('monetary_sum')}::BIGINT AS m_score FROM r)"""
RFM_OUT = f"""{d('recency_days', 'recency_days')}, {i('frequency', 'frequency')}, {d('monetary_sum', 'monetary_sum')}, {d('monetary_mean', 'monetary_mean')}, {d('monetary_max', 'monetary_max')}, r_score, f_score, m_score,
r_score::VARCHAR || f_score::VARCHAR || m_score::VARCHAR AS rfm_score, CASE WHEN r_score >= 4 AND f_score >= 4 THEN 'champion' WHEN f_score >= 4 THEN 'at_risk' WHEN r_score >= 4 THEN 'new_or_promising' WHEN r_score <= 2 AND f_score <= 2 THEN 'lost' ELSE 'needs_attention' END AS rfm_segment"""


@query("rfm", f"WITH {RFM} SELECT user_id, {RFM_OUT} FROM s")
def _(t):
    return entities.rfm(t("events"), ["user_id"], ["ts"], ["value"])[0]


@query("generic_entity_features", f"WITH {ENTITY}, {RFM} SELECT {ENTITY_OUT}, {RFM_OUT}, {d('event_count / nullif(ts_span_days, 0)', 'events_per_day')}, {d('event_count / nullif(ts_active_days, 0)', 'events_per_active_day')}, {d('value_sum / nullif(ts_span_days, 0)', 'value_per_day')}, {d('value_sum / nullif(event_count, 0)', 'value_per_event')} FROM g JOIN s USING (user_id)")
def _(t):
    return entities.generic_entity_features(t("events"), ["user_id"], ["ts"], ["value"], windows=(7,), order=["event_id"])[0].drop("ts_first", "ts_last")


def _generic_numeric(c: str) -> str:
    q = lambda p: f"quantile_cont({c}, {p}) OVER ()"
    return ", ".join([d(f"CASE WHEN {c} > -1 THEN ln(1 + {c}) END", f"{c}_log1p"), d(f"CASE WHEN {c} >= 0 THEN sqrt({c}) END", f"{c}_sqrt"), d(f"{c} * {c}", f"{c}_square"), d(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()", f"{c}_zscore"), i(below(c, [q(0.25), q(0.5), q(0.75)]), f"{c}_bin"), d(f"least(greatest({c}, {q(0.01)}), {q(0.99)})", f"{c}_winsorized"), i(f"({c} < {q(0.01)} OR {c} > {q(0.99)})", f"{c}_is_outlier")])


B = "[p_size, p_retailprice]"
GENERIC_NUMERIC = f"""WITH s AS (SELECT p_partkey, p_name, p_brand, p_type, p_size::DOUBLE AS p_size, p_retailprice FROM part)
SELECT p_partkey, p_name, p_brand, p_type, {i('p_size', 'p_size')}, {d('p_retailprice', 'p_retailprice')}, {_generic_numeric('p_size')}, {_generic_numeric('p_retailprice')},
{d('p_size / nullif(p_retailprice, 0)', 'p_size_per_p_retailprice')}, {d('p_retailprice / nullif(p_size, 0)', 'p_retailprice_per_p_size')}, {d('p_size * p_retailprice', 'p_size_prod_p_retailprice')}, {d('p_size - p_retailprice', 'p_size_diff_p_retailprice')},
{d(f'list_sum({B})', 'row_total')}, {d(f'list_avg({B})', 'row_mean')}, {d(f'list_max({B})', 'row_max')}, {d(f'list_min({B})', 'row_min')}, {d(f'list_stddev_samp({B})', 'row_std')}, {i(f'len(list_filter({B}, lambda x: x != 0))', 'row_nonzero_count')} FROM s"""


@query("generic_numeric_features", GENERIC_NUMERIC)
def _(t):
    return registry.generic_numeric_features(t("part"), ["p_size", "p_retailprice"])[0]


# ---------------------------------------------------------------- categories


@query("frequency_encoding", f"WITH {HOLEY} SELECT event_id, {i('count(*) OVER (PARTITION BY event_type)', 'event_type_frequency')}, {d('count(*) OVER (PARTITION BY event_type) / (count(*) OVER ())::DOUBLE', 'event_type_frequency_ratio')} FROM h")
def _(t):
    return categories.frequency_encoding(holey(t), ["event_type"])[0].select("event_id", "event_type_frequency", "event_type_frequency_ratio")


@query("one_hot_encoding", f"SELECT c_custkey, {', '.join(i(f'c_mktsegment = {s!r}', f'c_mktsegment_is_{s.lower()}') for s in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))} FROM customer")
def _(t):
    return categories.one_hot_encoding(t("customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])[0].drop("c_mktsegment")


@query("ordinal_encoding", f"WITH {HOLEY}, o AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS k FROM h WHERE event_type IS NOT NULL GROUP BY event_type) SELECT event_id, {i('k', 'event_type_ordinal')} FROM h LEFT JOIN o USING (event_type)")
def _(t):
    return categories.ordinal_encoding(holey(t), ["event_type"])[0].select("event_id", "event_type_ordinal")


@query("rare_category_grouping", "WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) SELECT p_partkey, CASE WHEN n < greatest(1, floor(0.04 * (SELECT count(*) FROM part))) THEN 'other' ELSE p_brand END AS p_brand_grouped FROM part JOIN n USING (p_brand)")
def _(t):
    return categories.rare_category_grouping(t("part").select("p_partkey", "p_brand"), ["p_brand"], 0.04)[0].drop("p_brand")


@query("missing_indicators", f"WITH {HOLEY} SELECT event_id, {i('event_type IS NULL', 'event_type_is_missing')}, {i('value IS NULL', 'value_is_missing')}, {i('(event_type IS NULL)::INT + (value IS NULL)::INT', 'row_missing_count')} FROM h")
def _(t):
    return categories.missing_indicators(holey(t))[0].select("event_id", "event_type_is_missing", "value_is_missing", "row_missing_count")


def _joined(key: str, *parts: tuple[str, tuple[str, ...]]) -> str:
    """SQL of some columns of registered queries side by side, row by row of ``key``; over events without holes."""
    whole = "h AS (SELECT event_id, ts, user_id, event_type, value FROM events)"
    froms = " JOIN ".join(f"({ORACLE_SQL[name].replace(HOLEY, whole)}) t{i}" + (f" USING ({key})" if i else "") for i, (name, _) in enumerate(parts))
    return f"SELECT {key}, " + ", ".join(f't{i}."{c}"' for i, (_, columns) in enumerate(parts) for c in columns) + f" FROM {froms}"


OF_USER = tuple(f"value_{f}_by_user_id" for f in ("mean", "sum", "max", "std"))
GENERIC_ROW = _joined(
    "event_id",
    ("date_parts", tuple(f"ts_{p}" for p in dates.DATE_PARTS)),
    ("cyclical_dates", tuple(f"ts_{p}_{f}" for p, _ in dates.CYCLES for f in ("sin", "cos"))),
    ("recency", tuple(f"ts_{u}_since" for u in ("days", "weeks", "months"))),
    ("group_aggregates", ("row_count_by_user_id", *OF_USER)),
    ("group_relative", ("value_minus_user_id_mean", "value_ratio_to_user_id_mean", "value_share_of_user_id_sum", "value_zscore_in_user_id")),
    ("lags", ("value_lag_1", "value_diff_1", "value_pct_change_1")),
    ("cumulative", ("event_number", "value_cumsum", "value_cummax", "value_cummean")),
    ("event_gaps", ("days_since_first_event", "days_since_previous_event", "event_gap_ratio", "mean_event_gap_days")),
    ("frequency_encoding", ("event_type_frequency", "event_type_frequency_ratio")),
)
GENERIC_ROW = f"""SELECT g.*, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {i('user_id', 'user_id')}, event_type, {d('value', 'value')}, {i('0', 'row_missing_count')}
FROM ({GENERIC_ROW}) g JOIN events USING (event_id)"""


@query("generic_row_features", GENERIC_ROW)
def _(t):
    return registry.generic_row_features(t("events").select("event_id", "ts", "user_id", "event_type", "value"), ["user_id"], ["ts"], ["value"], ["event_type"], order=["event_id"])[0]


# ---------------------------------------------------------------- auto


@query("auto_boolean_flags", f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {i('l_quantity > 25', 'b__flag')} FROM lineitem")
def _(t):
    b = t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 25, "Yes").otherwise("no").alias("b"))
    return auto.auto_boolean_flags(b, ["b"])[0].drop("b")


@query(
    "auto_numeric_shape",
    "SELECT c_custkey, "
    + ", ".join(
        i(e, f"c_acctbal__{k}")
        for k, e in {
            "sign": f"sign({A})",
            "is_zero": f"{A} = 0",
            "is_negative": f"{A} < 0",
            "is_whole": f"{A} = floor({A})",
            "decimal_places": f"length(rtrim(split_part(printf('%.10f', {A}), '.', 2), '0'))",
            "integer_digits": f"length(printf('%.0f', floor(abs({A}))))",
            "first_digit": f"left(printf('%.6e', abs({A})), 1)",
            "magnitude": f"CASE WHEN {A} <> 0 THEN floor(log10(abs({A}))) END",
            "is_round": f"{A} = floor({A}) AND {A} % 10 = 0",
        }.items()
    )
    + " FROM customer",
)
def _(t):
    return auto.auto_numeric_shape(t("customer").select("c_custkey", A), [A])[0].drop(A)


Q = {k: f"quantile_cont({A}, {q}) OVER ()" for k, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))}


@query(
    "auto_column_statistics",
    f"""WITH a AS (SELECT c_custkey, {A}, avg({A}) OVER () AS m, stddev_pop({A}) OVER () AS s, {Q['q1']} AS q1, {Q['q2']} AS q2, {Q['q3']} AS q3, {rank_share(A)} AS p FROM customer), b AS (SELECT *, quantile_cont(abs({A} - q2), 0.5) OVER () AS mad FROM a)
SELECT c_custkey, {d(f'{A} - m', f'{A}__minus_mean')}, {d(f'{A} - q2', f'{A}__minus_median')}, {d(f'{A} / q2', f'{A}__over_median')}, {d(f'({A} - m) / s', f'{A}__zscore')}, {d(f'0.6745 * ({A} - q2) / mad', f'{A}__mad_zscore')}, {d('p', f'{A}__percentile')},
{d(f'({A} - q1) / (q3 - q1)', f'{A}__iqr_position')}, {i(f'{A} > q2', f'{A}__above_median')}, {i(f'{A} < q1 - 1.5 * (q3 - q1) OR {A} > q3 + 1.5 * (q3 - q1)', f'{A}__is_outlier')} FROM b""",
)
def _(t):
    return auto.auto_column_statistics(t("customer").select("c_custkey", A), [A])[0].drop(A)


def count_of(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


P = "p_brand"
SHAPES = {"length": f"length({P})", "word_count": count_of(P, r"\S+"), "digit_count": count_of(P, "[0-9]"), "letter_count": count_of(P, "[A-Za-z]"), "upper_count": count_of(P, "[A-Z]"), "punctuation_count": count_of(P, r"[^A-Za-z0-9\s]"), "whitespace_count": count_of(P, r"\s"), "starts_with_digit": f"regexp_matches({P}, '^[0-9]')", "is_upper": f"{count_of(P, '[A-Z]')} > 0 AND {count_of(P, '[a-z]')} = 0"}


@query("auto_text_shape", "SELECT p_partkey, " + ", ".join(i(e, f"{P}__{k}") for k, e in SHAPES.items()) + " FROM part")
def _(t):
    return auto.auto_text_shape(t("part").select("p_partkey", P), [P])[0].drop(P)


@query(
    "auto_text_composition",
    "SELECT p_partkey, "
    + ", ".join(d(e, f"{P}__{k}") for k, e in {"digit_ratio": f"{count_of(P, '[0-9]')} / length({P})", "letter_ratio": f"{count_of(P, '[A-Za-z]')} / length({P})", "upper_ratio": f"{count_of(P, '[A-Z]')} / nullif({count_of(P, '[A-Za-z]')}, 0)", "symbol_ratio": f"{count_of(P, '[^A-Za-z0-9 ]')} / length({P})", "unique_char_ratio": f"len(list_distinct(string_split({P}, ''))) / length({P})", "entropy": f"list_entropy(string_split({P}, ''))"}.items())
    + rf", regexp_replace(regexp_replace(regexp_replace({P}, '[0-9]+', '9', 'g'), '[a-z]+', 'a', 'g'), '[A-Z]+', 'A', 'g') AS {P}__shape FROM part",
)
def _(t):
    return auto.auto_text_composition(t("part").select("p_partkey", P), [P])[0].drop(P)


@query("text_shape_of_scripts", r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_brand || '-日本-ÉÉé-' || p_size, '[0-9]+', '9', 'g'), '[A-ZÉ]+', 'A', 'g'), '[a-zé]+', 'a', 'g') AS shape FROM part")
def _(t):
    return t("part").select("p_partkey", auto.shape_of(F.concat("p_brand", F.lit("-日本-ÉÉé-"), F.col("p_size").cast("string"))).alias("shape"))


MAIL = "CASE WHEN event_id % 3 = 0 THEN 'user' || user_id || '@Mail.example.org' WHEN event_id % 3 = 1 THEN 'https://www.site' || user_id || '.example.com/x?y=1' ELSE event_type END"


@query("auto_text_patterns", f"SELECT event_id, {i('event_id % 3 = 0', 's__is_email')}, {i('event_id % 3 = 1', 's__is_url')}, CASE WHEN event_id % 3 = 0 THEN 'mail.example.org' WHEN event_id % 3 = 1 THEN 'site' || user_id || '.example.com' END AS s__domain FROM (SELECT *, {MAIL} AS s FROM events)")
def _(t):
    return auto.auto_text_patterns(t("events").select("event_id", F.expr(MAIL).alias("s")), ["s"])[0].drop("s")


@query(
    "auto_category_profile",
    f"""WITH g AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS k FROM part GROUP BY p_brand), a AS (SELECT *, n / (SELECT count(*) FROM part)::DOUBLE AS s FROM g)
SELECT p_partkey, {i('n', f'{P}__frequency')}, {d('s', f'{P}__frequency_ratio')}, {i('k', f'{P}__rarity_rank')}, {i('s < 0.01', f'{P}__is_rare')}, {i('k = 0', f'{P}__is_mode')}, {d('-log2(s)', f'{P}__self_information')} FROM part JOIN a USING (p_brand)""",
)
def _(t):
    return auto.auto_category_profile(t("part").select("p_partkey", P), [P])[0].drop(P)


@query(
    "auto_row_profile",
    f"""WITH {HOLEY}, a AS (SELECT event_id, user_id, event_type, (event_type IS NULL)::INT AS m FROM h) SELECT event_id, {i('m', 'row__missing_count')}, {d('m / 2.0', 'row__missing_ratio')}, {i('2 - m', 'row__filled_count')}, {i('1', 'row__numeric_count')}, {i('user_id = 0', 'row__zero_count')},
{i('user_id < 0', 'row__negative_count')}, {i("length(user_id::VARCHAR) + length(coalesce(event_type, ''))", 'row__text_length')}, {i('2 - m', 'row__distinct_values')} FROM a""",
)
def _(t):
    return auto.auto_row_profile(holey(t), ["user_id", "event_type"])[0].drop("ts", "user_id", "event_type", "value")


@query("auto_all")
def _(t):
    return auto.auto_all(t("part"))[0]


# ---------------------------------------------------------------- missing values


@query("missing_counts", f"WITH {HOLEY} SELECT 'event_type' AS \"column\", {i('count(*) - count(event_type)', 'n_missing')} FROM h UNION ALL SELECT 'value', (count(*) - count(value))::BIGINT FROM h")
def _(t):
    return missing.missing_counts(holey(t))


@query("missing_patterns", f"WITH {HOLEY} SELECT concat_ws(',', CASE WHEN event_type IS NULL THEN 'event_type' END, CASE WHEN value IS NULL THEN 'value' END) AS pattern, {i('count(*)', 'n_rows')} FROM h WHERE event_type IS NULL OR value IS NULL GROUP BY 1 ORDER BY 2 DESC LIMIT 3")
def _(t):
    return missing.missing_patterns(holey(t))


@query(
    "missing_profile",
    f"""WITH {HOLEY}, a AS (SELECT count(*) AS n, count(*) FILTER (event_type IS NOT NULL AND value IS NOT NULL) AS k FROM h) """
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {i(f'count(*) - count({c})', 'n_missing')}, {i(f'count(DISTINCT {c})', 'n_distinct')}, {i('any_value(n)', 'n_rows')}, {i('any_value(k)', 'n_complete')}, {d(f'(count(*) - count({c})) / count(*)', 'missing_rate')} FROM h, a" for c in ("event_type", "value")),
)
def _(t):
    return missing.missing_profile(holey(t), ["event_type", "value"])


@query(
    "missingness_evidence",
    f"""WITH {HOLEY}, s AS (SELECT CASE WHEN value > 20 THEN NULL ELSE event_type END AS c, value AS x, user_id AS u FROM events), r AS (SELECT 'x' AS related_to, (avg(x) FILTER (c IS NULL) - avg(x) FILTER (c IS NOT NULL)) / stddev_pop(x) AS g,
count(*) FILTER (c IS NULL) AS n1, count(*) FILTER (c IS NOT NULL) AS n0 FROM s UNION ALL SELECT 'u', (avg(u) FILTER (c IS NULL) - avg(u) FILTER (c IS NOT NULL)) / stddev_pop(u), count(*) FILTER (c IS NULL), count(*) FILTER (c IS NOT NULL) FROM s)
SELECT related_to, {d('g', 'related_gap')} FROM r WHERE abs(g) >= greatest(0.2, 2 * sqrt(1.0 / n1 + 1.0 / n0))""",
)
def _(t):
    s = t("events").select(F.when(F.col("value") <= 20, F.col("event_type")).alias("c"), F.col("value").alias("x"), F.col("user_id").alias("u"))
    return missing.missingness_evidence(s, "c")


def filled_sql(value: str, extra: str = "", source: str = "h") -> str:
    return f"WITH {HOLEY}{extra} SELECT event_id, {d(value, 'value')}, {i('(SELECT count(*) FROM h z WHERE z.event_id = a.event_id AND z.value IS NULL)' if source != 'h' else 'a.value IS NULL', 'value_is_missing')} FROM {source} a"


for _stat, _expr in (("median", "quantile_cont(value, 0.5)"), ("mean", "avg(value)"), ("min", "min(value)"), ("max", "max(value)"), ("zero", "any_value(0)")):

    @query(f"impute_statistic_{_stat}", filled_sql(f"coalesce(a.value, (SELECT {_expr} FROM h))"))
    def _(t, _stat=_stat):
        return missing.impute_statistic(holey(t), ["value"], _stat)[0].select("event_id", "value", "value_is_missing")


@query("impute_statistic_mode", f"WITH {HOLEY} SELECT event_id, coalesce(event_type, (SELECT event_type FROM h WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, min(event_id) LIMIT 1)) AS event_type FROM h")
def _(t):
    return missing.impute_statistic(holey(t), ["event_type"], "mode", order=["event_id"])[0].select("event_id", "event_type")


@query("impute_plan", f"WITH {HOLEY} SELECT event_id, {d('coalesce(value, 1.5)', 'value')}, coalesce(event_type, 'none seen') AS event_type FROM h")
def _(t):
    return missing.impute_plan(holey(t), {"value": 1.5, "event_type": "none seen"}, indicators=False)[0].select("event_id", "value", "event_type")


@query("impute_group", filled_sql("coalesce(a.value, quantile_cont(a.value, 0.5) OVER (PARTITION BY a.user_id), (SELECT quantile_cont(value, 0.5) FROM h))"))
def _(t):
    return missing.impute_group(holey(t), ["value"], ["user_id"])[0].select("event_id", "value", "value_is_missing")


AHEAD, BACK = f"OVER ({W} ROWS UNBOUNDED PRECEDING)", f"OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("impute_forward", f"WITH {HOLEY} SELECT event_id, {d(f'last_value(value IGNORE NULLS) {AHEAD}', 'value')} FROM h")
def _(t):
    return missing.impute_forward(holey(t), ["value"], ["user_id"], ["ts"], order=["event_id"])[0].select("event_id", "value")


@query("impute_backward", f"WITH {HOLEY} SELECT event_id, {d(f'first_value(value IGNORE NULLS) {BACK}', 'value')} FROM h")
def _(t):
    return missing.impute_forward(holey(t), ["value"], ["user_id"], ["ts"], "backward", order=["event_id"])[0].select("event_id", "value")


@query("impute_both_ways", f"WITH {HOLEY} SELECT event_id, {d(f'coalesce(last_value(value IGNORE NULLS) {AHEAD}, first_value(value IGNORE NULLS) {BACK})', 'value')} FROM h")
def _(t):
    return missing.impute_forward(holey(t), ["value"], ["user_id"], ["ts"], "both", order=["event_id"])[0].select("event_id", "value")


SPARSE = "q AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)"


@query(
    "impute_forward_limited",
    f"WITH {SPARSE}, r AS (SELECT *, last_value(value IGNORE NULLS) {AHEAD} AS v, last_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) {AHEAD} AS vp FROM q) SELECT event_id, {d('CASE WHEN p - vp <= 2 THEN v END', 'value')} FROM r",
)
def _(t):
    sparse = t("events").select("event_id", "ts", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"))
    return missing.impute_forward(sparse, ["value"], ["user_id"], ["ts"], limit=2, order=["event_id"])[0].select("event_id", "value")


@query(
    "impute_interpolate",
    f"""WITH {HOLEY}, r AS (SELECT *, last_value(value IGNORE NULLS) {AHEAD} AS v0, last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) {AHEAD} AS t0, first_value(value IGNORE NULLS) {BACK} AS v1, first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) {BACK} AS t1 FROM h)
SELECT event_id, {d('coalesce(value, v0 + (v1 - v0) * (epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0)))', 'value')} FROM r""",
)
def _(t):
    return missing.impute_interpolate(holey(t), ["value"], ["user_id"], ["ts"], order=["event_id"])[0].select("event_id", "value")


@query("impute_category", f"WITH {HOLEY} SELECT event_id, coalesce(event_type, 'missing') AS event_type FROM h")
def _(t):
    return missing.impute_category(holey(t), ["event_type"])[0].select("event_id", "event_type")


@query("impute_knn")
def _(t):
    part = t("part").withColumn("p_retailprice", F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice")))
    return missing.impute_knn(part, ["p_retailprice"], ["p_size", "p_partkey"], order=["p_partkey"])[0].select("p_partkey", "p_retailprice")


@query("impute_regression")
def _(t):
    part = t("part").withColumn("p_retailprice", F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice")))
    return missing.impute_regression(part, ["p_retailprice"], ["p_size", "p_partkey"])[0].select("p_partkey", "p_retailprice")


@query("impute_random_sample")
def _(t):
    return missing.impute_random_sample(holey(t), ["value"], 7, order=["event_id"])[0].select("event_id", "value")


@query("impute_auto", f"WITH {HOLEY}, f AS (SELECT event_id, coalesce(event_type, 'missing') AS event_type, last_value(value IGNORE NULLS) {AHEAD} AS value FROM h) SELECT event_id, event_type, {d('coalesce(value, (SELECT quantile_cont(value, 0.5) FROM f))', 'value')} FROM f")
def _(t):
    return missing.impute_auto(holey(t), ["event_type", "value"], ["user_id"], ["ts"], order=["event_id"])[0].select("event_id", "event_type", "value")


# ---------------------------------------------------------------- cleaning

ODD = "o AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '  ' || event_type || chr(9) WHEN event_id % 5 = 1 THEN ' N/A ' ELSE event_type END AS kind FROM events)"


def odd(t) -> DataFrame:
    e = t("events")
    return e.select("event_id", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("  "), F.col("event_type"), F.lit("\t"))).when(F.col("event_id") % 5 == 1, " N/A ").otherwise(F.col("event_type")).alias("kind"))


@query("normalize_columns", "SELECT r_regionkey::BIGINT AS region_key, r_name AS column_1st_name, r_name AS region_key_2 FROM region")
def _(t):
    r = t("region").select(F.col("r_regionkey").alias(" Region Key"), F.col("r_name").alias("1st-Name"), F.col("r_name").alias("region.key"))
    return cleaning.normalize_columns(r)[0]


@query("strip_whitespace", f"WITH {ODD}, e AS (SELECT event_id AS k, event_type FROM events) SELECT event_id, CASE WHEN event_id % 5 = 1 THEN NULL ELSE event_type END AS kind FROM o JOIN e ON k = event_id")
def _(t):
    return cleaning.strip_whitespace(odd(t))[0]


@query("coerce_types_inferred", f"SELECT event_id, {i('user_id', 'user_id')}, {d('value', 'value')}, {i('value > 10', 'big')}, event_type FROM events")
def _(t):
    e = t("events").select("event_id", F.col("user_id").cast("string").alias("user_id"), F.col("value").cast("string").alias("value"), (F.col("value") > 10).cast("string").alias("big"), "event_type")
    return cleaning.coerce_types(e)[0]


@query("coerce_types_schema", f"SELECT event_id, {i('CASE WHEN event_id % 2 = 0 THEN trunc(value) END', 'a')}, {i('event_id % 2 = 1', 'b')} FROM events")
def _(t):
    e = t("events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).otherwise("x").alias("a"), F.when(F.col("event_id") % 2 == 1, "Yes").otherwise("n").alias("b"))
    return cleaning.coerce_types(e, {"a": "int", "b": "bool"})[0]


@query("drop_duplicates_first", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def _(t):
    return cleaning.drop_duplicates(t("events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], order=["event_id"])[0]


@query("drop_duplicates_last", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def _(t):
    return cleaning.drop_duplicates(t("events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "last", ["event_id"])[0]


@query("drop_missing_rows_any", f"WITH {HOLEY} SELECT event_id FROM h WHERE value IS NOT NULL AND event_type IS NOT NULL")
def _(t):
    return cleaning.drop_missing_rows(holey(t))[0].select("event_id")


@query("drop_missing_rows_all", f"WITH {HOLEY} SELECT event_id FROM h WHERE value IS NOT NULL OR event_type IS NOT NULL")
def _(t):
    return cleaning.drop_missing_rows(holey(t), ["value", "event_type"], "all")[0].select("event_id")


@query("fill_missing_auto", f"WITH {HOLEY} SELECT event_id, {d('coalesce(value, (SELECT quantile_cont(value, 0.5) FROM h))', 'value')}, coalesce(event_type, (SELECT event_type FROM h WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, min(event_id) LIMIT 1)) AS event_type FROM h")
def _(t):
    return cleaning.fill_missing(holey(t), columns=["value", "event_type"], order=["event_id"])[0].select("event_id", "value", "event_type")


@query("drop_missing_columns", "SELECT event_id, event_type FROM events")
def _(t):
    e = t("events").select("event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"))
    return cleaning.drop_missing_columns(e)[0]


@query("drop_constant_columns", "SELECT event_id, event_type FROM events")
def _(t):
    e = t("events").select("event_id", "event_type", F.lit("x").alias("same"), F.lit(None).cast("string").alias("nothing"))
    return cleaning.drop_constant_columns(e)[0]


@query("drop_columns", "SELECT event_id FROM events")
def _(t):
    return cleaning.drop_columns(t("events").select("event_id", "event_type"), ["event_type", "not there"])[0]


FENCE = "(quantile_cont(value, 0.25) OVER () - 1.5 * (quantile_cont(value, 0.75) OVER () - quantile_cont(value, 0.25) OVER ()))", "(quantile_cont(value, 0.75) OVER () + 1.5 * (quantile_cont(value, 0.75) OVER () - quantile_cont(value, 0.25) OVER ()))"


@query("clip_outliers_iqr", f"SELECT event_id, {d(f'least(greatest(value, {FENCE[0]}), {FENCE[1]})', 'value')} FROM events")
def _(t):
    return cleaning.clip_outliers(t("events").select("event_id", "value"), ["value"])[0]


@query("clip_outliers_drop_zscore", f"SELECT event_id, {d('value', 'value')} FROM (SELECT *, avg(value) OVER () AS m, stddev_pop(value) OVER () AS s FROM events) WHERE value BETWEEN m - 2 * s AND m + 2 * s")
def _(t):
    return cleaning.clip_outliers(t("events").select("event_id", "value"), ["value"], "zscore", 2, "drop")[0]


# ---------------------------------------------------------------- analyzers


def _described(table: str, c: str) -> str:
    m = f"(SELECT avg({c}) FROM {table})"
    skew = f"avg(({c} - {m}) ** 3) / nullif(stddev_pop({c}) ** 3, 0)"
    stats = {"mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "p25": f"quantile_cont({c}, 0.25)", "median": f"quantile_cont({c}, 0.5)", "p75": f"quantile_cont({c}, 0.75)", "max": f"max({c})", "sum": f"sum({c})", "skew": skew}
    return f"SELECT '{c}' AS \"column\", {i('count(*)', 'n_rows')}, {i(f'count(*) - count({c})', 'n_missing')}, {i(f'count(DISTINCT {c})', 'n_distinct')}, " + ", ".join(d(e, k) for k, e in stats.items()) + f", {i(f'count(*) FILTER ({c} = 0)', 'zeros')}, {i(f'count(*) FILTER ({c} < 0)', 'negatives')}, {d(f'(count(*) - count({c})) / count(*)', 'missing_rate')} FROM {table}"


@query("describe", f"{_described('customer', 'c_acctbal')} UNION ALL {_described('customer', 'c_nationkey')}")
def _(t):
    return profile.describe(t("customer"), ["c_acctbal", "c_nationkey"])


@query("column_kinds", "SELECT * FROM (VALUES ('event_id', 'numeric'), ('ts', 'date'), ('user_id', 'numeric'), ('event_type', 'categorical'), ('value', 'numeric'), ('props', 'categorical')) v(\"column\", kind)")
def _(t):
    e = t("events")
    return e.sparkSession.createDataFrame(list(profile.column_kinds(e).items()), "column string, kind string")


@query("category_profile", f"SELECT p_brand AS level, {i('count(*)', 'n')} FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 5")
def _(t):
    return profile.category_profile(t("part"), "p_brand")


@query("date_profile", f"SELECT 'ts' AS \"column\", strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS \"first\", strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS \"last\", {d(days('max(ts)', 'min(ts)'), 'span_days')}, {i('count(DISTINCT ts::DATE)', 'distinct_days')}, {i('0', 'unreadable')} FROM events")
def _(t):
    return profile.date_profile(t("events"), ["ts"])


@query("missing_values", f"WITH {HOLEY} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {i(f'count(*) - count({c})', 'n_missing')}, {i('count(*)', 'n_rows')}, {d(f'(count(*) - count({c})) / count(*)', 'missing_rate')}, {i(f'(count(*) - count({c})) / count(*) > 0.1', 'too_many')} FROM h" for c in ("event_id", "ts", "user_id", "event_type", "value")))
def _(t):
    return profile.missing_values(holey(t), 0.1)[0]


@query("duplicates", " UNION ALL ".join(f"SELECT '{k}' AS key, {i('sum(n)', 'n_rows')}, {i('count(*)', 'n_distinct')}, {i('count(*) FILTER (n > 1)', 'n_duplicated')}, {i('max(n)', 'max_repeats')}, {i('sum(n) - count(*)', 'n_repeated')} FROM (SELECT count(*) AS n FROM events GROUP BY {g})" for k, g in (("rows", "user_id, event_type"), ("user_id", "user_id"))))
def _(t):
    return profile.duplicates(t("events"), ["user_id", "event_type"], ["user_id"])


@query("outlier_report", f"WITH b AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS z FROM events), c AS (SELECT a - 1.5 * (z - a) AS lo, z + 1.5 * (z - a) AS hi FROM b) SELECT 'value' AS \"column\", {d('any_value(lo)', 'lower')}, {d('any_value(hi)', 'upper')}, {i('count(*)', 'n')}, {i('count(*) FILTER (value < lo)', 'n_below')}, {i('count(*) FILTER (value > hi)', 'n_above')}, {d('count(*) FILTER (value < lo OR value > hi) / count(*)', 'rate')} FROM events, c")
def _(t):
    return profile.outliers(t("events"), ["value"])


M = "(SELECT avg(value) FROM events)"


@query("distributions", f"SELECT 'value' AS \"column\", {i('count(*)', 'n')}, {i('count(DISTINCT value)', 'distinct')}, 'continuous' AS shape, {d(f'avg((value - {M}) ** 3) / stddev_pop(value) ** 3', 'skew')}, {d(f'avg((value - {M}) ** 4) / stddev_pop(value) ** 4 - 3', 'kurtosis')}, {i('0', 'zeros')}, {i('0', 'negatives')}, 'log1p' AS suggested_transform, {i('1', 'is_skewed')} FROM events")
def _(t):
    return profile.distributions(t("events"), ["value"])


@query("histogram", f"WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 10 AS w FROM events), r AS (SELECT unnest(range(10)) AS k), g AS (SELECT least(floor((value - lo) / w), 9) AS k, count(*) AS n FROM events, b GROUP BY 1) SELECT {i('r.k', 'bin')}, {d('lo + r.k * w', 'lower')}, {d('lo + r.k * w + w', 'upper')}, {i('coalesce(n, 0)', 'n')} FROM r CROSS JOIN b LEFT JOIN g ON g.k = r.k")
def _(t):
    return profile.histogram(t("events"), "value")


NUMS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
PAIRS = [(a, b) for k, a in enumerate(NUMS) for b in NUMS[k + 1 :]]


@query("correlations_pearson", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {d(f'corr({a}, {b})', 'r')}, {i(f'abs(corr({a}, {b})) >= 0.95', 'redundant')} FROM lineitem" for a, b in PAIRS))
def _(t):
    return profile.correlations(t("lineitem"), list(NUMS))


@query("correlations_spearman", f"WITH r AS (SELECT {rank_share('p_size')} AS x, {rank_share('p_retailprice')} AS y FROM part) SELECT 'p_size' AS a, 'p_retailprice' AS b, {d('corr(x, y)', 'r')}, {i('abs(corr(x, y)) >= 0.95', 'redundant')} FROM r")
def _(t):
    return profile.correlations(t("part"), ["p_size", "p_retailprice"], "spearman")


def _eta(table: str, x: str, g: str) -> str:
    return f"(SELECT sqrt(sum(n * (m - a) ** 2) / any_value(t)) FROM (SELECT count(*) AS n, avg({x}) AS m FROM {table} GROUP BY {g}), (SELECT avg({x}) AS a, count(*) * var_pop({x}) AS t FROM {table}))"


@query("correlation_ratio", f"SELECT {d(_eta('lineitem', 'l_quantity', 'l_returnflag'), 'eta')}")
def _(t):
    return profile.correlation_ratio(t("lineitem"), F.col("l_quantity"), F.col("l_returnflag"))


@query("target_summary", f"SELECT 'p_size' AS \"column\", 'correlation_ratio' AS method, {d(_eta('part', 'p_size', 'p_type'), 'association')}, 0::BIGINT AS leaking UNION ALL SELECT 'p_retailprice', 'correlation_ratio', {d(_eta('part', 'p_retailprice', 'p_type'), 'association')}, 0::BIGINT")
def _(t):
    return profile.target_summary(t("part").select("p_size", "p_retailprice", "p_type"), "p_type")


@query("target_balance", f"SELECT l_returnflag AS level, {i('count(*)', 'n')}, {d('count(*) / (SELECT count(*) FROM lineitem)', 'share')} FROM lineitem GROUP BY l_returnflag")
def _(t):
    return profile.target_balance(t("lineitem"), "l_returnflag")


AFTER = "count(*) FILTER (ts > TIMESTAMP '2024-01-15')"


@query("timeline", f"WITH g AS (SELECT max({days('ts', 'p')}) AS gap FROM (SELECT ts, lag(ts) OVER (ORDER BY ts) AS p FROM events)) SELECT 'ts' AS \"column\", strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS \"first\", strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS \"last\", {d(days('max(ts)', 'min(ts)'), 'span_days')}, {i('count(DISTINCT ts::DATE)', 'distinct_days')}, 0::BIGINT AS unparsed, {i(AFTER, 'after_reference')}, {d('any_value(gap)', 'largest_gap_days')} FROM events, g")
def _(t):
    return profile.timeline(t("events"), ["ts"], "2024-01-15 00:00:00")


@query("periods", f"SELECT strftime(o_orderdate, '%Y-%m') AS month, {i('count(*)', 'n')} FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
def _(t):
    return profile.periods(t("orders"), "o_orderdate")


@query("grain", f"WITH g AS (SELECT count(*) AS n, {days('max(ts)', 'min(ts)')} AS s FROM events GROUP BY user_id) SELECT {i('count(*)', 'entities')}, {i('sum(n)', 'n_rows')}, {i('count(*) FILTER (n > 1)', 'n_repeated')}, {d('avg(n)', 'mean_rows')}, {d('quantile_cont(n, 0.5)', 'median_rows')}, {i('max(n)', 'max_rows')}, {d('quantile_cont(s, 0.5)', 'median_span_days')}, 'event log' AS verdict FROM g")
def _(t):
    return profile.grain(t("events"), ["user_id"], ["ts"])


# ---------------------------------------------------------------- selection

#: Parts with a binary target: whether the size is over 25.
SEL = "s AS (SELECT p_retailprice AS price, p_brand AS brand, p_partkey % 10 AS digit, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS y FROM part)"


def target(t) -> DataFrame:
    return t("part").select(F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"), (F.col("p_partkey") % 10).alias("digit"), F.when(F.col("p_size") > 25, "big").otherwise("small").alias("y"))


def _label(c: str) -> str:
    edges = f"(SELECT list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) FROM s)"
    return f"'bin_' || len(list_filter({edges}, lambda e: {c} > e))" if c != "brand" else "brand"


def _mi(c: str) -> str:
    return f"""(WITH j AS (SELECT {_label(c)} AS a, y AS b, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM j)
SELECT greatest(sum(n / t * log2(n * t / (na * nb))), 0) / -sum(n / t * log2(nb / t)) FROM k)"""


def _v(c: str) -> str:
    return f"""(WITH j AS (SELECT {_label(c)} AS a, y AS b, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM j)
SELECT sqrt(greatest(any_value(t) * (sum(n * n / (na * nb)) - 1) / (any_value(t) * (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 0)) FROM k)"""


RARE = "(SELECT y FROM s GROUP BY y ORDER BY count(*), y LIMIT 1)"
Y = f"(y = {RARE})::INT"


def _iv(c: str) -> str:
    return f"(WITH g AS (SELECT {_label(c)} AS a, sum({Y}) AS n1, count(*) - sum({Y}) AS n0 FROM s GROUP BY ALL), w AS (SELECT sum(n1) AS t1, sum(n0) AS t0, count(*) AS k FROM g), p AS (SELECT (n1 + 0.5) / (t1 + 0.5 * k) AS p1, (n0 + 0.5) / (t0 + 0.5 * k) AS p0 FROM g, w) SELECT sum((p1 - p0) * ln(p1 / p0)) FROM p)"


def _auc(c: str) -> str:
    return f"(WITH r AS (SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r, {Y} AS y FROM s) SELECT 2 * abs((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) - 0.5) FROM r)"


def _f(c: str) -> str:
    return f"(WITH g AS (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM s GROUP BY y), w AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS a, sum(n * v) AS inside FROM g) SELECT sum(g.n * (m - a) ** 2) / (any_value(w.k) - 1) / (any_value(inside) / (any_value(w.n) - any_value(w.k))) FROM g, w)"


def _scores(fn, columns=("price", "brand", "digit")) -> str:
    none = [c for c in ("price", "brand", "digit") if c not in columns]
    return f"WITH {SEL} " + " UNION ALL ".join([f"SELECT '{c}' AS \"column\", {d(fn(c), 'score')}" for c in columns] + [f"SELECT '{c}' AS \"column\", NULL::DOUBLE AS score" for c in none])


for _name, _fn, _cols in (
    ("mutual_information", _mi, ("price", "brand", "digit")),
    ("cramers_v", _v, ("price", "brand", "digit")),
    ("information_value", _iv, ("price", "brand", "digit")),
    ("correlation", lambda c: f"(SELECT abs(corr({c}, {Y})) FROM s)", ("price", "digit")),
    ("spearman", lambda c: f"(SELECT abs(corr(r, z)) FROM (SELECT {rank_share(c)} AS r, {Y} AS z FROM s))", ("price", "digit")),
    ("auc", _auc, ("price", "digit")),
    ("anova_f", _f, ("price", "digit")),
    ("variance", lambda c: f"(SELECT var_pop({c}) FROM s)", ("price", "digit")),
):

    @query(f"rank_features_{_name}", _scores(_fn, _cols))
    def _(t, _name=_name):
        return selection.rank_features(target(t), "y", method=_name)


for _name, _options in (("random_forest", {"trees": 50, "max_depth": 8}), ("l1", {})):

    @query(f"rank_features_{_name}")
    def _(t, _name=_name, _options=_options):
        return selection.rank_features(target(t), "y", method=_name, **_options)


@query("screen_features", "SELECT * FROM (VALUES ('same', 'constant'), ('nothing', 'empty'), ('almost', 'quasi_constant'), ('holes', 'high_missing'), ('event_id', 'id_like'), ('ts', 'date_column'), ('copy', 'duplicate of user_id')) v(\"column\", reason)")
def _(t):
    e = t("events").select("event_id", "ts", "user_id", F.col("user_id").alias("copy"), F.lit(1).alias("same"), F.lit(None).cast("string").alias("nothing"), F.when(F.col("event_id") % 1000 == 0, "b").otherwise("a").alias("almost"), F.when(F.col("event_id") % 3 == 0, F.col("user_id") % 10 + 1000).alias("holes"), F.col("event_id").alias(ORDER))
    return selection.screen_features(e)


@query("leakage_suspects", "SELECT 'leak' AS \"column\", 1.0::DOUBLE AS score")
def _(t):
    return selection.leakage_suspects(target(t).withColumn("leak", F.upper("y")), "y", ["price", "leak"])


@query("redundant_pairs", "SELECT 'price' AS a, 'twice' AS b, 1.0::DOUBLE AS association UNION ALL SELECT 'brand', 'make', 1.0::DOUBLE")
def _(t):
    return selection.redundant_pairs(target(t).withColumns({"twice": F.col("price") * 2 + 1, "make": F.lower("brand")}), ["price", "twice", "brand", "make"])


@query("select_features")
def _(t):
    return selection.select_features(target(t).withColumns({"twice": F.col("price") * 2 + 1, "leak": F.upper("y")}), "y")


@query("rank_features_f_test", _scores(_f, ("price", "digit")))
def _(t):
    return selection.rank_features(target(t), "y", ["price", "digit"], "f_test").unionByName(t("part").sparkSession.createDataFrame([("brand", None)], "column string, score double"))


@query("rank_features_f_test_of_a_number", f"WITH {SEL}, r AS (SELECT corr(digit, price) ** 2 AS r, count(*) AS n FROM s) SELECT 'digit' AS \"column\", {d('r * (n - 2) / (1 - r)', 'score')} FROM r")
def _(t):
    return selection.rank_features(target(t), "price", ["digit"], "f_test", "regression")


@query("rank_features_rfe")
def _(t):
    return selection.rank_features(target(t), "y", ["price", "brand", "digit"], "rfe")


@query("rank_features_permutation")
def _(t):
    return selection.rank_features(target(t), "y", ["price", "digit"], "permutation", repeats=2, trees=20, max_depth=8)


# ---------------------------------------------------------------- plans and streams


def _listed(found: dict) -> list[tuple[str, str]]:
    return [(k, ",".join(v) if isinstance(v, list) else v) for k, v in found.items()]


def plain_events(t) -> DataFrame:
    return t("events").select("event_id", "ts", "user_id", "event_type", "value")


@query("column_roles", "SELECT * FROM (VALUES ('ids', 'event_id,user_id'), ('dates', 'ts'), ('aggregation', 'value'), ('categorical', 'event_type'), ('text', ''), ('constant', ''), ('empty', ''), ('target', NULL)) v(role, columns)")
def _(t):
    return t("events").sparkSession.createDataFrame(_listed(profile.column_roles(plain_events(t))), "role string, columns string")


@query("infer_columns", "SELECT * FROM (VALUES ('id_columns', 'event_id,user_id'), ('date_columns', 'ts'), ('aggregation_columns', 'value'), ('categorical_columns', 'event_type')) v(role, columns)")
def _(t):
    return t("events").sparkSession.createDataFrame(_listed(registry.infer_columns(plain_events(t))), "role string, columns string")


@query("prepare_pipeline", f"WITH {ODD}, e AS (SELECT event_id AS k, event_type FROM events) SELECT event_id, CASE WHEN event_id % 5 = 1 THEN 'unknown' ELSE event_type END AS kind FROM o JOIN e ON k = event_id")
def _(t):
    return registry.prepare(odd(t).withColumn("same", F.lit(1)), ["strip_whitespace", "drop_constant_columns", {"step": "fill_missing", "strategy": "constant", "value": "unknown", "columns": ["kind"]}])[0]


@query("feature_steps_run", f"SELECT event_id, {i('hour(ts)', 'ts_hour')}, {i('count(*) OVER (PARTITION BY user_id)', 'row_count_by_user_id')}, {d('avg(value) OVER (PARTITION BY user_id)', 'value_mean_by_user_id')} FROM events")
def _(t):
    e = t("events").select("event_id", "ts", "user_id", "value")
    df, _ = registry.run_steps(e, ["date_parts", "group_aggregates", "no_such_step"], {"id_columns": ["user_id"], "date_columns": ["ts"], "aggregation_columns": ["value"]}, {"date_parts": {"parts": ["hour"]}, "group_aggregates": {"functions": ["mean"]}})
    return df.drop("ts", "user_id", "value")


@query("windowed_totals", f"SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, user_id::VARCHAR AS user_id, {i('count(*)', 'events')}, {d('sum(value)', 'value_sum')} FROM events GROUP BY ALL")
def _(t):
    return stream.windowed_totals(t("events"), ["user_id"], "ts", ["value"], "1 day", "1 day")
