"""Named steps in order: feature preparation, cleaning, analysis; what each did; a recorder that replays a run."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.values import ORDER, key, missing, names_of, one_row
from quarry.operators import auto, categories, cleaning, dates, entities, profile, rows, selection
from quarry.operators import missing as holes
from quarry.sources import readers, sinks


def generic_row_features(df, id_columns=(), date_columns=(), aggregation_columns=(), categorical_columns=(), order=None):
    """Twelve row-level steps in one."""
    a = {"id_columns": id_columns, "date_columns": date_columns, "aggregation_columns": aggregation_columns}
    steps = [
        lambda d: categories.missing_indicators(d),
        lambda d: dates.date_parts(d, date_columns),
        lambda d: dates.cyclical_dates(d, date_columns),
        lambda d: dates.recency(d, date_columns),
        lambda d: dates.date_differences(d, date_columns),
        lambda d: entities.group_aggregates(d, id_columns, aggregation_columns, order=order),
        lambda d: entities.group_relative(d, id_columns, aggregation_columns),
        lambda d: entities.lags(d, **a, order=order),
        lambda d: entities.cumulative(d, **a, order=order),
        lambda d: entities.event_gaps(d, id_columns, date_columns, order=order),
        lambda d: categories.frequency_encoding(d, categorical_columns),
        lambda d: rows.row_statistics(d, aggregation_columns),
    ]
    return entities.composed(df, steps)


def generic_numeric_features(df, columns=(), max_features: int = 12):
    """Seven numeric steps in one."""
    steps = [lambda d: rows.math_transformations(d, columns), lambda d: rows.scaling(d, columns), lambda d: rows.binning(d, columns), lambda d: rows.outliers(d, columns), lambda d: rows.ratios(d, columns, max_features), lambda d: rows.interactions(d, columns, max_features=max_features), lambda d: rows.row_statistics(d, columns)]
    return entities.composed(df, steps)


# Fixed names: steps, and those that run by default, in order.
FEATURE_STEPS: dict[str, Callable] = {
    "date_parts": dates.date_parts,
    "cyclical_dates": dates.cyclical_dates,
    "recency": dates.recency,
    "date_differences": dates.date_differences,
    "group_aggregates": entities.group_aggregates,
    "group_relative": entities.group_relative,
    "lags": entities.lags,
    "rolling_windows": entities.rolling_windows,
    "cumulative": entities.cumulative,
    "event_gaps": entities.event_gaps,
    "trend": entities.trend,
    "math_transformations": rows.math_transformations,
    "scaling": rows.scaling,
    "binning": rows.binning,
    "outliers": rows.outliers,
    "ratios": rows.ratios,
    "interactions": rows.interactions,
    "row_statistics": rows.row_statistics,
    "frequency_encoding": categories.frequency_encoding,
    "one_hot_encoding": categories.one_hot_encoding,
    "ordinal_encoding": categories.ordinal_encoding,
    "rare_category_grouping": categories.rare_category_grouping,
    "missing_indicators": categories.missing_indicators,
    "entity_table": entities.entity_table,
    "rfm": entities.rfm,
    "generic_row_features": generic_row_features,
    "generic_entity_features": entities.generic_entity_features,
    "generic_numeric_features": generic_numeric_features,
} | auto.AUTO_STEPS | holes.IMPUTE_STEPS
RESHAPING = ("entity_table", "rfm", "generic_entity_features")
DEFAULT_FEATURE_STEPS = ("missing_indicators", "date_parts", "recency", "group_aggregates", "group_relative", "event_gaps", "frequency_encoding", "row_statistics")


def register_step(name: str, fn: Callable) -> None:
    """Adds a step of one's own: ``fn(df, ...) -> (df, names)``."""
    FEATURE_STEPS[name] = fn


def infer_columns(df: DataFrame, id_columns=None, date_columns=None, aggregation_columns=None) -> dict[str, list[str]]:
    """Ids (by name, else the category with the most rows a level, over 1.5), dates, and numbers to aggregate."""
    import re

    kinds = auto.column_kinds(df)
    ids = names_of(id_columns)
    if not ids:
        ids = [c for c in kinds if re.search(r"(^|_)(id|key|code|uuid)$", c, re.I) and kinds[c] != "empty"]
    if not ids:
        texts = [c for c in kinds if kinds[c] == "categorical"]
        if texts:
            n = df.count()
            many = one_row(df, *(F.count_distinct(F.when(~missing(df, c), key(df, c))).alias(c) for c in texts))
            repeats = max((n / many[c], c) for c in texts if many[c])
            ids = [repeats[1]] if repeats[0] > 1.5 else []
    return {"id_columns": ids, "date_columns": names_of(date_columns) or [c for c in kinds if kinds[c] == "date"], "aggregation_columns": names_of(aggregation_columns) or [c for c in kinds if kinds[c] == "numeric" and c not in ids], "categorical_columns": [c for c in kinds if kinds[c] in ("categorical", "boolean") and c not in ids]}


def run_steps(df: DataFrame, steps: Iterable[str], columns: dict, options: dict | None = None, reference_date=None) -> tuple[DataFrame, list[dict]]:
    """Steps in order; each gets the arguments it takes. An unknown or failing step is reported, not raised."""
    report = []
    options = options or {}
    for name in names_of(steps):
        fn = FEATURE_STEPS.get(name)
        if fn is None:
            report.append({"step": name, "status": "unknown", "added": []})
            continue
        given = columns | {"columns": columns.get("aggregation_columns", []), "reference_date": reference_date}
        given |= {k: v for k, v in options.items() if not isinstance(v, dict)} | options.get(name, {})
        try:
            out, added = fn(df, **readers.accepted(fn, {k: v for k, v in given.items() if v is not None}))
            out.schema  # the plan is analysed here; rows are computed when the result is used
        except Exception as e:  # noqa: BLE001
            report.append({"step": name, "status": "failed", "error": f"{type(e).__name__}: {e}"[:300], "added": []})
            continue
        report.append({"step": name, "status": "done", "added": added, "grain": "entity" if name in RESHAPING else "row"})
        df = out
    return df, report


def prepare(df: DataFrame, steps=None) -> tuple[DataFrame, list[dict]]:
    """Cleaning steps in order (names, or mappings with ``step`` and arguments); unknown ones raise."""
    log = []
    for s in steps or cleaning.DEFAULT_STEPS:
        given = {"step": s} if isinstance(s, str) else dict(s)
        name = given.pop("step", None) or given.pop("name")
        if name not in cleaning.STEPS:
            raise ValueError(f"unknown step: {name}")
        fn = cleaning.STEPS[name]
        df, did = fn(df, **readers.accepted(fn, given))
        log.append({"step": name, **did, "columns": len([c for c in df.columns if c != ORDER])})
    return df, log


def analyze(df: DataFrame, analyzers=None, **options) -> dict[str, object]:
    """Analyzers in order: small tables as rows; a failure becomes a finding."""
    out: dict[str, object] = {}
    for name in names_of(analyzers) or [a for a in profile.ANALYZERS if a != "target_summary" or options.get("target")]:
        fn = profile.ANALYZERS[name]
        try:
            found = fn(df, **readers.accepted(fn, options))
            parts = found if isinstance(found, tuple) else (found,)
            out[name] = [[r.asDict(recursive=True) for r in p.collect()] for p in parts] if len(parts) > 1 else [r.asDict(recursive=True) for r in parts[0].collect()]
        except Exception as e:  # noqa: BLE001
            out[name] = {"level": "warning", "error": f"{type(e).__name__}: {e}"[:300]}
    return out


def recipe(df: DataFrame, target: str | None = None) -> dict:
    """Cleaning and feature steps that the findings call for, each with its reason and options, and the columns' roles."""
    roles, kinds = profile.column_roles(df, target=target), profile.column_kinds(df)
    measured, dated, levelled = roles["aggregation"], roles["dates"], roles["categorical"]
    holes = {r["column"]: r for r in profile.missing_values(df)[0].collect() if r["n_missing"]}
    shapes = {r["column"]: r for r in profile.distributions(df, measured).collect()} if measured else {}
    skewed = [c for c in measured if c in shapes and shapes[c]["is_skewed"]]
    wild = [r["column"] for r in profile.outliers(df, measured).where("rate > 0 and rate <= 0.05").collect()] if measured else []
    grained = profile.grain(df, roles["ids"], dated).head().asDict()
    many = {r["column"]: r["n_distinct"] for r in profile.per_column(df, levelled, lambda c: {"n_distinct": F.approx_count_distinct(F.when(~missing(df, c), key(df, c)))}).collect()} if levelled else {}
    log = grained["verdict"] == "event log"

    def asked(*entries) -> list[dict]:
        return [{"step": step, "reason": reason, **(more[0] if more else {})} for wanted, step, reason, *more in entries if wanted]

    names = ", ".join
    untidy = [c for c in kinds if c != cleaning.tidy(c, True)]
    written = [c for c, k in kinds.items() if k in ("numeric", "date", "boolean") and isinstance(df.schema[c].dataType, T.StringType)]
    idle = roles["constant"] + roles["empty"]
    heavy = [c for c, r in holes.items() if r["missing_rate"] > 0.5 and c != target]
    clipped = [c for c in wild if c not in skewed]
    clean = asked(
        (untidy, "normalize_columns", f"names that are no feature names: {names(untidy)}"),
        (any(k in ("categorical", "text") for k in kinds.values()), "strip_whitespace", "padding would split levels of texts"),
        (written, "coerce_types", f"numbers or dates written as text: {names(written)}"),
        (profile.duplicates(df).where("key = 'rows'").head()["n_repeated"], "drop_duplicates", "rows repeat and would be counted twice"),
        (idle, "drop_constant_columns", f"no information: {names(idle)}"),
        (heavy, "drop_missing_columns", f"mostly missing: {names(heavy)}", {"max_missing_rate": 0.5}),
        (target in holes, "drop_missing_rows", f"rows without {target} teach nothing", {"columns": [target]}),
        (holes, "fill_missing", "holes remain", {"strategy": "auto"}),
        (clipped, "clip_outliers", f"a few extreme values: {names(clipped)}", {"columns": clipped, "method": "iqr"}),
    )
    windows = profile.windows_for(grained.get("median_span_days")) if log and dated else []
    wide = [c for c in levelled if many.get(c, 0) > 10]
    tails = any(abs(shapes[c]["skew"] or 0) >= profile.HEAVY for c in skewed)
    features = asked(
        (holes, "missing_indicators", "that a cell was empty can tell something"),
        (dated, "date_parts", "there are dates"),
        (dated, "recency", "how long ago a date is"),
        (len(dated) > 1, "date_differences", "there are several dates a row"),
        (log, "group_aggregates", "entities repeat"),
        (log, "group_relative", "a row against its entity's own history"),
        (log and dated, "event_gaps", "entities repeat in time"),
        (log and dated, "cumulative", "what an entity did up to a row"),
        (windows, "rolling_windows", "entities last long enough", {"windows": windows}),
        (log and dated, "trend", "where a measurement is heading"),
        (levelled, "frequency_encoding", "there are categories"),
        (wide, "rare_category_grouping", f"rare levels: {names(wide)}"),
        (wide, "ordinal_encoding", "too many levels for a column each"),
        (levelled and not wide, "one_hot_encoding", "few levels", {"max_categories": 10}),
        (skewed, "math_transformations", f"skewed: {names(skewed)}", {"operations": ["log1p"]}),
        (tails, "binning", "a heavy tail reads better in bands"),
        (len(measured) >= 3, "row_statistics", "several measurements a row"),
        (2 <= len(measured) <= 6, "ratios", "one measurement against another"),
    )
    return {"cleaning": clean, "features": features, "roles": roles, "level": "entity" if log else "row"}


def describe_step(name: str, steps: dict[str, Callable]) -> dict:
    """A step's documentation and arguments with their defaults."""
    fn = steps[name]
    args = {k: (list(p.default) if isinstance(p.default, tuple) else p.default) for k, p in inspect.signature(fn).parameters.items() if p.default is not inspect.Parameter.empty}
    return {"step": name, "doc": inspect.getdoc(fn) or "", "arguments": args, "grain": "entity" if name in RESHAPING else "row"}


def catalogue(kind: str, name: str | None = None) -> list[dict]:
    """What there is: ``features``, ``cleaning``, ``analyzers`` or ``selection``."""
    steps = {"features": FEATURE_STEPS, "cleaning": cleaning.STEPS, "analyzers": profile.ANALYZERS, "selection": {k: v[0] for k, v in selection.METHODS.items()} | selection.MODEL_METHODS}[kind]
    return [describe_step(n, steps) for n in ([name] if name else steps)]


# ---------------------------------------------------------------- facades


def _sample(df: DataFrame, limit: int, most: int = 60) -> list[dict]:
    columns = [c for c in df.columns if c != ORDER][:most]
    return [sinks.json_safe(r.asDict(recursive=True)) for r in df.select(*(f"`{c}`" for c in columns)).limit(limit).collect()]


def guarded(fn: Callable) -> Callable:
    """Errors as ``{"status": "error"}``."""

    def run(*args, **kwargs) -> dict:
        try:
            return {"status": "ok", **fn(*args, **kwargs)}
        except Exception as e:  # noqa: BLE001
            return {"status": "error", "error": f"{type(e).__name__}: {e}"}

    run.__name__, run.__doc__, run.__wrapped__ = fn.__name__, fn.__doc__, fn
    return run


@guarded
def data_reader(spark: SparkSession, data_source=None, limit: int | None = None, columns=None, **options) -> dict:
    """Reads, and returns the profile and ten rows."""
    frame = readers.read_dataset(spark, data_source, limit=limit, columns=columns, **options)
    return {**frame.profile(), "sample": sinks.json_safe(frame.head(10))}


@guarded
def data_prep(spark: SparkSession, data, steps=None, output_path: str | None = None) -> dict:
    """Reads, cleans, writes, and returns ten rows."""
    df, log = prepare(readers.load_rows(spark, data), steps)
    return {"log": log, "output_path": sinks.write_csv(df, output_path) if output_path else None, "sample": _sample(df, 10)}


@guarded
def analyzer(spark: SparkSession, data, analyzers=None, target: str | None = None, output_path: str | None = None, **options) -> dict:
    """Reads, analyzes, and returns findings and the recipe."""
    df = readers.load_rows(spark, data)
    report = {"findings": analyze(df, analyzers, target=target, **options), "recipe": recipe(df, target)}
    if output_path:
        sinks.write_report(report, output_path)
    return report


@guarded
def feature_prep(spark: SparkSession, data, id_columns=None, date_columns=None, aggregation_columns=None, steps=None, options=None, reference_date=None, output_path: str | None = None, limit: int = 3) -> dict:
    """Loads, infers roles, runs steps, writes, and returns a few rows."""
    df = readers.load_rows(spark, data)
    columns = infer_columns(df, id_columns, date_columns, aggregation_columns)
    df, report = run_steps(df, steps or DEFAULT_FEATURE_STEPS, columns, options, reference_date)
    return {"columns": columns, "report": report, "output_path": sinks.write_data(df, output_path) if output_path else None, "sample": _sample(df, limit)}


@guarded
def feature_generation(spark: SparkSession, data, level: str = "row", **arguments) -> dict:
    """All features of a level: row, entity, numeric or all."""
    steps = {"row": ["generic_row_features"], "entity": ["generic_entity_features"], "numeric": ["generic_numeric_features"], "all": ["generic_numeric_features", "generic_row_features"]}
    return feature_prep.__wrapped__(spark, data, steps=steps[level], **arguments)


@guarded
def missing_report(spark: SparkSession, data, columns=None, id_columns=None, date_columns=None, patterns: int = 3) -> dict:
    """Holes per column, patterns, and a plan to fill them."""
    df = readers.load_rows(spark, data)
    return {"profile": _sample(holes.missing_profile(df, columns or ()), 10_000), "patterns": _sample(holes.missing_patterns(df, columns or (), patterns), patterns), "plan": holes.suggest_imputations(df, columns or (), id_columns or (), date_columns or ())}


@guarded
def impute(spark: SparkSession, data, method: str = "auto", output_path: str | None = None, limit: int = 3, **options) -> dict:
    """Fills holes one way; counts before and after, and the fills that can be replayed on other rows."""
    df = readers.load_rows(spark, data)
    fn = holes.IMPUTE_STEPS[f"impute_{method}"]
    replay = holes.learn_fill_values(df, options.get("columns") or (), options.get("statistic", "median")) if method in ("statistic", "auto", "plan") else {}
    out, names = fn(df, **readers.accepted(fn, options))
    count = lambda d: {r["column"]: r["n_missing"] for r in holes.missing_counts(d, [c for c in df.columns if c != ORDER]).collect()}
    return {"filled": names, "before": count(df), "after": count(out), "fill_values": sinks.json_safe(replay), "output_path": sinks.write_data(out, output_path) if output_path else None, "sample": _sample(out, limit)}


@guarded
def feature_selection(spark: SparkSession, data, target: str, keep_columns=None, output_path: str | None = None, limit: int = 3, **options) -> dict:
    """Selects features; writes the kept, selected and target columns."""
    df = readers.load_rows(spark, data)
    found = [r.asDict() for r in selection.select_features(df, target, **options).collect()]
    chosen = df.select(*(f"`{c}`" for c in dict.fromkeys([*names_of(keep_columns), *(r["column"] for r in found if r["selected"]), target])))
    return {"features": found, "output_path": sinks.write_data(chosen, output_path) if output_path else None, "sample": _sample(chosen, limit)}


@guarded
def feature_screening(spark: SparkSession, data, features=None, **options) -> dict:
    """Usable and rejected columns."""
    df = readers.load_rows(spark, data)
    rejected = {r["column"]: r["reason"] for r in selection.screen_features(df, features, **options).collect()}
    return {"usable": [c for c in names_of(features) or df.columns if c not in rejected and c != ORDER], "rejected": rejected}


# ---------------------------------------------------------------- recorder


@dataclass
class Recorder:
    """Successful calls in order, with their arguments, as a script that makes them again."""

    calls: list[tuple[str, str, dict]] = field(default_factory=list)

    def record(self, fn: Callable, stage: str = "", **arguments):
        out = fn(**arguments)
        if not (isinstance(out, dict) and out.get("status") == "error"):
            self.calls.append((stage, getattr(fn, "__name__", str(fn)), {k: v for k, v in arguments.items() if k != "spark"}))
        return out

    def covers(self, stage: str) -> bool:
        return any(s == stage for s, _, _ in self.calls)

    def render_calls(self) -> list[str]:
        return [f"{name}(spark, {', '.join(f'{k}={v!r}' for k, v in args.items())})" for _, name, args in self.calls]

    def render_script(self) -> str:
        head = ["from pyspark.sql import SparkSession", f"from {__name__} import {', '.join(sorted({n for _, n, _ in self.calls}))}" if self.calls else "", "", "spark = SparkSession.builder.getOrCreate()"]
        return "\n".join([*head, *self.render_calls()]) + "\n"
