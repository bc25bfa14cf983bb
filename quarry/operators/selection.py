"""Target-aware feature selection: screening, scores, leakage, redundancy.

Scores work on codes: labels of at most ten bins or fifty levels, counted against the target's labels, so all but
the first aggregate see small tables. Model-based scores use Spark ML.
"""

from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.values import ORDER, average_ranks, columns_of, key, missing, names_of, number, numbered, one_row, ordered, quantiles, quoted
from quarry.operators.auto import column_kinds
from quarry.operators.categories import top_levels
from quarry.operators.profile import pearson_pairs

MAX_ROWS, MAX_BINS, MAX_LEVELS, MAX_COMPARED = 20_000, 10, 50, 120
MAX_MISSING_RATE, QUASI_CONSTANT_SHARE, ID_LIKE_SHARE = 0.5, 0.99, 0.95
LEAKAGE_SCORE, MAX_CORRELATION = 0.98, 0.95
#: As deep as Spark's trees can be.
MAX_DEPTH = 30
TASKS = ("binary", "multiclass", "regression")


def resolve_task(df: DataFrame, target: str, task: str | None = None) -> str:
    """binary, multiclass or regression; a constant target is an error."""
    if task:
        if task not in TASKS:
            raise ValueError(f"unknown task: {task}")
        return task
    f = one_row(df, F.count_if(~missing(df, target)).alias("n"), F.count_distinct(F.when(~missing(df, target), key(df, target))).alias("levels"), F.count(number(df, target)).alias("numbers"))
    if f["levels"] < 2:
        raise ValueError(f"{target} does not vary")
    if f["levels"] == 2:
        return "binary"
    if f["numbers"] < 0.8 * f["n"] or f["levels"] <= min(20, max(2, f["n"] // 20)):
        return "multiclass"
    return "regression"


def screen_features(df: DataFrame, features=None, max_missing_rate: float = MAX_MISSING_RATE, quasi_constant_share: float = QUASI_CONSTANT_SHARE, id_like_share: float = ID_LIKE_SHARE) -> DataFrame:
    """``column`` and ``reason`` of the columns not worth ranking: empty, constant, quasi_constant, high_missing,
    id_like, date_column or duplicate (of an earlier column: equal sums of hashes, then equal in every row)."""
    columns = columns_of(df, features)
    kinds = column_kinds(df, columns)
    n = df.count()
    hashes = {c: F.sum(F.xxhash64(key(df, c)).cast("decimal(38,0)")) for c in columns}
    row = one_row(df, *(f for c in columns for f in (F.count_if(missing(df, c)).alias(f"h {c}"), F.count_distinct(F.when(~missing(df, c), key(df, c))).alias(f"d {c}"), hashes[c].alias(f"f {c}"))))
    top = {}
    for c in columns:
        if 1 < row[f"d {c}"] <= max(2, n * (1 - quasi_constant_share) + 1):
            counted = df.where(~missing(df, c)).groupBy(key(df, c).alias("k")).count()
            top[c] = counted.agg(F.max("count")).head()[0]
    alike = [(a, b) for a, b in combinations(columns, 2) if row[f"f {a}"] == row[f"f {b}"]]
    same = one_row(df, *((F.count_if(key(df, a) != key(df, b)) == 0).alias(f"{k}") for k, (a, b) in enumerate(alike))) if alike else {}
    twin: dict[str, str] = {}
    for k, (a, b) in enumerate(alike):
        if same[f"{k}"]:
            twin.setdefault(b, a)
    out = []
    for c in columns:
        there, distinct = n - row[f"h {c}"], row[f"d {c}"]
        if not there:
            reason = "empty"
        elif distinct == 1:
            reason = "constant"
        elif top.get(c, 0) >= quasi_constant_share * there:
            reason = "quasi_constant"
        elif row[f"h {c}"] > max_missing_rate * n:
            reason = "high_missing"
        elif kinds[c] == "date":
            reason = "date_column"
        elif distinct > 20 and distinct >= id_like_share * there:
            reason = "id_like"
        else:
            reason = f"duplicate of {twin[c]}" if c in twin else None
        if reason:
            out.append((c, reason))
    return df.sparkSession.createDataFrame(out, "column string, reason string")


def discretised(df: DataFrame, column: str, numeric: bool, bins: int = MAX_BINS) -> Column:
    """A label per cell: the number of quantile edges below a number, or a common level; missing is a label."""
    return _labels(df, {column: numeric}, bins)[column]


def _labels(df: DataFrame, columns: dict[str, bool], bins: int = MAX_BINS) -> dict[str, Column]:
    """:func:`discretised` of several columns (and whether each is numeric), the edges of all by the same passes."""
    x = {c: number(df, c) for c, numeric in columns.items() if numeric}
    n = one_row(df, *(F.count(v).alias(c) for c, v in x.items())) if x else {}
    edges = quantiles(df, {c: v for c, v in x.items() if n[c] > bins}, [i / bins for i in range(1, bins)])
    out = {}
    for c in columns:
        if c in edges:
            label = F.concat(F.lit("bin_"), sum(((x[c] > F.lit(e)).cast("int") for e in sorted(set(edges[c]))), F.lit(0)).cast("string"))
            out[c] = F.when(x[c].isNull(), F.lit("missing")).otherwise(label)
            continue
        common, k = top_levels(df, c, MAX_LEVELS), key(df, c)
        out[c] = F.when(missing(df, c), F.lit("missing")).when(k.isin(*common) if common else F.lit(False), k).otherwise(F.lit("other"))
    return out


def _numeric(df: DataFrame, column: str) -> bool:
    return column_kinds(df, [column])[column] == "numeric"


def _joint(df: DataFrame, labels: dict[str, Column], other: Column) -> DataFrame:
    """``column``, ``a``, ``b`` and ``n`` of each pair of labels of each column and the other, in one aggregate."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), v.alias("a")) for c, v in labels.items())))
    return df.select(each.alias("_l"), other.alias("b")).groupBy("_l.column", "_l.a", "b").agg(F.count(F.lit(1)).alias("n"))


def _totals(joint: DataFrame) -> DataFrame:
    """A joint count with the totals of both sides and of all; its labels may be as many as a column has levels."""
    a = joint.groupBy("column", "a").agg(F.sum("n").alias("na"))
    b = joint.groupBy("column", "b").agg(F.sum("n").alias("nb"))
    whole = joint.groupBy("column").agg(F.sum("n").alias("total"))
    return joint.join(a, ["column", "a"]).join(b, ["column", "b"]).join(whole, "column")


def _target_label(df: DataFrame, target: str, task: str) -> Column:
    return discretised(df, target, task == "regression")


def _outcome(df: DataFrame, target: str, task: str) -> Column:
    """The target as a number: the rarer level (ties by name) of two is 1."""
    if task == "regression":
        return number(df, target)
    rare = df.where(~missing(df, target)).groupBy(key(df, target).alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy("n", "k").limit(1).collect()[0]["k"]
    return F.when(~missing(df, target), (key(df, target) == F.lit(rare)).cast("double"))


def mutual_information(df: DataFrame, feature: str, target: str, task: str) -> DataFrame:
    """``score``: shared bits over the target's entropy."""
    return _information(df, {feature: _numeric(df, feature)}, target, task).select("score")


def _information(df: DataFrame, columns: dict[str, bool], target: str, task: str) -> DataFrame:
    """``column`` and ``score`` of all columns at once."""
    t = _totals(_joint(df, _labels(df, columns), _target_label(df, target, task)))
    p, pa, pb = F.col("n") / F.col("total"), F.col("na") / F.col("total"), F.col("nb") / F.col("total")
    shared = F.greatest(F.sum(p * F.log2(p / (pa * pb))), F.lit(0.0))
    entropy = -F.sum(p * F.log2(pb))
    return t.groupBy("column").agg(F.coalesce(F.try_divide(shared, entropy), F.lit(0.0)).alias("score"))


def cramers_v(df: DataFrame, feature: str, target: str, task: str) -> DataFrame:
    """``score`` from the chi-square of the labels; empty cells are in the identity, so none are made."""
    return _association(df, {feature: _numeric(df, feature)}, target, task).select("score")


def _association(df: DataFrame, columns: dict[str, bool], target: str, task: str) -> DataFrame:
    """``column`` and ``score`` of all columns at once."""
    t = _totals(_joint(df, _labels(df, columns), _target_label(df, target, task)))
    return t.groupBy("column").agg(_v().alias("score"))


def _v() -> Column:
    total = F.max("total")
    chi = total * (F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))) - 1)
    least = F.least(F.count_distinct("a"), F.count_distinct("b")) - 1
    return F.sqrt(F.greatest(F.try_divide(chi, total * least), F.lit(0.0)))


def information_value(df: DataFrame, feature: str, target: str, task: str) -> DataFrame:
    """``score`` of a binary target: sum of (p1 - p0) ln(p1 / p0) with half a row of smoothing."""
    y = _outcome(df, target, task)
    label = discretised(df, feature, _numeric(df, feature))
    g = df.select(label.alias("a"), y.alias("y")).where("y is not null").groupBy("a").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    whole = g.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"), F.count(F.lit(1)).alias("k"))
    both = g.crossJoin(F.broadcast(whole))
    p1 = (F.col("n1") + 0.5) / (F.col("t1") + 0.5 * F.col("k"))
    p0 = (F.col("n0") + 0.5) / (F.col("t0") + 0.5 * F.col("k"))
    return both.agg(F.sum((p1 - p0) * F.ln(p1 / p0)).alias("score"))


def pearson(df: DataFrame, feature: str, target: str, task: str) -> DataFrame:
    """``score``: |r| with the target (two complete pairs or more)."""
    x, y = number(df, feature), _outcome(df, target, task)
    return df.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null").agg(_r().alias("score"))


def _r(x: str = "x", y: str = "y") -> Column:
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.least(F.abs(r), F.lit(1.0))


def spearman(df: DataFrame, feature: str, target: str, task: str) -> DataFrame:
    """``score``: |r| of average ranks."""
    both = df.select(number(df, feature).alias("x"), _outcome(df, target, task).alias("y")).where("x is not null and y is not null")
    rx = average_ranks(both.select("x")).select(F.col("value").alias("x"), F.col("rank").alias("rx"))
    ry = average_ranks(both.select("y")).select(F.col("value").alias("y"), F.col("rank").alias("ry"))
    return both.join(rx, "x").join(ry, "y").agg(_r("rx", "ry").alias("score"))


def auc(df: DataFrame, feature: str, target: str, task: str) -> DataFrame:
    """``score``: 2 |AUC - 0.5| of a binary target, ties counted half."""
    both = df.select(number(df, feature).alias("x"), _outcome(df, target, task).alias("y")).where("x is not null and y is not null")
    ranks = average_ranks(both.select("x")).select(F.col("value").alias("x"), F.col("rank"))
    n1, n0 = F.sum("y"), F.sum(1 - F.col("y"))
    area = F.try_divide(F.sum((F.col("rank") + 1) * F.col("y")) - n1 * (n1 + 1) / 2, n1 * n0)
    return both.join(ranks, "x").agg((2 * F.abs(area - 0.5)).alias("score"))


def anova_f(df: DataFrame, feature: str, target: str, task: str) -> DataFrame:
    """``score``: one-way F of a number over the target's levels with two rows or more (perfect separation: null
    score and a note)."""
    x = number(df, feature)
    g = df.select(x.alias("x"), _target_label(df, target, task).alias("g")).where("x is not null and g <> 'missing'").groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")).where("n >= 2")
    whole = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"))
    both = g.select("m", F.col("n").alias("own")).crossJoin(F.broadcast(whole))
    s = both.agg(F.sum(F.col("own") * (F.col("m") - F.col("mean")) ** 2).alias("between"), F.max("within").alias("within"), F.max("n").alias("n"), F.max("k").alias("k"))
    f = F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return s.select(F.when((F.col("k") >= 2) & (F.col("n") > F.col("k")), f).alias("score"))


def f_test(df: DataFrame, feature: str, target: str, task: str) -> DataFrame:
    """``score``: one-way F over the target's levels, or of the straight line through a numeric target, with holes
    filled by the median; categories count as their share of the rows."""
    if _numeric(df, feature) or column_kinds(df, [feature])[feature] == "boolean":
        x = number(df, feature)
        x = F.coalesce(x, F.lit((quantiles(df, {feature: x}, [0.5])[feature] or [0.0])[0]))
    else:
        from quarry.operators.categories import frequency_encoding

        df, (_, share) = frequency_encoding(df, [feature])
        x = F.col(share)
    if task != "regression":
        g = df.where(~missing(df, target)).select(x.alias("x"), key(df, target).alias("g")).groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
        s = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"))
        between = F.greatest(F.col("ss") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))
        f = F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
        return s.select(F.when((F.col("k") >= 2) & (F.col("n") > F.col("k")), f).alias("score"))
    pairs = df.select(x.alias("x"), number(df, target).alias("y")).where("y is not null")
    r2 = F.try_divide(F.covar_pop("x", "y") ** 2, F.var_pop("x") * F.var_pop("y"))
    return pairs.agg(F.when(F.count("x") > 2, F.try_divide(r2 * (F.count("x") - 2), 1 - r2)).alias("score"))


def f_p_value(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution, by the continued fraction of the incomplete beta function."""
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    return _beta(x, a, b)


def _beta(x: float, a: float, b: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        n = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + n * d
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1 + n / (c if abs(c) > 1e-300 else 1e-300)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def variance(df: DataFrame, feature: str, target: str | None = None, task: str | None = None) -> DataFrame:
    """``score``: population variance, whatever the target."""
    return df.agg(F.var_pop(number(df, feature)).alias("score"))


# ---------------------------------------------------------------- models


def _matrix(df: DataFrame, features: list[str], target: str, task: str) -> DataFrame:
    """``features`` vector (numbers with median fills, categories as frequencies) and ``label``."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    from quarry.operators.categories import frequency_encoding
    from quarry.operators.rows import quantiles_of

    kinds = column_kinds(df, features)
    numeric = [c for c in features if kinds[c] in ("numeric", "boolean")]
    medians = quantiles_of(df, numeric, [0.5])
    df, _ = frequency_encoding(df, [c for c in features if c not in numeric])
    cols = [(F.coalesce(number(df, c), F.lit((medians[c] or [0.0])[0])) if c in numeric else F.col(f"{c}_frequency_ratio")).alias(f"f{i}") for i, c in enumerate(features)]
    label = number(df, target) if task == "regression" else key(df, target)
    out = df.where(~missing(df, target)).select(*cols, label.alias("y"))
    out = out.withColumnRenamed("y", "label") if task == "regression" else StringIndexer(inputCol="y", outputCol="label").fit(out).transform(out)
    return VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="features").transform(out).select("features", "label")


def _forest(task: str, trees: int, max_depth: int | None = None):
    """A forest; without a depth its trees grow as deep as Spark lets them."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    kind = RandomForestRegressor if task == "regression" else RandomForestClassifier
    return kind(numTrees=trees, maxDepth=MAX_DEPTH if max_depth is None else max_depth, maxMemoryInMB=512, seed=0)


def random_forest(df: DataFrame, features: list[str], target: str, task: str, trees: int = 200, max_depth: int | None = None) -> dict[str, float]:
    """Impurity importances of a forest."""
    model = _forest(task, trees, max_depth).fit(_matrix(df, features, target, task))
    return dict(zip(features, map(float, model.featureImportances.toArray())))


def l1(df: DataFrame, features: list[str], target: str, task: str, c: float = 1.0, alpha: float = 0.01) -> dict[str, float]:
    """Greatest absolute weight of a lasso fit over standardised columns."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.regression import LinearRegression

    data = _matrix(df, features, target, task)
    data = StandardScaler(inputCol="features", outputCol="z", withMean=True).fit(data).transform(data)
    if task == "regression":
        weights = [abs(w) for w in LinearRegression(featuresCol="z", regParam=alpha, elasticNetParam=1.0, standardization=False).fit(data).coefficients]
    else:
        model = LogisticRegression(featuresCol="z", regParam=1.0 / (c * max(1, data.count())), elasticNetParam=1.0, standardization=False).fit(data)
        weights = abs(model.coefficientMatrix.toArray()).max(axis=0)
    return dict(zip(features, map(float, weights)))


def _linear_weights(data: DataFrame, left: list[int], task: str) -> np.ndarray:
    """Weights of a linear or logistic fit (ridge, C = 1) on some of the matrix's columns: one row a class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorSlicer
    from pyspark.ml.regression import LinearRegression

    data = VectorSlicer(inputCol="features", outputCol="some", indices=left).transform(data)
    if task == "regression":
        return np.array([LinearRegression(featuresCol="some", solver="normal").fit(data).coefficients.toArray()])
    model = LogisticRegression(featuresCol="some", maxIter=1000, regParam=1.0 / max(1, data.count()), standardization=False).fit(data)
    return model.coefficientMatrix.toArray()


def rfe(df: DataFrame, features: list[str], target: str, task: str, keep: int | None = None) -> dict[str, float]:
    """Recursive elimination by linear or logistic weights: the column of the least squared weight goes (ties by place)
    until ``keep`` (default: half) are left. Kept ones score from 0.5 to 1 by greatest weight, others below 0.5 by how
    late they went."""
    data = _matrix(df, features, target, task)
    left, order = list(range(len(features))), []
    keep = max(1, min(keep or max(1, len(features) // 2), len(features)))
    while len(left) > keep:
        weights = (_linear_weights(data, left, task) ** 2).sum(axis=0)
        order.append(left.pop(int(weights.argmin())))
    last = np.abs(_linear_weights(data, left, task)).max(axis=0)
    out = {features[j]: 0.5 * i / max(len(order), 1) for i, j in enumerate(order)}
    return out | {features[j]: 0.5 + 0.5 * float(w) / (float(last.max()) or 1.0) for j, w in zip(left, last)}


def permutation(df: DataFrame, features: list[str], target: str, task: str, repeats: int = 5, trees: int = 100, max_depth: int | None = None) -> dict[str, tuple[float, float]]:
    """How much a forest's held-out metric falls when a column is shuffled: mean and deviation over the repeats.

    Rows are numbered by partition; a shuffle takes the value of the row a random distance further on, in a seeded
    order of its own, so no task sees all rows.
    """
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.functions import array_to_vector, vector_to_array

    train, test = _matrix(df, features, target, task).randomSplit([0.75, 0.25], seed=0)
    model = _forest(task, trees, max_depth).fit(train)
    judge = RegressionEvaluator(metricName="r2") if task == "regression" else MulticlassClassificationEvaluator(metricName="accuracy")
    base = judge.evaluate(model.transform(test))
    rows = test.select(vector_to_array("features").alias("v"), "label")
    falls: dict[str, list[float]] = {f: [] for f in features}
    for turn in range(repeats):
        # equal rows may share a bucket: any row of the column may stand in for any other
        spread, n = numbered(rows.withColumn("_h", F.xxhash64("v", "label", F.lit(turn))), "_h", "at")
        if not n:
            break
        step = 1 + random.Random(turn).randrange(max(1, n - 1))
        for i, f in enumerate(features):
            other = spread.select(((F.col("at") + step) % n).alias("at"), F.col("v")[i].alias("swap"))
            mixed = spread.join(other, "at").withColumn("features", array_to_vector(F.transform("v", lambda x, k: F.when(k == i, F.col("swap")).otherwise(x))))  # noqa: B023
            falls[f].append(base - judge.evaluate(model.transform(mixed)))
    return {f: (float(np.mean(v)), float(np.std(v))) for f, v in falls.items() if v}


METHODS = {
    "mutual_information": (mutual_information, TASKS),
    "correlation": (pearson, ("binary", "regression")),
    "spearman": (spearman, ("binary", "regression")),
    "anova_f": (anova_f, ("binary", "multiclass")),
    "cramers_v": (cramers_v, TASKS),
    "auc": (auc, ("binary",)),
    "information_value": (information_value, ("binary",)),
    "variance": (variance, TASKS),
    "f_test": (f_test, TASKS),
}
MODEL_METHODS = {"random_forest": random_forest, "l1": l1, "rfe": rfe, "permutation": permutation}
NUMBERS_ONLY = {"correlation", "spearman", "auc", "anova_f", "variance"}
#: Scores of all columns by the same passes.
AT_ONCE = {"mutual_information": _information, "cramers_v": _association}
SELECTION_METHODS = (*METHODS, *MODEL_METHODS, "sklearn_mutual_information")


def resolve_method(method: str | None, task: str) -> str:
    """A method that fits the task; ValueError otherwise."""
    method = "mutual_information" if method in (None, "", "auto") else method
    if method in MODEL_METHODS:
        return method
    if method == "sklearn_mutual_information":
        raise ValueError("sklearn_mutual_information needs a package that is not installed")
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if task not in METHODS[method][1]:
        raise ValueError(f"{method} does not fit a {task} target")
    return method


def sampled(df: DataFrame, max_rows: int | None, order=None) -> DataFrame:
    """Every k-th row in the table's order, or by a hash of the row, when there are more than ``max_rows``."""
    if not max_rows:
        return df
    step = -(-df.count() // max_rows)
    place = ordered(df, order)
    if step <= 1:
        return df
    if place == [ORDER]:
        return df.where(F.col(ORDER) % step == 0)
    return df.where(F.pmod(F.xxhash64(*map(quoted, place or df.columns)), F.lit(step)) == 0)


def rank_features(df: DataFrame, target: str, features=None, method: str | None = None, task: str | None = None, max_rows: int | None = None, **options) -> DataFrame:
    """``column`` and ``score`` by the method, best first, unscored last; ``std`` too where the method repeats itself.
    Whole table unless ``max_rows`` asks for the systematic sample. ``options`` go to model methods (trees, max_depth,
    repeats, keep)."""
    task = resolve_task(df, target, task)
    method = resolve_method(method, task)
    columns = [c for c in columns_of(df, features) if c != target]
    df = sampled(df, max_rows)
    spark = df.sparkSession
    if method in MODEL_METHODS:
        found = MODEL_METHODS[method](df, columns, target, task, **options)
        more = ", std double" if method == "permutation" else ""
        rows = [(c, *v) if more else (c, v) for c, v in found.items()]
        return spark.createDataFrame(rows, f"column string, score double{more}").orderBy(F.desc_nulls_last("score"), "column")
    kinds = column_kinds(df, columns)
    if method in AT_ONCE and columns:
        out = AT_ONCE[method](df, {c: kinds[c] == "numeric" for c in columns}, target, task)
        return out.select("column", F.col("score").cast("double").alias("score")).orderBy(F.desc_nulls_last("score"), "column")
    out = spark.createDataFrame([(c, None) for c in columns if method in NUMBERS_ONLY and kinds[c] not in ("numeric", "boolean")], "column string, score double")
    for c in columns:
        if method not in NUMBERS_ONLY or kinds[c] in ("numeric", "boolean"):
            out = out.unionByName(METHODS[method][0](df, c, target, task).select(F.lit(c).alias("column"), F.col("score").cast("double").alias("score")))
    return out.orderBy(F.desc_nulls_last("score"), "column")


def leakage_suspects(df: DataFrame, target: str, features, task: str | None = None, threshold: float = LEAKAGE_SCORE, max_rows: int | None = None) -> DataFrame:
    """Features whose normalised mutual information with the target reaches the threshold."""
    return rank_features(df, target, features, "mutual_information", task, max_rows).where(F.col("score") >= threshold)


def redundant_pairs(df: DataFrame, features, threshold: float = MAX_CORRELATION, max_rows: int | None = None) -> DataFrame:
    """``a``, ``b`` and ``association`` from the threshold on, among the first 120 features: |r| of numbers (all pairs
    in one aggregate), Cramer's V of categories, correlation ratio of both (one aggregate a category)."""
    columns = names_of(features)[:MAX_COMPARED]
    df = sampled(df, max_rows)
    kinds = column_kinds(df, columns)
    numeric = [c for c in columns if kinds[c] in ("numeric", "boolean")]
    out = df.sparkSession.createDataFrame([], "a string, b string, association double")
    pairs = list(combinations(numeric, 2))
    if pairs:
        out = out.unionByName(pearson_pairs(df, pairs, 2).select("a", "b", F.abs("r").alias("association")))
    categories = [c for c in columns if c not in numeric]
    for a, b in combinations(categories, 2):
        t = _totals(_joint(df.where(~missing(df, a) & ~missing(df, b)), {a: key(df, a)}, key(df, b)))
        out = out.unionByName(t.agg(_v().alias("association")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "association"))
    mixed = []
    for g in categories if numeric else ():
        for r in _ratios(df, numeric, g):
            x = r["x"]
            a, b = (x, g) if columns.index(x) < columns.index(g) else (g, x)
            mixed.append((a, b, r["eta"]))
    if mixed:
        out = out.unionByName(df.sparkSession.createDataFrame(mixed, "a string, b string, association double"))
    return out.where(F.col("association") >= threshold).orderBy(F.desc("association"), "a", "b")


def _ratios(df: DataFrame, numeric: list[str], group: str) -> list:
    """``x`` and ``eta``: correlation ratios of all numeric columns by one category, in one aggregate over its levels."""
    there = df.where(~missing(df, group))
    g = there.groupBy(key(df, group).alias("g")).agg(*(f for i, c in enumerate(numeric) for x in (number(df, c),) for f in (F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"))))
    each = []
    for i, c in enumerate(numeric):
        n, m, v = F.col(f"n{i}"), F.col(f"m{i}"), F.col(f"v{i}")
        total, k = F.sum(n), F.count_if(n > 0)
        between = F.greatest(F.sum(n * m * m) - F.sum(n * m) * F.sum(n * m) / F.nullif(total, F.lit(0)), F.lit(0.0))
        eta = F.sqrt(F.try_divide(between, between + F.sum(n * v)))
        each.append(F.struct(F.lit(c).alias("x"), F.when((total >= 3) & (k >= 2), eta).alias("eta")))
    return [r["c"] for r in g.agg(F.array(*each).alias("c")).select(F.explode("c").alias("c")).collect() if r["c"]["eta"] is not None]


def select_features(df: DataFrame, target: str, features=None, method: str | None = None, task: str | None = None, top_k: int | None = None, min_score: float | None = None, exclude=None, max_missing_rate: float = MAX_MISSING_RATE, max_correlation: float = MAX_CORRELATION, leakage_score: float = LEAKAGE_SCORE, max_rows: int | None = None) -> DataFrame:
    """``column``, ``score``, ``selected``, ``stage`` and ``reason``: screened, ranked, cleared of leaks, of the weaker
    of redundant pairs, of low scores, and cut to the best ``top_k``."""
    banned = set(names_of(exclude))
    columns = [c for c in columns_of(df, features) if c != target and c not in banned]
    task = resolve_task(df, target, task)
    drops = {r["column"]: ("screening", r["reason"]) for r in screen_features(df, columns, max_missing_rate).collect()}
    ranked = rank_features(df, target, [c for c in columns if c not in drops], method, task, max_rows).collect()
    scores = {r["column"]: r["score"] for r in ranked}
    for r in leakage_suspects(df, target, list(scores), task, leakage_score, max_rows).collect() if scores else ():
        drops[r["column"]] = ("leakage", f"carries {r['score']:.3f} of the target")
    place = {c: i for i, c in enumerate(scores)}
    for r in redundant_pairs(df, [c for c in scores if c not in drops], max_correlation, max_rows).collect() if scores else ():
        weak, strong = sorted((r["a"], r["b"]), key=lambda c: -place[c])
        drops.setdefault(weak, ("redundancy", f"follows {strong}"))
    left = [c for c in scores if c not in drops]
    for c in left:
        if min_score is not None and (scores[c] is None or scores[c] < min_score):
            drops[c] = ("min_score", "scores too low")
    left = [c for c in left if c not in drops]
    for c in left[top_k:] if top_k else ():
        drops[c] = ("top_k", "not among the best")
    rows = [(c, scores.get(c), c not in drops, *drops.get(c, ("", ""))) for c in columns]
    return df.sparkSession.createDataFrame(rows, "column string, score double, selected boolean, stage string, reason string")
