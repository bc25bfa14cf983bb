"""Quality classifier: a sparse rule ensemble, compiled to Spark column expressions.

Statistics of the whole text are column expressions. On a bounded sample of labelled rows, boosted shallow trees are
grown over them; every path from a root to a node is a rule, a conjunction of thresholds. A lasso logistic regression
(FISTA) over all rules and the standardised statistics leaves few non-zero weights, and what is left becomes one
column expression, so scoring is a projection over the scan: no Python, no shuffle.

Cases: null text counts as empty and gets a score like any other; null labels are not learned from; when the labelled
rows hold one class or none, the score is their share of 1 (0.5 without rows); repeated ``doc_id`` in the labels
count once; repeated rows get equal scores, and a score that ties with the threshold reaches it; very long texts are
measured whole; an empty table gives no rows; extra columns stay, but for ``score`` and ``predicted``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows are learned from: those whose ``xxhash64(doc_id)`` is least.
SAMPLE = 20_000
TREES, DEPTH, BINS, LEAF = 16, 3, 48, 20
SHRINK = 0.3
PENALTY = 1e-3
STEPS = 400
THRESHOLD = 0.3

SPACE = r"[\x20\x09-\x0D]+"
#: Insides of character classes; no character is in two.
CAPITALS, SYMBOLS, STOPS, DIGITS = r"\p{Lu}", r"#$%&*|!@^~<>{}\[\]\\=+_", ".,;:?", "0-9"


def statistics(text: Column) -> dict[str, Column]:
    """What is measured of a text, each a double.

    Spark counts matches by a list of them, with some 300 bytes of garbage for each: characters are counted by removing
    all others, words by the split that also tells them apart, and only long words, which are rare, as matches.
    """
    t = F.coalesce(text, F.lit(""))
    only = lambda s, inside: F.regexp_replace(s, f"[^{inside}]+", "")
    marks = only(t, CAPITALS + SYMBOLS + STOPS + DIGITS)
    n = lambda inside: F.length(only(marks, inside)).cast("double")
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    split = F.split(F.lower(t), SPACE)
    words = F.greatest(F.size(F.array_remove(split, "")).cast("double"), F.lit(1.0))
    lines = F.size(F.split(t, "\n")).cast("double")
    return {
        "log_words": F.log1p(words),
        "chars_per_word": chars / words,
        "words_per_line": words / lines,
        "distinct_words": F.size(F.array_distinct(split)).cast("double") / words,
        "distinct_lines": F.size(F.array_distinct(F.split(t, "\n"))).cast("double") / lines,
        "capitals": n(CAPITALS) / chars,
        "symbols": n(SYMBOLS) / words,
        "stops": n(STOPS) / words,
        "digits": n(DIGITS) / chars,
        "long_words": F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]{18,}")).cast("double") / words,
    }


Condition = tuple[str, bool, float]  # statistic, whether it is over the threshold, threshold


@dataclass
class Model:
    """Weights of rules and of standardised statistics."""

    intercept: float = 0.0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)
    linear: list[tuple[str, float, float, float, float]] = field(default_factory=list)  # name, low, high, mean, weight per unit

    def score(self, stats: dict[str, Column]) -> Column:
        """The probability of label 1 as a column expression."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            met = None
            for name, over, at in rule:
                one = stats[name] > F.lit(at) if over else stats[name] <= F.lit(at)
                met = one if met is None else met & one
            z = z + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
        for name, low, high, mean, weight in self.linear:
            z = z + (F.least(F.greatest(stats[name], F.lit(low)), F.lit(high)) - F.lit(mean)) * F.lit(weight)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def _tree(binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> list[tuple[tuple[tuple[int, bool, int], ...], np.ndarray]]:
    """Nodes of one tree as (path of (feature, over, bin), rows), grown by histograms of gradients."""
    nodes: list = []
    todo = [((), np.arange(len(gradient)))]
    while todo:
        path, rows = todo.pop()
        if path:
            nodes.append((path, rows))
        if len(path) == DEPTH or len(rows) < 2 * LEAF:
            continue
        best = None
        for j in range(binned.shape[1]):
            b = binned[rows, j]
            g, h, n = (np.cumsum(np.bincount(b, w, BINS))[:-1] for w in (gradient[rows], hessian[rows], None))
            gs, hs = gradient[rows].sum(), hessian[rows].sum()
            gain = g**2 / (h + 1) + (gs - g) ** 2 / (hs - h + 1) - gs**2 / (hs + 1)
            gain[(n < LEAF) | (len(rows) - n < LEAF)] = -1
            k = int(gain.argmax())
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], j, k)
        if best:
            _, j, k = best
            over = binned[rows, j] > k
            todo += [((*path, (j, False, k)), rows[~over]), ((*path, (j, True, k)), rows[over])]
    return nodes


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Intercept and weights of an l1-penalised logistic regression, by FISTA."""
    n, k = x.shape
    step = 4.0 * n / (np.linalg.norm(x, 2) ** 2 + n)
    w = v = np.zeros(k)
    rate = y.mean()
    b = c = float(np.log(rate / (1 - rate)))
    t = 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - y
        new = v - step * (x.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        intercept = c - step * float(error.mean())
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, c = new + (before - 1) / t * (new - w), intercept + (before - 1) / t * (intercept - b)
        w, b = new, intercept
    return b, w


def fit(sample: pd.DataFrame, label: str, names: list[str]) -> Model:
    """The rule ensemble for ``label`` (0 or 1) over the statistics ``names``."""
    y = sample[label].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return Model(float(np.log(share / (1 - share))))
    x = sample[names].to_numpy(np.float64)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    paths: dict[tuple, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        nodes = _tree(binned, p - y, p * (1 - p))
        inner = {path[:-1] for path, _ in nodes}
        for path, rows in nodes:
            paths.setdefault(tuple(sorted(path)))
            if path not in inner:
                margin[rows] -= SHRINK * (p[rows] - y[rows]).sum() / ((p[rows] * (1 - p[rows])).sum() + 1)
    rules = list(paths)
    met = np.stack([np.logical_and.reduce([(binned[:, j] > k) == over for j, over, k in r]) for r in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    clipped = np.clip(x, low, high)
    mean, spread = clipped.mean(axis=0), clipped.std(axis=0)
    scale = np.where(spread > 0, 0.4 / np.where(spread > 0, spread, 1), 0.0)
    b, w = _lasso(np.hstack([met, (clipped - mean) * scale]), y, PENALTY)
    kept = [(tuple((names[j], over, float(cuts[j][k])) for j, over, k in r), float(v)) for r, v in zip(rules, w) if v]
    linear = [(names[j], float(low[j]), float(high[j]), float(mean[j]), float(v * scale[j])) for j, v in enumerate(w[len(rules) :]) if v * scale[j]]
    return Model(b, kept, linear)


def held_out(key: Column, folds: int = 5) -> Column:
    """Rows that are never learned from: those whose CRC-32 of the key as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """The model of ``label``, learned from at most ``sample`` labelled rows outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
    stats = statistics(F.col("text"))
    data = rows.select("doc_id", "label", *(c.alias(k) for k, c in stats.items())).toPandas()
    data = data.sort_values(["doc_id", *stats]).drop_duplicates("doc_id")
    return fit(data, "label", list(stats))


def _measured(docs: DataFrame, model: Model) -> DataFrame:
    """``_row`` (a document), ``_score`` and ``_at``.

    The statistics are a projection of their own, which nothing moves or merges because ``_at`` is not deterministic:
    a filter on the score would else be pushed below it, with the statistics repeated for every rule that reads them.
    """
    stats = statistics(F.col("text"))
    rows = docs.select(F.struct("*").alias("_row"), F.struct(*(c.alias(k) for k, c in stats.items())).alias("_stats"), F.monotonically_increasing_id().alias("_at"))
    return rows.select("_row", model.score({k: F.col(f"_stats.{k}") for k in stats}).alias("_score"), "_at")


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 if the score reaches the threshold); columns of these names are
    replaced."""
    rows = _measured(docs.drop("score", "predicted"), model)
    return rows.select("_row.*", F.col("_score").alias("score"), F.when(F.col("_score") >= threshold, 1).otherwise(0).alias("predicted"))


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold."""
    return _measured(docs, model).where((F.col("_score") >= threshold) & (F.col("_at") >= 0)).select("_row.*")
