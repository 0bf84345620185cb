"""Quality classifier: a sparse ensemble of rules compiled into Spark columns.

Shallow trees are boosted over text statistics; every path from a root to a node
is a conjunctive rule. A lasso logistic regression picks and weighs the rules,
and what is left becomes one Spark column expression over the statistics.

Defined results: a null text counts as empty; empty texts have all statistics 0
and get the score that the rules give them. With no labelled rows, or with one
class only, the score is the share of label 1 (0.5 without rows). Labels that are
null are not learned from. A doc_id that is labelled twice counts twice. Extra
columns pass through; names that begin with ``__q_`` are reserved.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, others

STATISTICS = ["chars", "tokens", "token_chars", "symbols", "upper", "digits", "letters", "bars", "distinct", "lines", "stops"]


def statistics(docs: DataFrame) -> DataFrame:
    """Add one column per statistic, named ``__q_<name>``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    squeezed = F.trim(F.regexp_replace(text, r"\s+", " "))
    tokens = F.split("__q_squeezed", " ")
    count = lambda pattern: F.length("__q_squeezed") - F.length(F.regexp_replace("__q_squeezed", pattern, ""))
    raw = (
        docs.withColumn("__q_squeezed", squeezed)
        .withColumn("__q_lines", F.length(text) - F.length(F.translate(text, "\n", "")))
        .withColumn("__q_tokens", F.when(F.col("__q_squeezed") == "", 0).otherwise(F.size(tokens)))
        .withColumn("__q_distinct", F.when(F.col("__q_squeezed") == "", 0).otherwise(F.size(F.array_distinct(tokens))))
        .withColumn("__q_letters", count(r"\p{L}+"))
        .withColumn("__q_upper", count(r"\p{Lu}+"))
        .withColumn("__q_digits", count(r"\p{N}+"))
        .withColumn("__q_symbols", count(r"[^\p{L}\p{N} ,.]+"))
        .withColumn("__q_bars", count(r"\|"))
        .withColumn("__q_stops", count(r"[,.]+"))
        .withColumn("__q_chars", F.length("__q_squeezed"))
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(f"__q_{a}").cast("double"), F.col(f"__q_{b}")), F.lit(0.0))
    return raw.select(
        *columns(docs.columns),
        F.col("__q_chars").cast("double").alias("__q_chars"),
        F.col("__q_tokens").cast("double").alias("__q_tokens"),
        share("chars", "tokens").alias("__q_token_chars"),
        share("symbols", "chars").alias("__q_symbols"),
        share("upper", "letters").alias("__q_upper"),
        share("digits", "chars").alias("__q_digits"),
        share("letters", "chars").alias("__q_letters"),
        share("bars", "tokens").alias("__q_bars"),
        share("distinct", "tokens").alias("__q_distinct"),
        share("lines", "tokens").alias("__q_lines"),
        share("stops", "tokens").alias("__q_stops"),
    )


#: A rule is a conjunction of (statistic, is_above, threshold).
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class RuleModel:
    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self):
        """The score as a Spark column over the ``__q_`` statistics."""
        margin = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for at, above, threshold in rule:
                value = F.col(f"__q_{STATISTICS[at]}")
                test = test & ((value > threshold) if above else (value <= threshold))
            margin = margin + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            margin += weight * holds(rule, x)
        return 1 / (1 + np.exp(-margin))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for at, above, threshold in rule:
        out &= (x[:, at] > threshold) if above else (x[:, at] <= threshold)
    return out


def grow(x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int):
    """A regression tree on gradients; yields (rule, rows, step) of all its nodes, leaves marked."""
    nodes: list[tuple[Rule, np.ndarray, float, bool]] = []

    def split(rule: Rule, rows: np.ndarray, left: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, -1, -1)
        if left and len(rows) >= 2 * least:
            for at in range(x.shape[1]):
                size = len(cuts[at]) + 1
                b = binned[rows, at]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                ok = (nl >= least) & (len(rows) - nl >= least)
                gain = np.where(ok, gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1), 0)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), at, int(gain.argmax()))
        _, at, cut = best
        nodes.append((rule, rows, -g / (h + 1), at < 0))
        if at >= 0:
            below = binned[rows, at] <= cut
            split((*rule, (at, False, float(cuts[at][cut]))), rows[below], left - 1)
            split((*rule, (at, True, float(cuts[at][cut]))), rows[~below], left - 1)

    split((), np.arange(len(x)), depth)
    return nodes


def simplified(rule: Rule) -> Rule:
    """The tightest bound on each side of each statistic, in a fixed order."""
    bounds: dict[tuple[int, bool], float] = {}
    for at, above, threshold in rule:
        known = bounds.get((at, above))
        bounds[at, above] = threshold if known is None else (max if above else min)(known, threshold)
    return tuple((at, above, t) for (at, above), t in sorted(bounds.items()))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 0.002, steps: int = 400) -> RuleModel:
    """Boost trees, take their paths as rules, and fit lasso weights (FISTA)."""
    if not len(y):
        return RuleModel(0.0)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return RuleModel(base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 34)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin, rules = np.full(len(y), base), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        for rule, rows, step, leaf in grow(x, binned, cuts, p - y, p * (1 - p), depth, max(5, len(y) // 500)):
            if rule:
                rules.setdefault(simplified(rule), None)
            if leaf:
                margin[rows] += 0.3 * step
    names = list(rules)
    z = np.stack([holds(r, x) for r in names], axis=1).astype(np.float64)
    # Rules that hold on the same rows are one rule.
    _, first = np.unique(z, axis=1, return_index=True)
    first = np.sort(first)
    names, z = [names[i] for i in first], z[:, first]
    rate = 4 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    w, b, v, c, t = np.zeros(z.shape[1]), base, np.zeros(z.shape[1]), base, 1.0
    for _ in range(steps):
        err = 1 / (1 + np.exp(-(z @ v + c))) - y
        w2 = v - rate * (z.T @ err) / len(y)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * penalty, 0)
        b2, t2 = c - rate * err.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(float(b), [names[i] for i in kept], [float(w[i]) for i in kept])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 10_000) -> RuleModel:
    """Learn from ``labels`` (doc_id, label) joined with ``docs`` (doc_id, text).

    At most about ``most_rows`` labelled rows, drawn by a hash of doc_id, are
    learned from; as their number is bounded they may be broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("__label"))
    n = known.count()
    if n > most_rows:
        scale = 1 << 30
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < most_rows * scale // n)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))
    data = rows.select("doc_id", "__label", *[f"__q_{s}" for s in STATISTICS]).toPandas()
    data = data.sort_values(list(data.columns))
    return fit_rules(data[[f"__q_{s}" for s in STATISTICS]].to_numpy(float), data["__label"].to_numpy(float))


def score(docs: DataFrame, model: RuleModel, output: str = "score") -> DataFrame:
    """Add the score to each row, in place of a column of that name.

    The statistics go through a generator, whose output the optimizer puts into no
    filter on the score; else each rule would compute them again.
    """
    kept = columns(others(docs, [output]))
    measured = F.inline(F.array(F.struct(*[F.col(f"__q_{s}") for s in STATISTICS])))
    return statistics(docs.select(*kept)).select(*kept, measured).select(*kept, model.column().alias(output))
