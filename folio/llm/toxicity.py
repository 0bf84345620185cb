"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over the words and
word beginnings of a text; each model also gets the probabilities of the
categories before it. In training those are out-of-fold predictions, so that a
later model sees earlier ones as wrong as they will be on new texts.

A labelled category's severe cases are a category of their own, ahead of it in the
chain: those labelled positive whose words speak for the category at least as
clearly as those of half the positives. How clearly a word speaks is learned from
the labels as well (its log odds among positive and other rows); no list of words
is given.

Defined results: a null or empty text has no features and gets the chain's
intercepts. Labels that are null are not learned from. A category without
positive (or without negative) labels predicts its share. Ties in the choice of
words are broken by the word. Repeated rows get the same scores; extra columns
pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, saved

WORD = re.compile(r"[^\W_]+")
STEMS = (4, 5, 6)
FOLDS = 4


def features_of(word: str, vocabulary: dict[str, int]) -> tuple[int, ...]:
    """Features of one lower-case word: itself, and its beginnings marked by ``~``."""
    found = [vocabulary.get(word)]
    found += [vocabulary.get(f"{word[:n]}~") for n in STEMS if len(word) > n]
    return tuple(f for f in found if f is not None)


def rows_of(texts: list[str | None], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once, of a batch of texts."""
    memo: dict[str, tuple[int, ...]] = {}
    rows, columns = [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        got: set[int] = set()
        for word in set(WORD.findall(text.lower())):
            known = memo.get(word)
            if known is None:
                known = memo[word] = features_of(word, vocabulary)
            if known:
                got.update(known)
        rows.extend([i] * len(got))
        columns.extend(sorted(got))
    return np.array(rows, np.int64), np.array(columns, np.int64)


@dataclass
class Linear:
    weights: np.ndarray  # of the features, then of the earlier categories
    intercept: float

    def probability(self, rows: np.ndarray, columns: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        k = len(self.weights) - earlier.shape[1]
        margin = self.intercept + np.bincount(rows, self.weights[columns], n)
        margin += (earlier - 0.5) @ self.weights[k:]
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit_linear(rows, columns, n: int, width: int, earlier: np.ndarray, y: np.ndarray, ridge: float = 1e-5, steps: int = 15) -> Linear:
    """Logistic regression by Newton steps, each solved by conjugate gradients."""
    total = width + earlier.shape[1]
    mean = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(mean / (1 - mean)))
    if not n or y.min() == y.max():
        return Linear(np.zeros(total), start)
    centred = earlier - 0.5
    penalty = np.append(np.full(total, ridge), 1e-9)  # the intercept stays free

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(rows, v[columns], n) + centred @ v[width:total] + v[total]

    def back(u: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(columns, u[rows], width), centred.T @ u, [u.sum()]])

    def loss(v: np.ndarray, margin: np.ndarray) -> float:
        return float((np.logaddexp(0, margin) - y * margin).mean() + (penalty * v * v).sum() / 2)

    w = np.append(np.zeros(total), start)
    margin = times(w)
    now = loss(w, margin)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        slope = back((p - y) / n) + penalty * w
        curve = p * (1 - p) / n
        inverse = 1 / (np.concatenate([np.bincount(columns, curve[rows], width), (centred**2).T @ curve, [curve.sum()]]) + penalty)
        move, left = np.zeros(total + 1), -slope
        ready = inverse * left
        way, size = ready, left @ ready
        for _ in range(30):
            bent = back(curve * times(way)) + penalty * way
            step = size / (way @ bent)
            move, left = move + step * way, left - step * bent
            ready = inverse * left
            before, size = size, left @ ready
            if size < 1e-4 * abs(slope @ (inverse * slope)):
                break
            way = ready + size / before * way
        shift, factor = times(move), 1.0
        while factor > 1e-3 and loss(w + factor * move, margin + factor * shift) > now:
            factor /= 2
        w, margin = w + factor * move, margin + factor * shift
        before, now = now, loss(w, margin)
        if before - now < 1e-7:
            break
    return Linear(w[:total], float(w[total]))


@dataclass
class ToxicityChain:
    categories: list[str]
    vocabulary: dict[str, int]
    models: list[Linear]
    thresholds: list[float]

    def predict(self, texts: list[str | None]) -> list[list[float]]:
        rows, columns = rows_of(texts, self.vocabulary)
        earlier = np.zeros((len(texts), 0))
        for model in self.models:
            p = model.probability(rows, columns, len(texts), earlier)
            earlier = np.column_stack([earlier, p])
        return [earlier[:, j].tolist() for j in range(len(self.models))]


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of best F1, midway between the two scores it lies between."""
    if not len(y) or not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    at = int(np.argmax(f1))
    after = p[order[at + 1]] if at + 1 < len(y) else 0.0
    return float((p[order[at]] + after) / 2)


def features(text):
    """All features of a text column, each once."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1))
    stems = [F.transform(F.filter(words, lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("~"))) for n in STEMS]
    return F.array_distinct(F.concat(words, *stems))


def severe(rows: np.ndarray, columns: np.ndarray, width: int, y: np.ndarray) -> np.ndarray:
    """Which positives have, as a mean over their words that speak for the category, log odds of the positives' median or more."""
    yes = np.bincount(columns, y[rows], width)
    all_ = np.bincount(columns, minlength=width)
    odds = np.log((yes + 1) / (y.sum() + 2)) - np.log((all_ - yes + 1) / (len(y) - y.sum() + 2))
    said = odds[columns] > 0
    count = np.bincount(rows[said], minlength=len(y))
    clear = np.bincount(rows[said], odds[columns[said]], len(y)) / np.maximum(count, 1)
    positive = y > 0
    return (positive & (clear >= np.median(clear[positive]))).astype(float) if positive.any() else np.zeros(len(y))


def out_of_fold(rows: np.ndarray, columns: np.ndarray, width: int, earlier: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Each row's probability by a model that was fitted without the row's fold."""
    out = np.zeros(len(y))
    for k in np.unique(fold):
        train, test = fold != k, fold == k
        if not train.any():
            continue
        at, use = np.cumsum(train) - 1, train[rows]
        model = fit_linear(at[rows[use]], columns[use], int(train.sum()), width, earlier[train], y[train])
        at, use = np.cumsum(test) - 1, test[rows]
        out[test] = model.probability(at[rows[use]], columns[use], int(test.sum()), earlier[test])
    return out


def fit_chain(names: list[str], vocabulary: dict[str, int], rows: np.ndarray, columns: np.ndarray, ys: list[np.ndarray], fold: np.ndarray) -> ToxicityChain:
    """A chain over categories with labels ``ys``; a link is fitted on out-of-fold probabilities of the links before it."""
    n = len(fold)
    earlier = np.zeros((n, 0))
    models, thresholds = [], []
    for y in ys:
        models.append(fit_linear(rows, columns, n, len(vocabulary), earlier, y))
        out = out_of_fold(rows, columns, len(vocabulary), earlier, y, fold)
        thresholds.append(best_threshold(out, y))
        earlier = np.column_stack([earlier, out])
    return ToxicityChain(names, vocabulary, models, thresholds)


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], most_rows: int = 8_000, most_features: int = 1_500) -> ToxicityChain:
    """Learn a chain over ``categories``, 0/1 columns of ``labels``, in chain order, each after its severe cases.

    At most about ``most_rows`` labelled rows, drawn by a hash of doc_id, are
    learned from (being bounded they may be broadcast and collected as feature
    numbers), and ``most_features`` words or beginnings.
    """
    known = labels.select("doc_id", *categories).dropna()
    n = known.count()
    if n > most_rows:
        scale = 1 << 30
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < most_rows * scale // n)
    ys = [f"__y_{c}" for c in categories]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    sample = saved(rows.select("doc_id", "text", *[F.col(c).cast("double").alias(y) for c, y in zip(categories, ys, strict=True)]), "toxicity-sample")
    totals = sample.agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).first()
    used = sample.select(F.explode(features(F.col("text"))).alias("feature"), *ys).groupBy("feature")
    used = used.agg(F.count("*").alias("df"), *[F.sum(y).alias(y) for y in ys]).where("df >= 4")
    # Signed root of the chi-square of each feature with each category.
    score = []
    for y in ys:
        share = (totals[y] or 0) / max(1, totals["n"])
        expected = F.col("df") * share
        score.append(F.abs(F.col(y) - expected) / F.sqrt(expected * (1 - share) + 1e-9))
    picked = used.select("feature", reduce(F.greatest, score).alias("s")) if len(score) > 1 else used.select("feature", score[0].alias("s"))
    names = sorted(r["feature"] for r in picked.orderBy(F.desc("s"), "feature").limit(most_features).collect())
    vocabulary = {w: i for i, w in enumerate(names)}
    numbered = add_columns(
        sample.select("text", "doc_id", *ys),
        ["text"],
        T.StructType([T.StructField("__f", T.ArrayType(T.IntegerType()))]),
        lambda texts: [feature_lists(texts, vocabulary)],
    )
    data = sorted(tuple(r) for r in numbered.select("doc_id", *ys, "__f").collect())
    count = len(data)
    columns = np.array([f for r in data for f in r[-1]], np.int64)
    rows = np.repeat(np.arange(count), [len(r[-1]) for r in data]) if count else np.zeros(0, np.int64)
    fold = np.random.default_rng(0).permutation(count) % FOLDS
    chained: dict[str, np.ndarray] = {}
    for j, category in enumerate(categories):
        y = np.array([r[1 + j] for r in data])
        chained |= {f"severe_{category}": severe(rows, columns, len(names), y), category: y}
    return fit_chain(list(chained), vocabulary, rows, columns, list(chained.values()), fold)


def feature_lists(texts: list[str | None], vocabulary: dict[str, int]) -> list[list[int]]:
    rows, columns = rows_of(texts, vocabulary)
    return [x.tolist() for x in np.split(columns, np.cumsum(np.bincount(rows, minlength=len(texts)))[:-1])]


def predict(docs: DataFrame, chain: ToxicityChain) -> DataFrame:
    """Add ``p_<category>`` for each category and ``is_<category>`` by its threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    kinds = [T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories]
    scored = add_columns(docs, ["text"], T.StructType(kinds), lambda texts: shared.value.predict(texts))
    return scored.withColumns({f"is_{c}": (F.col(f"p_{c}") >= t).cast("int") for c, t in zip(chain.categories, chain.thresholds, strict=True)})
