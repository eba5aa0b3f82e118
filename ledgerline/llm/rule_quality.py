"""Document quality by a sparse rule ensemble over text statistics.

Boosted shallow trees on labelled rows are read as conjunctive rules; a logistic model with an L1
penalty keeps a few of them; these become one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .docstats import stats_column

#: Name of each feature and its value from the statistics s.
FEATURES = {
    "words": lambda s: F.log1p(s["n_words"].cast("double")),
    "word_length": lambda s: s["word_chars"] / _some(s["n_words"]),
    "symbols": lambda s: s["n_symbols"] / _some(s["n_words"]),
    "bars": lambda s: s["n_bar"] / _some(s["n_words"]),
    "shouts": lambda s: s["n_shout"] / _some(s["n_words"]),
    "upper": lambda s: s["n_upper"] / _some(s["n_upper"] + s["n_lower"]),
    "digits": lambda s: s["n_digit"] / _some(s["word_chars"]),
    "distinct": lambda s: s["n_distinct"] / _some(s["n_words"]),
    "repeats": lambda s: s["n_repeat_words"] / _some(s["n_words"]),
    "dup_lines": lambda s: s["n_dup_lines"] / _some(s["n_lines"]),
    "line_words": lambda s: s["n_words"] / _some(s["n_lines"]),
    "wide": lambda s: s["n_wide"] / _some(s["word_chars"]),
}


def _some(c: Column) -> Column:
    return F.greatest(c, F.lit(1)).cast("double")


@dataclass
class RuleModel:
    """score = sigmoid(bias + sum of the weights of the rules that hold); a rule is ((feature, above, threshold), ...)."""

    bias: float
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]] = field(default_factory=list)

    def column(self, stats: Column) -> Column:
        total = F.lit(self.bias)
        for terms, weight in self.rules:
            hold = F.lit(True)
            for name, above, t in terms:
                value = FEATURES[name](stats)
                hold = hold & ((value > t) if above else (value <= t))
            total = total + F.when(hold, F.lit(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_rules(x: np.ndarray, y: np.ndarray, rng, trees: int = 24, depth: int = 3, rate: float = 0.3, bins: int = 32) -> list[tuple]:
    """Paths of boosted trees as tuples of (feature index, above, threshold)."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
    out: list[tuple] = []
    raw = np.zeros(len(y))

    def grow(rows, path, left, grad, hess):
        g, h = grad[rows], hess[rows]
        best = (1e-3, None)
        whole = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            if len(cuts[f]) and left:
                code = codes[rows, f]
                a, b, c = (np.cumsum(np.bincount(code, w, minlength=len(cuts[f]) + 1))[:-1] for w in (g, h, np.ones(len(rows))))
                gain = a**2 / (b + 1) + (g.sum() - a) ** 2 / (h.sum() - b + 1) - whole
                gain[(c < 10) | (len(rows) - c < 10)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if path:
            out.append(path)
        if best[1] is None:
            raw[rows] += rate * g.sum() / (h.sum() + 1)
            return
        f, k = best[1]
        below = codes[rows, f] <= k
        for side, above in ((below, False), (~below, True)):
            grow(rows[side], (*path, (f, above, float(cuts[f][k]))), left - 1, grad, hess)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        use = rng.random(len(y)) < 0.7
        keep = raw.copy()
        grow(np.arange(len(y)), (), depth, np.where(use, y - p, 0), np.where(use, p * (1 - p), 0))
        if np.array_equal(keep, raw):
            break
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights of a logistic model with an L1 penalty, by accelerated proximal gradient."""
    n, m = z.shape
    mean = z.mean(0)
    zc = z - mean
    step = 4.0 / (float(np.linalg.norm(zc, 2)) ** 2 / n + 1)
    w, b = np.zeros(m), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    v, c, t = w, b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(zc @ v + c))) - y
        u = v - step * (zc.T @ r / n)
        new = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0)
        nb = c - step * r.mean()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / s * (new - w), nb + (t - 1) / s * (nb - b)
        w, b, t = new, nb, s
    return b - float(mean @ w), w


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, penalty: float = 2e-4, seed: int = 7) -> RuleModel:
    """A RuleModel from labels (doc_id, quality) of docs (doc_id, text).

    At most max_rows labelled documents, those with the smallest hash of their id, are learned from,
    so what reaches the driver is bounded; of documents that share an id the one with the smallest hash
    of its text counts. Null labels are left out and a document's labels are
    averaged. Without labels the score is 0.5 everywhere; with one kind only it is that share, smoothed.
    """
    named = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("_quality"))
    some = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    picked = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "_quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    stats = picked.select("_quality", stats_column("text").alias("_s"))
    rows = stats.select("_quality", *[f(F.col("_s")).alias(n) for n, f in FEATURES.items()]).toPandas()
    y = (rows["_quality"].to_numpy(float) >= 0.5).astype(float)
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(y)) < 2:
        return RuleModel(float(np.log(share / (1 - share))))
    names = list(FEATURES)
    x = rows[names].to_numpy(float)
    order = np.lexsort([*x.T, y])
    x, y = x[order], y[order]
    paths = list(dict.fromkeys(tree_rules(x, y, np.random.default_rng(seed))))
    if not paths:  # too few rows for any split
        return RuleModel(float(np.log(share / (1 - share))))
    z = np.stack([np.logical_and.reduce([(x[:, f] > t) if above else (x[:, f] <= t) for f, above, t in p]) for p in paths], 1).astype(np.float32)
    _, first = np.unique(z, axis=1, return_index=True)
    first.sort()
    bias, w = lasso_logistic(z[:, first], y, penalty)
    rules = [(tuple((names[f], above, t) for f, above, t in paths[k]), float(v)) for k, v in zip(first, w, strict=True) if abs(v) > 1e-6]
    return RuleModel(bias, rules)


def score_quality(docs: DataFrame, model: RuleModel, out: str = "score") -> DataFrame:
    """docs with the model's score (0 to 1) in the column `out`; rows and other columns stay as they are.

    Null and empty texts are scored by their zero statistics; a column called `out` is replaced.
    """
    stats = fresh("_rule_stats", [*docs.columns, out])
    return docs.withColumn(stats, stats_column("text")).withColumn(out, model.column(F.col(stats))).drop(stats)
