"""Quality rules whose verdict is an isolation forest's: documents that few random splits set apart go."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, fresh, text_buffer
from .docstats import block_stats

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATES = ["symbols", "bars", "shouts", "upper", "distinct", "repeats", "dup_lines", "word_length", "line_words"]


def rates(s: dict[str, np.ndarray]) -> np.ndarray:
    """The rule statistics of documents relative to their size, one column for each of RATES."""
    some = lambda x: np.maximum(x, 1).astype(float)
    words, lines = some(s["n_words"]), some(s["n_lines"])
    # shares of distinct words fall with length alone; the logarithm takes that out
    distinct = np.log(some(s["n_distinct"])) / np.maximum(np.log(words), 1)
    return np.stack([s["n_symbols"] / words, s["n_bar"] / words, s["n_shout"] / words, s["n_upper"] / some(s["n_upper"] + s["n_lower"]), distinct, s["n_repeat_words"] / words, s["n_dup_lines"] / lines, s["word_chars"] / words, s["n_words"] / lines], 1)


def _mean_path(n):
    """Expected path length of an unsuccessful search among n points."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays (feature, threshold, left child, path length at a leaf); kept where score <= threshold."""

    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    size: int = 1
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for what is set apart at once."""
        if not self.trees:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for feature, cut, left, depth in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(depth.max()) + 1):
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                node = np.where(inner, left[node] + (x[row, np.maximum(f, 0)] > cut[node]), node)
            total += depth[node]
        return 2.0 ** (-total / len(self.trees) / max(float(_mean_path(self.size)), 1e-9))


def grow_forest(x: np.ndarray, scale: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 3) -> Forest:
    """Trees on rows x; scale is each statistic's spread over all labelled rows, how far outside its rows a split may fall."""
    rng = np.random.default_rng(seed)
    n = min(sample, len(x))
    limit = int(np.ceil(np.log2(max(n, 2))))
    out = Forest(size=n)
    for _ in range(trees):
        feature, cut, left, depth = [], [], [], []

        def node():
            for a in (feature, cut, left, depth):
                a.append(0)
            return len(feature) - 1

        todo = [(node(), x[rng.choice(len(x), n, replace=False)], 0)]
        while todo:
            k, rows, d = todo.pop()
            low, high = rows.min(0), rows.max(0)
            wide = np.flatnonzero((high > low) | (scale > 0))
            if d >= limit or len(rows) < 2 or not len(wide):
                feature[k], depth[k] = -1, d + float(_mean_path(len(rows)))
                continue
            f = int(rng.choice(wide))
            # splits may pass outside the rows seen, so that what is far off ends early even where these are all alike
            reach = scale[f]
            t = rng.uniform(low[f] - reach, high[f] + reach)
            a = node()
            node()
            feature[k], cut[k], left[k], depth[k] = f, float(t), a, 0
            for child, part in ((a, rows[rows[:, f] <= t]), (a + 1, rows[rows[:, f] > t])):
                if len(part):
                    todo.append((child, part, d + 1))
                else:
                    feature[child], depth[child] = -1, d + 1.0
        out.trees.append((np.array(feature), np.array(cut, float), np.array(left), np.array(depth, float)))
    return out


def calibrate(forest: Forest, good: np.ndarray, bad: np.ndarray, most_lost: float = 0.002) -> float:
    """The threshold that catches most bad rows while at most most_lost of the good ones are above it.

    Among equal ones the middle of the gap is taken. Without good rows it is 1, where all are kept;
    without bad rows it is halfway from the largest good score to 1.
    """
    if not len(good):
        return 1.0
    g, b = np.sort(forest.score(good)), np.sort(forest.score(bad)) if len(bad) else np.zeros(0)
    floor = g[min(len(g) - 1, int(np.ceil(len(g) * (1 - most_lost))) - 1)]
    above = b[b > floor]
    if not len(above):
        return float((floor + 1) / 2)
    least = np.quantile(above, 0.005)
    tops = g[g <= least]
    return float((max(floor, tops.max()) + least) / 2) if len(tops) else float(floor)


def _stats(docs_text, forest: Forest | None):
    names = [*BASE, "anomaly"] if forest else [*RATES, "failed"]

    @F.arrow_udf(", ".join(f"{c} {'long' if c in BASE else 'double'}" for c in names))
    def run(col: pa.Array) -> pa.Array:
        offsets, data = text_buffer(col)
        out = {c: [] for c in names}
        for i, j in blocks(offsets):
            s = block_stats(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
            x = rates(s)
            if forest:
                for c in BASE:
                    out[c].append(s[c])
                out["anomaly"].append(forest.score(x))
            else:
                for k, c in enumerate(RATES):
                    out[c].append(x[:, k])
                out["failed"].append(((s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])).astype(float))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(v) if v else [], pa.int64() if c in BASE else pa.float64()) for c, v in out.items()], names=names)

    return run(docs_text)


def calibrated(scored: DataFrame, most_lost: float = 0.002) -> float:
    """calibrate over a table (good boolean, anomaly double) of any size: its two order statistics come from sorts that keep a small share."""
    n = {r["good"]: r["n"] for r in scored.groupBy("good").agg(F.count("*").alias("n")).collect()}
    good, bad = scored.where("good"), scored.where("not good")
    if not n.get(True):
        return 1.0
    place = min(n[True] - 1, int(np.ceil(n[True] * (1 - most_lost))) - 1)
    floor = good.orderBy(F.desc("anomaly")).limit(n[True] - place).agg(F.min("anomaly")).first()[0]
    above = bad.where(F.col("anomaly") > F.lit(floor))
    m = above.count()
    if not m:
        return float((floor + 1) / 2)
    at = 0.005 * (m - 1)
    low, high = (above.orderBy("anomaly").limit(int(k) + 1).agg(F.max("anomaly")).first()[0] for k in (np.floor(at), np.ceil(at)))
    least = low + (high - low) * (at - np.floor(at))
    top = good.where(F.col("anomaly") <= F.lit(float(least))).agg(F.max("anomaly")).first()[0]
    return float(floor) if top is None else float((max(floor, top) + least) / 2)


def fit_forest(docs: DataFrame, labels: DataFrame, trees: int = 100, sample: int = 512) -> Forest:
    """A forest grown on labelled good documents that pass the base rules; the threshold is calibrated on good and bad ones.

    All labelled documents count: the spread of each statistic and the threshold come from all of them, and each tree isolates
    `sample` rows, as the method has it, drawn from trees * sample rows with the smallest hashes among all good ones. Of several
    texts of one id the one with the smallest hash is taken; null labels are left out and a document's labels are averaged.
    Without good ones nothing is anomalous.
    """
    scratch = Scratch(docs.sparkSession)
    named = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    hashed = docs.select("doc_id", _stats("text", None).alias("s"), F.xxhash64("text").alias("h")).join(named, "doc_id")  # no text is shuffled
    rows = hashed.groupBy("doc_id", "good").agg(F.min_by("s", "h").alias("s")).select("doc_id", "good", "s.*").where("failed = 0").drop("failed")
    rows = scratch.save(rows, "rates")
    good = rows.where("good")
    x = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trees * sample).select(*RATES).toPandas().to_numpy(float)
    if len(x) < 2:
        scratch.drop(rows)
        return Forest()
    scale = np.array(rows.agg(*[F.stddev_pop(c) for c in RATES]).first(), float)
    forest = grow_forest(x[np.lexsort(x.T)], scale, trees, sample)

    @F.arrow_udf("double")
    def anomaly(*cols: pa.Array) -> pa.Array:
        return pa.array(forest.score(np.stack([c.to_numpy() for c in cols], 1)))

    scored = scratch.save(rows.select("good", anomaly(*RATES).alias("anomaly")), "anomaly")
    forest.threshold = calibrated(scored)
    scratch.drop(rows, scored)
    return forest


def apply_rules(docs: DataFrame, forest: Forest) -> DataFrame:
    """docs with the base counts, base_failed, anomaly and kept.

    base_failed: fewer than 10 words, or more than a fifth of the words in repeated 5-word windows.
    kept: the base rules hold and the anomaly is not above the forest's threshold. Null and empty
    texts have zero counts and fail. Rows are judged alone, so repeated ones are judged alike;
    columns of docs under the new names are replaced.
    """
    out = docs.drop(*BASE, "anomaly", "base_failed", "kept")
    rules = fresh("_rules", out.columns)
    out = out.withColumn(rules, _stats("text", forest)).select("*", f"{rules}.*").drop(rules)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(forest.threshold)))
