"""Mixing towards domain weights when a document belongs to domains only softly.

A linear discriminant learned from a labelled table gives every document posterior probabilities of
the domains. Rates from 0 to an upper bound then minimise

    (t(r) - target)' M^-1 (t(r) - target) / 2  +  ridge / 2 * sum_i w_i (r_i - 1)^2

by projected gradients, where t(r) is the vector of expected domain totals of tokens, relative to all
tokens of the input, w_i a document's share of those and M the token-weighted second moment of the
posteriors. A step needs only the few numbers in t(r), one aggregate; a document's rate is a function
of its posteriors and of the steps so far, so it stays a column expression. Posteriors are computed
once and written with the rows they belong to; the steps and the rates read that table, and no text is
split again. Everything is DataFrame functions; the driver holds numbers whose count depends on
features and domains alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SPACE = r"[\x20\x09-\x0D]+"


def _base(docs: DataFrame) -> DataFrame:
    """(row, words, chars, upper, symbols) of docs (row, text): lower-cased words and counts of characters."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(F.lower(text), SPACE), lambda x: x != "")
    upper, symbols = (F.length(text) - F.length(F.regexp_replace(text, p, "")) for p in ("[A-Z]+", "[#*$%&|<>!]+"))
    return docs.select("row", words.alias("words"), F.length(text).alias("chars"), upper.alias("upper"), symbols.alias("symbols"))


@dataclass
class Domains:
    """What was learned: domain names, their marking words, and a linear score of each domain."""

    names: list[str]
    lexicon: dict[str, list[str]] = field(default_factory=dict)
    weights: np.ndarray | None = None

    def features(self, base: DataFrame) -> DataFrame:
        """(row, n_tokens, f) of what _base gives: number of words and array of features."""
        words = F.size("words")
        some, chars = F.greatest(words, F.lit(1)).cast("double"), F.greatest("chars", F.lit(1)).cast("double")
        f = [F.lit(1.0), F.log1p(words.cast("double")), F.col("chars") / some, F.col("upper") / chars, F.col("symbols") / some, F.size(F.array_distinct("words")) / some]
        for name in self.names:
            if self.lexicon.get(name):
                hits = F.size(F.array_intersect("words", F.array(*map(F.lit, self.lexicon[name])))).cast("double")
                f += [F.least(hits, F.lit(1.0)), F.log1p(hits)]
        return base.select("row", words.cast("long").alias("n_tokens"), F.array(*f).alias("f"))

    def posteriors(self, docs: DataFrame) -> DataFrame:
        """(row, n_tokens, posterior) of docs (row, text), posteriors in the order of names."""
        d = len(self.names)
        found = self.features(_base(docs))
        if self.weights is None:
            return found.select("row", "n_tokens", F.array(*[F.lit(1.0 / d)] * d).alias("posterior"))
        scores = F.array(*[_dot([F.col("f")[k] for k in range(self.weights.shape[1])], w) for w in self.weights])
        found = found.select("row", "n_tokens", scores.alias("s"))
        found = found.select("row", "n_tokens", F.transform("s", lambda x: F.exp(x - F.array_max("s"))).alias("e"))
        found = found.select("row", "n_tokens", "e", F.aggregate("e", F.lit(0.0), lambda a, x: a + x).alias("t"))
        return found.select("row", "n_tokens", F.transform("e", lambda x: x / F.col("t")).alias("posterior"))


def _dot(columns: list[Column], numbers) -> Column:
    out = F.lit(0.0)
    for c, x in zip(columns, numbers, strict=True):
        out = out + c * F.lit(float(x))
    return out


def fit_domains(docs: DataFrame, labels: DataFrame, names: list[str], scratch: Scratch, max_rows: int = 4000, words: int = 40) -> Domains:
    """A linear discriminant of the domains in labels (doc_id, domain) over docs (doc_id, text).

    It learns from at most max_rows labelled documents, those with the smallest hash of their id.
    Null labels and domains outside names are left out; a document with several labels counts with
    the smallest. Without labels all domains are equally likely.
    """
    model = Domains(list(names))
    named = labels.where(F.col("domain").isin(model.names) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    some = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = scratch.save(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select(F.col("domain").alias("row"), "text"), "labelled")
    sizes = {r["row"]: r["n"] for r in sample.groupBy("row").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return model
    total = sum(sizes.values())
    base = scratch.save(_base(sample), "base")
    seen = base.select("row", F.explode(F.array_distinct("words")).alias("word"))
    counts = seen.groupBy("word").agg(*[F.count_if(F.col("row") == n).alias(f"n{k}") for k, n in enumerate(model.names)], F.count("*").alias("n"))
    counts = scratch.save(counts.where("n >= 3"), "words")
    for k, name in enumerate(model.names):
        if sizes.get(name):
            mine, rest = F.col(f"n{k}"), F.col("n") - F.col(f"n{k}")
            odds = F.log((mine + 0.5) / (sizes[name] + 1.0)) - F.log((rest + 0.5) / (total - sizes[name] + 1.0))
            marks = counts.where(mine >= max(3, sizes[name] // 100)).select("word", odds.alias("odds")).where("odds > 1.5").orderBy(F.desc("odds"), "word").limit(words)
            model.lexicon[name] = [r["word"] for r in marks.collect()]
    rows = scratch.save(model.features(base).select("row", "f"), "features")
    m = 6 + 2 * sum(bool(x) for x in model.lexicon.values())
    f = [F.col("f")[k] for k in range(m)]
    second = rows.agg(*[F.sum(f[i] * f[j]).alias(f"c{i}_{j}") for i in range(m) for j in range(i, m)]).first()
    first = rows.groupBy("row").agg(*[F.avg(x).alias(f"m{k}") for k, x in enumerate(f)]).collect()
    means = {r["row"]: np.array([r[f"m{k}"] for k in range(m)]) for r in first}
    cov = np.array([[second[f"c{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)]) / total
    cov -= sum(sizes[n] / total * np.outer(v, v) for n, v in means.items())
    cov += np.diag(1e-3 * np.diag(cov) + 1e-6)
    inverse = np.linalg.inv(cov)
    weights = np.zeros((len(model.names), m))
    for k, name in enumerate(model.names):
        v = means.get(name)
        if v is not None:
            weights[k] = inverse @ v
            weights[k, 0] += np.log(sizes[name] / total) - 0.5 * v @ inverse @ v
        else:
            weights[k, 0] = -50.0
    # the constant feature has no variance; its entry carries each domain's intercept
    model.weights = weights
    scratch.drop(sample, base, counts, rows)
    return model


@dataclass
class Mixture:
    """Steps of the projected gradient, and the table (row, n_tokens, posterior) they were found on."""

    domains: Domains
    ridge: float
    most: float | None
    held: DataFrame
    steps: list[np.ndarray] = field(default_factory=list)
    totals: np.ndarray | None = None

    def rate(self, posterior: Column) -> Column:
        eta = 1 / (1 + self.ridge)
        p = [posterior[k] for k in range(len(self.domains.names))]
        r = F.lit(1.0)
        for z in self.steps:
            r = F.greatest(F.lit(0.0), r * F.lit(1 - eta * self.ridge) + F.lit(eta * self.ridge) - _dot(p, eta * z))
            if self.most is not None:
                r = F.least(F.lit(float(self.most)), r)
        return r


def fit_mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float | None], ridge: float = 1e-2, rounds: int = 40, tolerance: float = 1e-5, max_rows: int = 4000, most: float | None = None, keep: list[str] | None = None) -> Mixture:
    """Rates for docs (doc_id, text) so that expected domain totals of tokens meet targets.

    A target is a domain's total relative to all tokens of the input; None asks for what the domain
    has in the input. If no target is None they are scaled to sum to 1, so that the mixture is as large
    as the input. Rates stay within 0 and `most`, if it is given. Where no rates can meet the targets
    the least-squares nearest are found; steps end when totals move by less than tolerance. An empty
    table has rate 1. `keep` names the columns to carry along (all). Fitting reads max_rows labelled rows.
    """
    given = [t for t in targets.values() if t is not None]
    if (given and min(given) < 0) or (len(given) == len(targets) and sum(given) <= 0):
        raise ValueError("targets must be nonnegative and not all zero")
    scratch = Scratch(docs.sparkSession)
    model = fit_domains(docs, labels, list(targets), scratch, max_rows)
    names = model.names
    carried = docs.select(F.struct(*[docs[f"`{c}`"] for c in (keep or docs.columns)]).alias("row"), "text")
    held = scratch.save(model.posteriors(carried), "posteriors")
    mixture = Mixture(model, ridge, most, held)
    p = [F.col("posterior")[k] for k in range(len(names))]
    w = F.col("n_tokens").cast("double")
    d = range(len(names))
    one = held.agg(F.sum(w).alias("w"), *[F.sum(w * p[k]).alias(f"t{k}") for k in d], *[F.sum(w * p[i] * p[j]).alias(f"m{i}_{j}") for i in d for j in d if i <= j]).first()
    if not one["w"]:
        return mixture
    scale = sum(given) if len(given) == len(targets) else 1.0
    goal = np.array([one[f"t{k}"] / one["w"] if targets[n] is None else targets[n] / scale for k, n in enumerate(names)])
    moment = np.array([[one[f"m{min(i, j)}_{max(i, j)}"] for j in d] for i in d]) / one["w"]
    inverse = np.linalg.inv(moment + 1e-6 * np.eye(len(names)))
    for _ in range(rounds):
        now = held.select(w.alias("w"), "posterior", mixture.rate(F.col("posterior")).alias("r"))
        got = now.agg(*[F.sum(F.col("r") * F.col("w") * p[k]).alias(f"t{k}") for k in d]).first()
        before, mixture.totals = mixture.totals, np.array([got[f"t{k}"] for k in d]) / one["w"]
        if before is not None and np.abs(mixture.totals - before).max() < tolerance:
            break
        mixture.steps.append(inverse @ (mixture.totals - goal))
    return mixture


def rated(mixture: Mixture, seed: int = 11, nearest: bool = False) -> DataFrame:
    """(row, n_tokens, posterior, rate, copies): the rows a mixture was fitted on, and what it makes of them.

    copies are whole and their expectation is the rate: the fraction is settled by a hash of doc_id, so
    equal ids get equal copies. With nearest they are the rate rounded, halves up. Null and empty texts
    have no tokens; their rate follows from their posteriors like any other's.
    """
    u = F.lit(0.5) if nearest else (F.pmod(F.xxhash64(F.col("row.doc_id"), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))).cast("double")
    return mixture.held.withColumn("rate", mixture.rate(F.col("posterior"))).withColumn("copies", F.floor(F.col("rate") + u).cast("int"))


def with_rates(mixture: Mixture, seed: int = 11, nearest: bool = False) -> DataFrame:
    """The columns a mixture was fitted on with n_tokens, posterior, rate and copies after them.

    Columns keep their places; those they have under the four new names are replaced. Repeated rows
    are treated alike.
    """
    new = ["n_tokens", "posterior", "rate", "copies"]
    old = [c for c in mixture.held.schema["row"].dataType.names if c not in new]
    return rated(mixture, seed, nearest).select(*[F.col("row")[c].alias(c) for c in old], *new)
