"""Classifiers, rules, language and mixture: edge cases on fixtures, accuracy on held-out rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import queries as q
from ledgerline.llm.crf_language import fit_language, predict_language
from ledgerline.llm.docstats import stats_column
from ledgerline.llm.isolation_rules import apply_rules, fit_forest
from ledgerline.llm.mixing import fit_mixture, with_rates
from ledgerline.llm.rule_quality import fit_quality, score_quality

SF = "/root/testdata/sf0.01"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_counts(t):
    w, t = words(t), t or ""
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {i + k for i, x in enumerate(windows) if Counter(windows)[x] > 1 for k in range(5)} if len(w) < 500 else None
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, None if twice is None else len(twice)


def test_counts(docs, texts):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = docs.drop("n_words").select("text", stats_column("text").alias("s")).select("text", "s.*").collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_counts(r.text)
        assert tuple(r[c] for c in cols[:4]) == want[:4]
        assert want[4] is None or r.n_repeat_words == want[4]


@pytest.fixture(scope="module")
def real(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([(8, 1), (15, 0), (9, None), (None, 1)], "doc_id long, quality int")
    for rows in (labels, labels.limit(0), labels.where("quality = 1")):
        out = score_quality(docs, fit_quality(docs, rows), "score").select("score").collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert score_quality(no_docs, fit_quality(no_docs, labels)).count() == 0


def test_quality_held_out(spark, real):
    got = q.op7_rule_ensemble(spark, SF).join(real[1], "doc_id").where("held_out").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got) > 50


def test_rules_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([(8, 1), (12, 1), (15, 0), (9, None)], "doc_id long, quality int")
    out = apply_rules(docs, fit_forest(docs, labels))
    rows = {(r.doc_id, r.text): r for r in out.collect()}
    assert rows[(1, None)].base_failed and not rows[(1, None)].kept and rows[(8, dict_text(docs, 8))].n_words == 80
    assert rows[(15, "a " * 200)].base_failed
    assert apply_rules(no_docs, fit_forest(no_docs, labels)).count() == 0
    assert apply_rules(docs, fit_forest(docs, labels.limit(0))).where("not base_failed and not kept").count() == 0


def dict_text(docs, k):
    return docs.where(F.col("doc_id") == k).first().text


def test_rules_held_out(spark, real):
    got = q.op8_isolation_rules(spark, SF).join(real[1], "doc_id").where("not base_failed").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_language_edges(spark, docs, no_docs):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 — !!"), (4, "the dog"), (5, "名前"), (6, "und die")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict_language(odd, fit_language(train)).collect()}
    assert [got[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[4][0] == "en" and got[6][0] == "de" and got[5][0] in ("de", "en") and all(0 <= s <= 1 for _, s in got.values())
    assert predict_language(odd, fit_language(train.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert predict_language(no_docs, fit_language(train)).count() == 0
    assert predict_language(docs, fit_language(train)).count() == docs.count()


def test_language_held_out(spark, real):
    got = q.op10_crf_language(spark, SF).join(real[0].select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got) > 100
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_mixture_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([(8, "a"), (12, "a"), (15, "b"), (17, "b"), (19, None), (None, "a")], "doc_id long, domain string")
    for rows, target in ((labels, {"a": 0.5, "b": 0.5}), (labels.limit(0), {"a": 1.0, "b": 0.0})):
        out = with_rates(fit_mixture(docs, rows, target)).collect()
        assert len(out) == docs.count() and all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in out)
    assert with_rates(fit_mixture(no_docs, labels, {"a": 1.0, "b": 1.0})).count() == 0
    with pytest.raises(ValueError):
        fit_mixture(docs, labels, {"a": -1.0})


def test_mixture_keeps_clashing_columns(spark, docs):
    odd = docs.withColumnsRenamed({"lang": "row", "source": "words", "kept": "f"}).withColumn("e", F.lit(1)).withColumn("rate", F.lit("x"))
    labels = spark.createDataFrame([(8, "a"), (12, "a"), (15, "b"), (17, "b")], "doc_id long, domain string")
    out = with_rates(fit_mixture(odd, labels, {"a": 1.0, "b": 1.0}))
    assert out.columns == [c for c in odd.columns if c != "rate"] + ["n_tokens", "posterior", "rate", "copies"]
    assert {(r.row, r.words, r.f, r.e) for r in out.collect()} == {("en", "s", "k", 1)}


def test_rates_against_numpy(spark, real):
    """Posteriors and rates again in numpy, from the features of the rows."""
    docs = real[0].select("doc_id", "text")
    mixture = fit_mixture(docs, q.domain_labels(real[1]), q.MIX_TARGETS)
    d, w = mixture.domains, mixture.domains.weights
    x, tokens, want = [], [], []
    for r in with_rates(mixture).collect():
        t = r.text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        n = max(1, len(ws))
        f = [1.0, math.log1p(len(ws)), len(t) / n, len(re.findall("[A-Z]", t)) / max(1, len(t)), len(re.findall(r"[#*$%&|<>!]", t)) / n, len(set(ws)) / n]
        for name in d.names:
            hits = len(set(ws) & set(d.lexicon.get(name) or ()))
            f += [min(hits, 1), math.log1p(hits)] if d.lexicon.get(name) else []
        x.append(f)
        tokens.append(len(ws))
        want.append((r.posterior, r.rate, r.n_tokens, r.copies))
    s = np.array(x) @ w.T
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    assert np.allclose(p, [v[0] for v in want], atol=1e-9) and tokens == [v[2] for v in want]
    share, rate = np.array(tokens) / sum(tokens), np.ones(len(p))
    goal = np.array([q.MIX_TARGETS[n] for n in d.names]) / sum(q.MIX_TARGETS.values())
    inverse = np.linalg.inv((share[:, None] * p).T @ p + 1e-6 * np.eye(len(d.names)))
    for _ in mixture.steps:
        z = inverse @ (p.T @ (share * rate) - goal)
        rate = np.maximum(0, rate - (0.01 * (rate - 1) + p @ z) / 1.01)
    assert np.allclose(rate, [v[1] for v in want], atol=1e-6)
    assert all(v[3] in (math.floor(v[1]), math.floor(v[1]) + 1) for v in want)


def test_texts_are_split_once(spark):
    """The pipeline's mixture filters on copies without computing posteriors again."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = p.mixture(spark, docs, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "posterior" in plan


def test_mixture_meets_targets(spark):
    rows = q.op5_soft_mixing(spark, SF)
    share = {n: F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{n}")) / F.sum("n_tokens") for n in q.MIX_TARGETS}
    got = rows.agg(*[c.alias(n) for n, c in share.items()]).first()
    assert all(abs(got[n] - t) < 0.01 for n, t in q.MIX_TARGETS.items())


def test_mixture_plan_is_native(spark):
    plan = q.op5_soft_mixing(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "passages", "mixture", "packing"]
    kept = p.quality(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert kept.columns == docs.columns and kept.join(labels, "doc_id").where("quality = 0").count() == 0
    assert kept.join(labels, "doc_id").where("quality = 1").count() == labels.where("quality = 1").count()
    pieces = p.run(spark, SF)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
