"""Verdicts computed again word by word: anomalies of isolation rules, labels of words in code-switched lines."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm.crf_language import fit_language, predict_language
from ledgerline.llm.isolation_rules import apply_rules, fit_forest

SF = "/root/testdata/sf0.01"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def counts(t):
    """(words, code points in words, symbols, repeated lines, words in repeated windows) of texts of any length."""
    w, t = words(t), t or ""
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    twice = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice)


def rule_rates(t):
    n, chars, symbols, dup, repeats = counts(t)
    w, t = words(t), t or ""
    lines = max(1, sum(bool(words(x)) for x in t.split("\n")))
    upper, lower = (sum(a <= c <= b for c in t) for a, b in ("AZ", "az"))
    some = max(n, 1)
    distinct = math.log(max(len(set(w)), 1)) / max(math.log(some), 1)
    return [symbols / some, t.count("|") / some, t.count("!") / some, upper / max(upper + lower, 1), distinct, repeats / some, dup / lines, chars / some, n / lines]


def anomaly(forest, x):
    total = 0.0
    for feature, cut, left, depth in forest.trees:
        node = 0
        while feature[node] >= 0:
            node = left[node] + int(x[feature[node]] > cut[node])
        total += depth[node]
    n = forest.size
    expected = 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    return 2 ** (-total / len(forest.trees) / expected)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_kept_is_the_forests_verdict(spark, real):
    docs, labels = real
    forest = fit_forest(docs, labels)
    odd = spark.createDataFrame([(10**9 + k, t) for k, t in enumerate([None, "", "a b c d e " * 700, "x! " * 40 + "\n| |\n| |", "É ß 名前\t" * 30, "one two three four five six seven eight nine ten eleven " + "Z" * 50_000])], "doc_id long, text string")
    rows = apply_rules(docs.select("doc_id", "text").union(odd), forest).collect()
    verdicts = set()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.text)
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        score = anomaly(forest, rule_rates(r.text))
        assert math.isclose(r.anomaly, score, rel_tol=1e-9), r.doc_id
        assert (r.base_failed, r.kept) == (failed, not failed and r.anomaly <= forest.threshold)
        verdicts.add((r.base_failed, r.kept))
    assert verdicts == {(True, False), (False, False), (False, True)} and len(rows) == docs.count() + 6


def test_threshold_loses_few_good_ones(spark, real):
    docs, labels = real
    forest = fit_forest(docs, labels)
    good = docs.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id")
    passed = apply_rules(good, forest).where("not base_failed")
    lost, n = passed.where("not kept").count(), passed.count()
    assert lost <= 0.002 * n + 1


def test_words_of_code_switched_lines(spark, real):
    docs = real[0].where("lang is not null and text is not null")
    learn, held = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0), docs
    model = fit_language(learn)
    texts = {}
    for r in held.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
            texts.setdefault(r.lang, []).append([w for w in words(r.text) if w.isalpha()])
    rng, lines, truth = random.Random(11), [], []
    for _ in range(400):
        line, langs = [], rng.sample(sorted(texts), 3)
        for lang in langs:
            source = rng.choice([t for t in texts[lang] if len(t) >= 20])
            at, n = rng.randrange(len(source) - 12), rng.randint(6, 12)
            line += source[at : at + n]
            truth += [lang] * n
        lines.append(" ".join(line))
    raw = [x.encode() for x in lines]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    _, post = model.label_words(offsets, np.frombuffer(b"".join(raw), np.uint8))
    assert post.shape == (len(truth), len(model.labels)) and np.allclose(post.sum(1), 1)
    right = np.array([model.labels[k] for k in post.argmax(1)]) == np.array(truth)
    assert right.mean() >= 0.9, right.mean()
    # a line's label is that of most of its letters
    told = predict_language(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    start = 0
    agreed = 0
    for r, line in zip(told, lines, strict=True):
        w = words(line)
        letters = Counter()
        for word, lang in zip(w, truth[start : start + len(w)], strict=True):
            letters[lang] += len(word)
        start += len(w)
        agreed += letters[r.lang_pred] >= 0.8 * max(letters.values())
    assert agreed >= 0.9 * len(lines)
