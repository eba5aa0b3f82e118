"""Models and packing against plain computations of the same thing."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import crf_language as crf
from ledgerline.llm import queries as q
from ledgerline.llm.docstats import stats_column
from ledgerline.llm.encode import Encoder
from ledgerline.llm.isolation_rules import apply_rules, fit_forest
from ledgerline.llm.packing import answers, pack_examples
from ledgerline.llm.queries import tokenizer_path
from ledgerline.llm.rule_quality import FEATURES, fit_quality, score_quality

SF = "/root/testdata/sf0.01"


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(2)
    k, first, size = 3, np.array([0, 4, 5]), np.array([4, 1, 3])
    emit, trans, start = rng.normal(size=(8, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    want, pairs = np.zeros((8, k)), np.zeros((k, k))
    for f, s in zip(first, size, strict=True):
        paths = list(itertools.product(range(k), repeat=int(s)))
        score = np.array([start[p[0]] + sum(emit[f + i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
        weight = np.exp(score - score.max())
        weight /= weight.sum()
        for p, w in zip(paths, weight, strict=True):
            for i, y in enumerate(p):
                want[f + i, y] += w
            for a, b in zip(p, p[1:], strict=False):
                pairs[a, b] += w
    post, both = crf.forward_backward(emit, trans, start, first, size, True)
    assert np.allclose(post, want) and np.allclose(both, pairs)


def test_long_lines_keep_their_context(monkeypatch):
    """Pieces of a long line give what the whole line gives."""
    rng = np.random.default_rng(4)
    model = crf.LanguageField.blank(["a", "b"])
    model.weights[:] = rng.normal(size=model.weights.shape) / 4
    model.trans[:] = [[1.5, -1.5], [-1.5, 1.5]]
    text = " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(900)).encode()
    offsets, data = np.array([0, len(text)]), np.frombuffer(text, np.uint8)
    pieces = model.label_words(offsets, data)[1]
    monkeypatch.setattr(crf, "CHAIN", 10_000)
    assert np.abs(pieces - model.label_words(offsets, data)[1]).max() < 1e-4


def test_languages_are_not_cut(spark):
    """Each of 40 languages is learned; more than the stated number is an error."""
    rows = [(10 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in ("que", "sta", "mor")) * 3, f"l{k:02d}") for k in range(40) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(crf.fit_language(df, max_docs=400).labels) == 40
    with pytest.raises(ValueError):
        crf.fit_language(df, max_labels=39)


def test_rules_compile_to_the_model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels)
    rows = score_quality(docs, model).withColumn("s", stats_column("text")).select("score", *[f(F.col("s")).alias(n) for n, f in FEATURES.items()]).toPandas()
    total = np.full(len(rows), model.bias)
    for conditions, weight in model.rules:
        hold = np.logical_and.reduce([(rows[n] > t) if above else (rows[n] <= t) for n, above, t in conditions])
        total += weight * hold
    assert len(model.rules) > 1 and np.allclose(rows["score"], 1 / (1 + np.exp(-total)))


def test_anomalies_held_out(spark):
    """Forest and threshold come from other rows than those judged."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = apply_rules(docs, fit_forest(docs, labels.where(~held))).join(labels.where(held), "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in got if r.quality == k] for k in (1, 0))
    assert sum(good) >= 0.97 * len(good) > 50 and sum(bad) <= 0.3 * len(bad)


@pytest.mark.parametrize(("segments", "loss", "prompt"), [(256, None, None), (4, 600, "source")])
def test_packing_places_each_id_once(spark, texts, segments, loss, prompt):
    rows = [(k, t, "a few words of prompt") for k, (_, t) in enumerate(texts * 3)]
    rows[0] = (0, " ".join(str(i) for i in range(400_000)), "a few words of prompt")  # over 2 MB
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    name = tokenizer_path("word_bpe_49k.json")
    e, pieces = Encoder.at(name), defaultdict(list)
    for r in pack_examples(docs, name, max_segments=segments, max_loss=loss, prompt=prompt).collect():
        pieces[r.doc_id].append(r)
    assert sorted(pieces) == list(range(len(rows)))
    for d, t, p in rows:
        lead = e.tokenizer.encode(p, add_special_tokens=False).ids if prompt else []
        ids = np.array([*lead, *e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.loss_tokens == r.length - max(0, min(r.length, len(lead) - at))
            at += r.length
        assert at == len(ids)


def test_conversations_bind_all_limits(spark):
    rows = q.pack_conversations(spark, SF).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.sum("loss_tokens").alias("loss")).collect()
    assert all(r.n <= 2048 and r.k <= 12 and r.loss <= 1024 for r in rows)
    assert any(r.k == 12 for r in rows)


def test_each_limit_binds(spark):
    """One kind of example for each limit, of which that limit alone ends sequences."""
    shapes = {"n": ("a b c d " * 40, "x", 2048, 512, 1024), "k": ("a", "b", 2048, 8, 1024), "loss": ("a", "b c d e f g h i " * 20, 2048, 512, 300)}
    for which, (prompt, text, tokens, segments, loss) in shapes.items():
        docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(prompt).alias("prompt"), F.lit(text).alias("text")).coalesce(1)
        made = pack_examples(docs, q.tokenizer_path("word_bpe_49k.json"), max_tokens=tokens, max_segments=segments, max_loss=loss, prompt="prompt")
        rows = made.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.sum("loss_tokens").alias("loss")).orderBy("sequence_id").collect()[:-1]
        most = {"n": tokens, "k": segments, "loss": loss}
        assert len(rows) > 2 and all(r[which] == most[which] for r in rows)
        assert all(r[other] < most[other] for r in rows for other in most if other != which)


def test_answers_keep_their_prompts(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", None), (1, 4, "user", "v"), (1, 5, "assistant", "b"), (1, 6, "user", "w"), (2, 0, "assistant", "c"), (2, 1, None, "x"), (3, 0, "user", "y")]
    got = sorted(map(tuple, answers(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)).collect()))
    assert got == [(1_000_002, "s\nu", "a"), (1_000_005, "\nv", "b"), (1_000_006, "w", None), (2_000_000, "", "c"), (2_000_001, "x", None), (3_000_000, "y", None)]
    assert answers(spark.createDataFrame(rows[:0], "conv_id long, turn int, role string, text string")).count() == 0
