"""Texts longer than every block size: each stands alone and is worked on whole."""

import hashlib
import zlib

import numpy as np
import pytest

from ledgerline.llm.block_substring import remove_repeats
from ledgerline.llm.crf_language import fit_language, predict_language
from ledgerline.llm.encode import Encoder
from ledgerline.llm.huffman_ids import read_ids, write_ids
from ledgerline.llm.common import Scratch
from ledgerline.llm.isolation_rules import Forest, apply_rules
from ledgerline.llm.mixing import fit_mixture, with_rates
from ledgerline.llm.ngram_jaccard import similarity_components
from ledgerline.llm.queries import tokenizer_path
from ledgerline.llm.rule_quality import fit_quality, score_quality

WORDS = [f"w{i * 7919 % 1_000_003}" for i in range(600_000)]  # all different, over 4 MB


@pytest.fixture(scope="module")
def long_docs(spark):
    text = " ".join(WORDS)
    assert len(text) > 4 << 20
    rows = [(1, text, "en"), (2, "a few words before " + " ".join(WORDS[300_000:300_040]) + " and after", "en"), (3, text + " end", "de"), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_passages(long_docs):
    got = {r.doc_id: r for r in remove_repeats(long_docs).collect()}
    assert [(got[k].n_words, got[k].n_removed) for k in (1, 2, 3, 4)] == [(600_000, 0), (46, 40), (600_001, 600_000), (0, 0)]
    assert got[3].kept_sha256 == hashlib.sha256(b"end").hexdigest()


def test_links(long_docs):
    got = sorted(map(tuple, similarity_components(long_docs).collect()))
    assert got == [(1, 599_998, 1), (2, 44, 2), (3, 599_999, 1), (4, 0, 4)]


def test_ids(spark, long_docs):
    path, name = Scratch(spark).path("long"), tokenizer_path("byte_bpe_50k.json")
    write_ids(long_docs, path, name)
    e, start = Encoder.at(name), 0
    texts = {r.doc_id: r.text for r in long_docs.collect()}
    for r in read_ids(spark, path).drop("ids").orderBy("doc_id").collect():
        ids = np.array([*e.tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_scores(spark, long_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in score_quality(long_docs, fit_quality(long_docs, labels)).collect())
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_repeat_words, r.kept) for r in apply_rules(long_docs, Forest()).collect()}
    assert got[1] == (600_000, sum(map(len, WORDS)), 0, True) and got[4] == (0, 0, 0, False)


def test_language_and_mixture(spark, long_docs):
    got = predict_language(long_docs, fit_language(long_docs)).collect()
    assert {r.lang_pred for r in got if r.doc_id < 4} <= {"en", "de"} and all(0 <= r.score <= 1 for r in got)
    labels = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, domain string")
    rated = {r.doc_id: r.n_tokens for r in with_rates(fit_mixture(long_docs, labels, {"a": 1.0, "b": 1.0})).collect()}
    assert rated == {1: 600_000, 2: 46, 3: 600_001, 4: 0}
