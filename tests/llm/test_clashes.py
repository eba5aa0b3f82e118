"""Every operator and every stage on rows whose columns have the names that are used inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm.block_substring import drop_repeats
from ledgerline.llm.crf_language import fit_language, predict_language
from ledgerline.llm.external_shuffle import write_shards
from ledgerline.llm.common import Scratch
from ledgerline.llm.fill_middle import fill_in_middle
from ledgerline.llm.isolation_rules import Forest, apply_rules
from ledgerline.llm.mixing import fit_mixture, rated
from ledgerline.llm.ngram_jaccard import keep_one, similarity_components
from ledgerline.llm.rule_quality import RuleModel, score_quality

NAMES = ["_0", "_1", "_rules", "_rule_stats", "_lang", "_quality_score", "_quality", "row", "x", "s", "grp", "at", "told", "units", "bucket", "key", "component", "rep", "a", "b", "v", "posterior", "text_", "chunk_id", "ids", "data", "extra", "copies", "A.b"]


@pytest.fixture(scope="module")
def odd(spark, texts):
    rows = [(d, t, None if i % 3 else "en", "s", len(t or ""), *[f"{n}{i}" for n in NAMES]) for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"`{n}` string" for n in NAMES]])).repartition(3)


def told(df, columns):
    return sorted(repr(tuple(r)) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect())


OPERATORS = {
    "score_quality": lambda d: score_quality(d, RuleModel(0.1)).drop("score"),
    "apply_rules": lambda d: apply_rules(d, Forest()).select(*[F.col(f"`{c}`") for c in d.columns]),
    "predict_language": lambda d: predict_language(d, fit_language(d.select("doc_id", "text", "lang"))).drop("lang_pred", "score"),
    "fill_in_middle": lambda d: fill_in_middle(d).select("row.*"),
    "write_shards": lambda d: write_shards(d, Scratch(d.sparkSession).path("s"), 3).select("row.*"),
    "mixing": lambda d: rated(fit_mixture(d, d.sparkSession.createDataFrame([(8, "x"), (12, "y")], "doc_id long, domain string"), {"x": None, "y": None}, most=1.0), nearest=True).select("row.*"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_stay(odd, name):
    got = OPERATORS[name](odd)
    assert sorted(got.columns) == sorted(odd.columns) and told(got, odd.columns) == told(odd, odd.columns)


def test_rows_that_stay_are_whole(odd):
    others = [c for c in odd.columns if c not in ("text", "n_chars")]
    every = set(told(odd, others))
    for made in (keep_one(odd), drop_repeats(odd)):
        assert made.columns == odd.columns and 5 < made.count() <= odd.count() and set(told(made, others)) <= every


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, odd, tmp_path, name, empty):
    """Null, empty and repeated rows, clashing columns, and none at all."""
    spark.createDataFrame([(8, 1, 0), (4, 0, 0), (12, 1, 0), (17, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd.limit(0) if empty else odd
    made = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    if name == "packing":
        assert made.select("doc_id", "start").distinct().count() <= made.count() and (made.count() == 0) == empty
        assert empty or sum(r.length for r in made.collect()) >= odd.count()
        return
    assert made.columns == odd.columns and made.dtypes == odd.dtypes
    others = [c for c in odd.columns if c not in ("text", "n_chars")]
    assert set(told(made, others)) <= set(told(docs, others))


def test_an_id_with_several_texts_is_one_node(spark):
    rows = [(2, "a b c d"), (5, "a b c d"), (3, "e f g h"), (5, "e f g h"), (9, "i j k l"), (9, "m n o p"), (11, "m n o p"), (12, "q r s t")]
    got = similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (3, 2), (5, 2), (5, 2), (9, 9), (9, 9), (11, 9), (12, 12)]
