"""Corpus pipeline: quality, near duplicates, repeated passages, mixture, packing.

Each stage takes what the one before kept and returns the columns of documents, the last one the
pieces of packed sequences. Near duplicates share four fifths of their five-word shingles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.block_substring import drop_repeats
from ledgerline.llm.common import Scratch, columns_of, fresh, read
from ledgerline.llm.mixing import fit_mixture, rated
from ledgerline.llm.ngram_jaccard import keep_one
from ledgerline.llm.packing import pack_examples
from ledgerline.llm.queries import domain_labels, tokenizer_path
from ledgerline.llm.rule_quality import fit_quality, score_quality

#: Token totals that the mixture stage aims at: of clean text what there is, of toxic text none.
TARGETS = {"clean": None, "toxic": 0.0}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.7 or more.

    Null and empty texts are scored by their zero statistics; equal rows are kept or dropped together; all
    columns stay, whatever their names; an empty table stays empty.
    """
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    score = fresh("_quality_score", docs.columns)
    return score_quality(docs, model, score).where(F.col(score) >= 0.7).select(*columns_of(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id.

    Null, empty and wordless texts and rows with a null doc_id have no duplicates and stay; rows that share
    the kept doc_id all stay; columns of any name stay; an empty table stays empty.
    """
    return keep_one(docs, ratio=80, k=5)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words or more that a document with a smaller doc_id has.

    Null and empty texts stay as they are (null as empty); a row that loses all its words goes; rows that
    share a doc_id keep what only they share; n_chars is counted anew; an empty table stays empty.
    """
    return drop_repeats(docs, window=13)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rate is at least a half; none is repeated, as that would undo the stages before.

    Columns of any name stay as they are; texts without words get the rate of their posteriors; equal
    rows are kept or dropped together; an empty table stays empty.
    """
    fitted = fit_mixture(docs, domain_labels(read(spark, sf_dir, "labels")), TARGETS, most=1.0)
    return rated(fitted, nearest=True).where("copies > 0").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens.

    Null and empty texts are their end id alone; repeated rows are packed each; other columns are ignored;
    an empty table gives no rows.
    """
    return pack_examples(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("mixture", mixture), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each written and read again."""
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
