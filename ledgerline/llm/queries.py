"""Queries that apply the training-data operators to the whole tables, and their SQL where it can be written."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import Scratch, read


def tokenizer_path(name: str) -> str:
    """A public tokenizer file; TOKENIZER_DIR points elsewhere if it is set."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_examples

    return pack_examples(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as instruction data: an example is an answer with all turns since the last one as its prompt."""
    from .packing import answers, pack_examples

    return pack_examples(answers(read(spark, sf_dir, "conversations")), tokenizer_path("word_bpe_49k.json"), max_segments=12, max_loss=1024, prompt="prompt")


def _crc(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rule_quality import fit_quality, score_quality

    docs = read(spark, sf_dir, "documents")
    model = fit_quality(docs, read(spark, sf_dir, "labels").where(_crc() % 4 != 2))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(_crc() % 4 == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_divide_skip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_jaccard import similarity_components

    return similarity_components(read(spark, sf_dir, "documents"))


def op4_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .block_substring import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept_text")


#: Shares of tokens that the mixture aims at.
MIX_TARGETS = {"clean": 0.90, "poor": 0.07, "toxic": 0.03}


def domain_labels(labels: DataFrame) -> DataFrame:
    """The labelled table's domains: toxic, else poor or clean by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import fit_mixture, with_rates

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    mixture = fit_mixture(docs, domain_labels(read(spark, sf_dir, "labels")), MIX_TARGETS, keep=["doc_id"])
    rated = with_rates(mixture)
    posteriors = [F.col("posterior")[k].alias(f"p_{n}") for k, n in enumerate(MIX_TARGETS)]
    return rated.select("doc_id", "n_tokens", *posteriors, "rate", "copies")


def op8_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .isolation_rules import BASE, apply_rules, fit_forest

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    forest = fit_forest(docs, read(spark, sf_dir, "labels"))
    return apply_rules(docs, forest).select("doc_id", *BASE, "base_failed", "kept")


def op10_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crf_language import fit_language, predict_language

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs.where(_crc() % 5 != 0))
    found = predict_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(_crc() % 5 == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pq_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .huffman_ids import read_ids, write_ids

    path = Scratch(spark).path("huffman")
    write_ids(read(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return read_ids(spark, path).drop("ids")


def op1_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bwt_dedup import remove_repeated_bytes

    return remove_repeated_bytes(read(spark, sf_dir, "documents")).drop("kept")


def op11_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .external_shuffle import text_size, write_shards

    shards = write_shards(read(spark, sf_dir, "documents"), Scratch(spark).path("shards"), n_shards=24, seed=42)
    text = F.col("row.text")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    return shards.select("row.doc_id", text_size(text).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_array_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle_manifest import FIELDS, build_manifest, leaf_digest

    docs = read(spark, sf_dir, "documents")
    lowered = F.when(_crc() % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    claim = leaf_digest([lowered if c == "text" else F.col(c) for c in FIELDS])
    return build_manifest(docs, claim=claim).proofs().withColumnRenamed("id", "doc_id")


def op13_lookaround_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_in_middle, restore

    made = fill_in_middle(read(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op2_vector_packing, op7_rule_ensemble, op9_divide_skip_join, op4_block_anchors, op5_soft_mixing, op8_isolation_rules, op10_crf_language, op3_product_quantisation, op6_huffman_ids, op1_bwt_merge, op11_two_pass_shuffle, op12_array_levels, op13_lookaround_split, pack_conversations)}
ORACLES: dict[str, str] = {"op1_bwt_merge": oracles.OP1, "op3_product_quantisation": oracles.OP3, "op4_block_anchors": oracles.OP4, "op9_divide_skip_join": oracles.OP9, "op12_array_levels": oracles.OP12, "op13_lookaround_split": oracles.OP13}
