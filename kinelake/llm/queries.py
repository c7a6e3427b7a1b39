"""The queries op1 to op13 over whole tables, with production parameters, and their SQL where SQL can express them; tests/llm holds the rest against libraries, brute force and held-out rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, centroids, decontamination, language, licenses, neardup, neighbours, packing, repeats, telephony, toxicity, urls
from .common import table

#: Host, path and verdict of the rules.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and what they decode to, as digests."""
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and license templates of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page, and the trees' probability of block."""
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.selectExpr("page_id", "url_host as host", "url_path as path", "url_rule as rule", "verdict", "block_score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the rows that are not held out."""
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op6_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as stored telephony audio, read back, and its resampled PCM."""
    return telephony.digest(table(spark, sf_dir, "documents"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 200-byte strings that stand elsewhere too, as digests."""
    cut = repeats.cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.selectExpr("doc_id", "repeat_bytes as n_bytes", "repeat_removed as n_removed", "repeat_spans as n_spans", "repeat_sha256 as kept_sha256")


def op8_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth id."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three words a shingle, 85 percent."""
    return neardup.group(table(spark, sf_dir, "documents"), k=3, percent=85).selectExpr("doc_id", "n_shingles", "component_id", "coalesce(doc_id = component_id, false) as kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    return language.held_out_predictions(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that stand in ten consecutive words of a benchmark item, and those items."""
    return decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every vector after five rounds of 40 centroids."""
    return centroids.digest(table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers on every document, with corpus-wide counts."""
    return alignment.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_license_scan, op3_url_filter, op4_toxicity, op5_best_fit_packing, op6_telephony_audio, op7_suffix_array, op8_collision_counting, op9_minhash_forest, op10_language_id, op11_decontamination, op12_centroids, op13_alignment)}
ORACLES = {"op2_license_scan": licenses.scan_sql(), "op7_suffix_array": repeats.cut_sql(), "op9_minhash_forest": neardup.group_sql(3, 85), "op11_decontamination": decontamination.scan_sql(), "op12_centroids": centroids.digest_sql()}
