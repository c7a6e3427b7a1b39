"""The corpus pipeline: five stages over documents, each written and read again as the next one's input.

Documents without letters, or without a language that holds half of their letters, go; toxic documents go; of each group of
near-duplicates the document with the least id stays; repeated byte strings are cut; what is left is packed. The last stage returns a row for each piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import language, neardup, packing, repeats, toxicity
from kinelake.llm.common import free, stored, table

#: Share of the letters that the main language must hold.
LEAST_SHARE = 0.5
#: Near-duplicates: words of a shingle, and percent of the union that two documents share.
SHINGLE, PERCENT = 5, 80


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; learned from these documents' own lang column. Null texts and texts without letters go."""
    prefix = "stage_" if not any(c.startswith("stage_") for c in docs.columns) else free(docs.columns, max(docs.columns, key=len) + "_")
    made = language.identify(docs, language.fit(docs), prefix=prefix)
    return made.where((F.col(f"{prefix}lang_pred") != "und") & (F.col(f"{prefix}score") >= LEAST_SHARE)).select(docs.columns)


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learned from the labels of documents that are left."""
    model, out = toxicity.fit(docs, table(spark, sf_dir, "labels")), free(docs.columns, "stage_score")
    return toxicity.score(docs, model, out=out).where(F.col(out) < toxicity.THRESHOLD).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group (null ids last); rows that share id and text count once. Documents without words stay."""
    groups = neardup.group(docs, SHINGLE, PERCENT).select("root", F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key").alias("row"))
    least = groups.where("root is not null").groupBy("root").agg(F.min("row").alias("row"))  # combined before the shuffle, so a large group is no load
    kept = least.select("row").union(groups.where("root is null").select("row")).select("row.doc_id", "row.text_key")
    kept_id, kept_key, key = (free(docs.columns, x) for x in ("kept_id", "kept_key", "stage_key"))
    kept = kept.select(F.col("doc_id").alias(kept_id), F.col("text_key").alias(kept_key))
    rows = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key)), "left_semi")
    return rows.dropDuplicates(["doc_id", key]).select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated byte strings; n_chars is that of the kept text, and documents of which nothing is left go."""
    cut = repeats.cut(docs)
    return cut.where("text is null or repeat_bytes = 0 or repeat_removed < repeat_bytes").withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and place."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language_id", by_language), ("toxicity", by_toxicity), ("minhash_near_dedup", one_of_each), ("suffix_array_dedup", without_repeats), ("best_fit_packing", packed)]

#: Trained models, sketches and a suffix sort: SQL can't express the stages. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again: a row for each piece of each kept document."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
