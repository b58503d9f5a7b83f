"""The registered queries: each applies one operator with its production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinpanel.llm import ann, chosenpath, gru, mixing, paragraphs, pii, prefixtrie, quality, spelling, sql, suffixes, toxicity, warc, wumanber
from kinpanel.llm.common import table
from kinpanel.llm.registry import ORACLES, QUERIES, query
from kinpanel.session import scratch_path

__all__ = ["ORACLES", "QUERIES"]


@query("op5_pareto_mix", sql.MIX.format(docs="documents"))
def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op9_decontaminate", sql.CONTAMINATION.format(docs="documents"))
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wumanber.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_warc", sql.WARC)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    records = warc.read_records(spark, path)
    return records.select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        warc.page_of("refers_to").alias("refers_to"))


@query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = gru.train(docs, F.col("doc_id").isNotNull() & ~gru.fold(3, 1))
    found = gru.identify(docs.select("doc_id", gru.fold(3, 1).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~gru.fold(5, 0))
    found = toxicity.score(docs.select("doc_id", gru.fold(5, 0).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", F.col("toxicity").alias("score"),
                        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.score(docs, quality.train(docs))
    return found.select("doc_id", "weak_label", F.col("quality_score").alias("score"),
                        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


@query("op1_nearest")
def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter("vec_id % 100 = 0"))


@query("op6_near_duplicates", sql.NEAR.format(docs="documents", width=3, percent=85))
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chosenpath.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op8_repeated_passages")
def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.removed(table(spark, sf_dir, "documents"), whole=True)


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(table(spark, sf_dir, "documents"))


@query("op11_prefix_trie", sql.TRIE)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


@query("op12_spelling_variants", sql.SPELLING)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op13_personal_data")
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))
