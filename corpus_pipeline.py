"""The training-data pipeline: language identification, near-dedup, substring dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, which has the columns of ``documents``
(doc_id, text, lang, source, n_chars; further columns pass through but for the last stage). Stages that change a text set
``n_chars`` to its new length. Nulls, empty texts, repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinpanel.llm import chosenpath, gru, mixing, paragraphs, wumanber
from kinpanel.llm.common import table
from kinpanel.session import checkpointed, own_stages, scratch_path

#: documents whose likeliest language is less likely than so many times an even share are rejected
LEAST_LIFT = 1.1
#: near-duplicates have this similarity, in percent, of their sets of five-word shingles
WIDTH, PERCENT = 5, 80


def packed(docs: DataFrame) -> DataFrame:
    """text, and the other columns as one, so that none of them can be taken for one of an operator."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def unpacked(found: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns again, with some of them replaced."""
    return found.select(*[new[c].alias(c) if c in new else F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; the predicted one replaces ``lang`` where that is null."""
    model = gru.train(docs)
    least = LEAST_LIFT / len(model.labels) if len(model.labels) > 1 else 0.0
    found = gru.identify(packed(docs), model).filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= least))
    return unpacked(found, docs.columns, lang=F.coalesce(F.col("row.lang"), F.col("lang_pred")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id (null last), one row of it.

    Documents without words are in no group and stay, as often as they stand.
    """
    found = checkpointed(chosenpath.near_duplicates(docs, WIDTH, PERCENT))
    gone = found.filter(~F.col("chosen")).select(F.col("doc_id").alias("__id"), F.col("stamp").alias("__stamp")).distinct()
    again = found.filter("chosen AND n_shingles > 0").groupBy("doc_id", "stamp").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = docs.withColumn("__at", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__at") == F.col("__stamp"))
    left = keyed.join(gone, same, "left_anti")
    # only rows that repeat a document that stays are moved to find one of each
    again = checkpointed(again.select(F.col("doc_id").alias("__id"), F.col("stamp").alias("__stamp")))
    once = left.join(again, same, "left_anti")
    return once.unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "__at"])).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand elsewhere; documents of which no word is left go."""
    cut = paragraphs.without_repeats(docs, PERCENT, whole=True)
    cut = cut.filter(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in a benchmark item."""
    found = wumanber.decontaminate(packed(docs), table(spark, sf_dir, "benchmark"))
    return unpacked(found.filter(~wumanber.contaminated()), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, size, source_size, target, copies, taken for every document."""
    return mixing.mix(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("decontaminate", decontaminate), ("mix", mix)]

#: trained models and hash-based sampling of paragraphs are beyond SQL; tests/llm compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage wrote on its way is deleted after it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with own_stages(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
