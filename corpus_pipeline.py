"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and returns all that it keeps; all but the last return the columns of documents.
Verdicts and redactions go by a row's own id and text, so that null ids, repeated ids and repeated rows are told apart; extra
columns pass through, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import op1_quality_rules, op3_jaccard_join, op6_secrets, op7_packing, op8_importance
from seqloom.llm.common import labels, row_key, shared_folder, text_or_empty, unused

#: near_duplicates links texts by runs of so many words, at this Jaccard in percent; op3's query has its own.
WORDS, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject."""
    return op1_quality_rules.keep(docs, op1_quality_rules.fit(docs, labels(spark, sf_dir)))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects."""
    return op8_importance.keep(docs, labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts one row: of the smallest id, or without an id where no row has one.

    Texts are linked by themselves, not by their ids: unrelated texts of one id, or of no id, are groups of their own. A
    text without words links with nothing, so each id keeps it.
    """
    key, digest = unused(docs, "_key"), unused(docs, "_digest")
    rows = docs.withColumn(key, row_key("doc_id", "text")).withColumn(digest, F.unhex(F.md5(text_or_empty("text"))))
    found = op3_jaccard_join.groups(rows.select(digest, "text"), id_col=digest, width=WORDS, percent=PERCENT).distinct()
    each = rows.select(F.col("doc_id").alias("_id"), F.col(key).alias("_row"), digest).distinct().join(found, digest)
    stays = each.groupBy("component_id", F.when(F.col("n_shingles") == 0, F.col("_id")).alias("_own")).agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_m")).select(F.col("_m._row").alias(key))
    return rows.join(stays, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by the names of their kinds, and n_chars to match."""
    key, marks = unused(docs, "_key"), unused(docs, "_marks")
    rows = docs.withColumn(key, row_key("doc_id", "text"))
    found = op6_secrets.scan(rows, id_col=key).where("spans <> ''").select(key, F.col("spans").alias(marks)).dropDuplicates([key])
    text = F.when(F.col(marks).isNull(), F.col("text")).otherwise(op6_secrets.redacted(text_or_empty("text"), F.col(marks)))
    marked = rows.join(found, key, "left")
    return marked.withColumn("text", text).withColumn("n_chars", F.when(F.col(marks).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in the sequences."""
    return op7_packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]
#: Learned decisions are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
