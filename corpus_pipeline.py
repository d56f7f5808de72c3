"""Corpus pipeline: stages that turn ``documents`` into a mixed training set.

quality: documents whose perplexity under the trusted text's model is above their language's threshold go.
line_dedup: lines held by three or more documents stay in the one with the largest doc_id.
near_duplicates: of each class of near copies (5-word shingles, Jaccard 0.8) the smallest doc_id stays.
decontamination: documents that leak a benchmark item go.
mixing: rates bring toxic text down to its target weight; documents come with their rate and number of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.decontaminate import drop_leaking
from gleaner.llm.jaccard_join import jaccard_classes
from gleaner.llm.kneser_ney import keep_good
from gleaner.llm.line_dedup import dedup_lines
from gleaner.llm.mixing import label_domains, mix_documents
from gleaner.workspace import Workspace, fresh_name, scope


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh_name("_gone", docs.columns)
    classes = jaccard_classes(docs, n=5, percent=80).filter("doc_id is not null")  # of rows with equal doc_id one is enough to stay
    gone = classes.groupBy(F.col("doc_id").alias(name)).agg(F.bool_and(F.col("component_id") != F.col("doc_id")).alias("gone")).filter("gone").select(name)
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaking(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    domains = label_domains(_table(spark, sf_dir, "labels")).filter("domain <> 'junk'")
    return mix_documents(docs, domains, {"clean": 0.97, "toxic": 0.03})


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]

#: Perplexities, block-max WAND and fitted rates have no SQL form; tests hold the stages to brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's own tables go once its rows are written, and these once the next stage's are."""
    work = Workspace(spark, "pipeline")
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scope():
            docs = work.stash(stage(spark, docs, sf_dir), name)
        if before:
            work.discard(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
