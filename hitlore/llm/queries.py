"""Queries over documents: problems 8 to 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlore.llm import bpe, harm, leaks


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(load(spark, sf_dir, "documents"))


def p8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per source, and per document on average; a NULL source is a source."""
    ids = bpe.encode(load(spark, sf_dir, "documents"), keep=("source",)).select("source", F.size("ids").alias("n"))
    return ids.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"), F.avg("n").alias("mean"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, suite, docs: in how many documents each item leaked; every item has a row."""
    found = p9_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))
    return load(spark, sf_dir, "eval_items").select("item_id", "suite").join(found, "item_id", "left").select("item_id", "suite", F.coalesce("docs", F.lit(0)).alias("docs"))


#: A document is a case from this expected severity on. Raters miss harm more often than they invent it, so that a document of
#: which all agree has less than its grade to expect; held-out ratings (README) set the bound.
SEVERE = 0.75


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, severity of every document, by a model fitted on the rated documents of the same tables."""
    documents = load(spark, sf_dir, "documents")
    return harm.score(documents, harm.train(documents, load(spark, sf_dir, "review_labels")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).where(F.col("severity") >= SEVERE).select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, docs, found, rate, severity: per source the documents, the cases, their share and the mean severity."""
    documents = load(spark, sf_dir, "documents")
    model = harm.train(documents, load(spark, sf_dir, "review_labels"))
    scored = harm.score(documents, model, keep=("source",))
    found = F.count(F.when(F.col("severity") >= SEVERE, 1))
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), found.alias("found"), (found / F.count(F.lit(1))).alias("rate"), F.avg("severity").alias("severity")
    )


QUERIES = {f.__name__: f for f in (p8_ids, p8_totals, p9_found, p9_items, p10_found, p10_scores, p10_rates)}
