"""Toxicity, exact dedup, near dedup, mixing and tokens, over the documents of a folder of tables.

Each stage gets what the one before it kept, written as Parquet, and its decisions take effect: toxic documents go, one
of equal texts stays, one of near-duplicate texts stays, sources are brought to their target weights (a document that
is taken twice has two rows, told apart by a column copy, which are cut differently), and the mix is cut into pieces.
The last stage returns doc_id, source, n_tokens and token_ids.

Defined results are those of the operators: null, empty and wordless texts aren't toxic, are equal to each other (null counts
as empty) and link with nothing, have no words to mix and no tokens (null for null); texts of any length are read whole; of
texts that tie the row with the largest id stays in exact dedup, that with the smallest in near dedup; repeated rows count
as equal texts; empty tables give empty results; extra columns of any name pass up to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import exact_dedup, minhash_dedup, mixing, pieces, toxicity
from paperloom.plans.workspace import save, ship

#: Documents that score this much or more go.
TOXIC = 0.5
#: SQL has neither the trained model nor the merges.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.with_score(docs, toxicity.train(docs, labels))
    return scored.where(F.col("__pl_score") < TOXIC).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, copy="copy")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.with_tokens(docs.select("doc_id", "source", "text", "copy"), copy="copy").select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("toxicity", reject_toxic), ("exact_dedup", exact), ("minhash_dedup", near), ("mixing", mix), ("sentencepiece", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
