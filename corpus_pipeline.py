"""Training-data pipeline over ``documents``: each stage is one operator of ``mediasignals.llm``.

A stage takes (spark, docs, sf_dir) and returns the columns of ``documents`` (the last one:
token ids). Its result is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasignals.llm import line_join, parity_join, piece_lattice, quality_rules, wu_manber
from mediasignals.llm.queries import TOKENIZER
from mediasignals.llm.registry import table
from mediasignals.session import discard, tune, written

#: token ids cannot be made in SQL; tests compare every stage with a brute-force version
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a certified cutoff go."""
    measured = quality_rules.measure(docs.select("doc_id", "text")).drop("text")
    cutoffs = quality_rules.fit(measured, table(tune(spark), sf_dir, "labels"))
    judged = quality_rules.judge(quality_rules.measure(docs), cutoffs)
    return judged.where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or nearly equal an earlier one go; so do documents that only had such."""
    tune(spark)
    kept = line_join.dedup(docs)
    dropped = F.col("n_equal") + F.col("n_near") > 0
    return (
        kept.where(~(dropped & (F.btrim("text", F.lit(" \t\r\n\x0b\f")) == "")))
        .withColumn("n_chars", F.when(dropped, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        .select(*docs.columns)
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; rows without an id
    stay, and of equal rows one."""
    tune(spark)
    groups = parity_join.components(docs)
    chosen = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.where(F.col("doc_id").isNotNull()).join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).union(docs.where(F.col("doc_id").isNull()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = wu_manber.search(docs, table(tune(spark), sf_dir, "benchmark"))
    return found.where(F.col(f"{wu_manber.RESULT}.n_hit") == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Token ids of the best segmentation, its score, and the further ones."""
    tune(spark)
    found = piece_lattice.encode(docs, piece_lattice.Vocabulary.load(tokenizer))
    r = piece_lattice.RESULT
    return found.select(
        "doc_id", "lang", "source", F.size(f"{r}.ids").cast("long").alias("n_tokens"),
        f"{r}.score", f"{r}.ids", f"{r}.further", f"{r}.exact",
    )


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, former = table(tune(spark), sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if former is not None:
            discard(former)
        former = docs
    return docs
