"""From documents to packed sequences: quality, exact copies, near copies, secrets, packing.

Every stage takes (spark, docs, sf_dir), reads all that its predecessor kept, and returns a DataFrame; all but the last return the
columns of documents (extra ones, too, whatever their names). The exact stage tells rows apart by where they are stored, so one row of
each group stays, also where rows repeat; from the near-copy stage on rows that share a doc_id and differ in text go or stay together.
Null texts count as empty; texts of any length are read whole; an empty table passes every stage as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import exact_dedup, jaccard_join, packing, quality, secrets
from tideline.llm.batches import bound_batches, collect_garbage
from tideline.llm.scratch import materialise

#: Up to this number of dropped rows (under 64 bytes each) every executor gets them; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000


def _without(docs: DataFrame, dropped: DataFrame, same: Column) -> DataFrame:
    return docs.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped, same, "left_anti")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network accepts."""
    collect_garbage(spark)
    bound_batches(spark)
    network = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, network).filter("predicted = 1").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space aside: the longest, then the one of least id."""
    collect_garbage(spark)
    return exact_dedup.drop_copies(spark, docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component of similar texts."""
    collect_garbage(spark)
    bound_batches(spark)
    found = materialise(jaccard_join.join(docs), "near-copies")
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return _without(docs, gone, F.col("doc_id").eqNullSafe(F.col("__id"))).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    collect_garbage(spark)
    bound_batches(spark)
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids and their places in sequences of 1024 tokens."""
    collect_garbage(spark)
    bound_batches(spark)
    return packing.pack(packing.pieces(docs, packing.default_tokenizer(), with_ids=True))


STAGES = [("quality", keep_good), ("exact copies", drop_copies), ("near copies", drop_near_copies), ("secrets", mask_secrets), ("packing", pack)]

#: SQL cannot express the network, the automata or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
