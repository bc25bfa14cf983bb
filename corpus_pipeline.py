"""Corpus pipeline: quality, near duplicates, repeated passages, secrets, packing; each stage reads what the last wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import packing, quality, secrets, simhash, substring
from quarry.llm.common import table, written

END_ID = 2


def _retexted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, ``n_chars`` (if there is one) following the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (null and empty texts are scored like any other)."""
    model = quality.trained(docs, table(spark, sf_dir, "labels"))
    return quality.kept(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least ``doc_id`` of each near-duplicate group, once; rows without ``doc_id`` all stay.

    Rows that share a ``doc_id`` are told apart by their fingerprint, so each group keeps a row of its own; of rows that
    share both, the one of the least text stays (null first). Null and blank texts are one group, as they link.
    """
    of = written(simhash.grouped(docs).where("doc_id is not null"), "groups")
    first = of.where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("one")).select("one.*")
    shared = written(of.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "shared")
    known = docs.join(first.join(shared, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi")
    if not shared.isEmpty():
        rows = simhash.marked(docs.join(shared, "doc_id", "left_semi")).join(first, ["doc_id", "fp"], "left_semi")
        least = F.min_by(F.struct(*docs.columns), F.struct("text", F.to_json(F.struct(*docs.columns))))  # combined before the shuffle
        known = known.unionByName(rows.groupBy("doc_id", "fp").agg(least.alias("row")).select("row.*"))
    return known.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; a text that loses nothing stays as it is.

    Null and blank texts stay; rows that share a ``doc_id`` never cut each other; rows without one neither lose nor
    remove words. No document goes, even one that loses every word.
    """
    cut = substring.deduplicated(docs)
    return _retexted(cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))), docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret replaced by ``[SECRET]``: overlapping spans by one; null texts stay null."""
    return _retexted(secrets.scanned(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's ids lies in sequences of at most 4096.

    Null and empty texts are the end id alone; rows that share a ``doc_id`` are packed each on its own.
    """
    return packing.pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", one_of_each_group),
    ("repeated_passages", without_repeats),
    ("secrets", without_secrets),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
