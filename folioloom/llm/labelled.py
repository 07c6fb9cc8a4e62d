"""Labelled rows for learning: a bounded sample of the rows that are not held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; 0 for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """text, label of at most `rows` labelled documents that are not held out, in the order of a hash of their
    ids. The ids are bounded by `rows`, so they are broadcast; the texts stay on the executors. Of several labels
    of one id the largest counts; null ids and null labels are left out."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(fold_of(F.col("doc_id"), folds) != held_out)
    ids = known.groupBy(F.col("doc_id").alias("id")).agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id").select("text", "label")
