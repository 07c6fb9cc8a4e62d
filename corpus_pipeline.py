"""A training corpus from raw documents: five stages, each on all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.llm import line_dedup, mixing, ngram_join, toxicity, transducer
from folioloom.llm.common import WORD, staged, table, text_key

#: Documents with this score or more are rejected.
TOXIC = 0.3


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of the toxicity score, which is learned from labelled documents. Null and empty
    texts stay; rows that repeat stay or go together; an empty table stays empty."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(F.col("score") < TOXIC).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stand in an earlier one. A document that had words and has none
    left goes; n_chars, where there is one, follows the text."""
    out = line_dedup.dedup_lines(docs).filter((F.col("n_removed") == 0) | F.col("clean").rlike(WORD))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("n_removed") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*(new[c].alias(c) if new.get(c) is not None else F.col("row")[c].alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle likeness links: the one with the smallest id, once. Documents
    without words all stay."""
    marks = ngram_join.jaccard_components(docs)
    stays = marks.filter(F.col("sig").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "k").agg(F.first("sig").alias("sig"))
    stays = stays.select(F.col("doc_id").alias("id"), F.col("k").alias("text_k"), F.coalesce("sig", F.lit(b"")).alias("sig"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text_key(F.col("text")), F.lit(b"")).alias("k"))
    out = rows.join(stays, rows["doc_id"].eqNullSafe(stays["id"]) & (rows["k"] == stays["text_k"]))
    turn = F.row_number().over(Window.partitionBy("sig", "doc_id").orderBy("k"))
    with_words = out.filter(F.length("sig") > 0).withColumn("turn", turn).filter("turn = 1")
    return with_words.select("row").unionByName(out.filter(F.length("sig") == 0).select("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights: documents as often as the mix takes them. Texts without words are taken
    no time; of rows that repeat an id each is taken by itself; an empty table stays empty."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces, in the place of a column `ids` if they have one. Null and empty texts
    have none; rows that repeat are encoded each; an empty table stays empty."""
    return transducer.encode(docs).select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "ids"), "ids")


STAGES = [("toxicity", reject_toxic), ("line dedup", drop_repeated_lines), ("n-gram Jaccard join", drop_near_copies), ("mixing sources to target weights", mix_sources), ("SentencePiece encoding", encode)]

#: SQL expresses neither the learned score, the tree join nor the encoding; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again; see there for odd rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
