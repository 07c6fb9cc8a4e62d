"""Progress of a long job over many ids: a status for each, kept through kills and repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.streaming.folded import FoldedTable

# What an error text must hold to mean too little source text, or a server that is away for a while.
INSUFFICIENT = "insufficient_source"
TRANSIENT = ("10061", "ConnectError", "Connection refused", "Server disconnected", "actively refused")


def status_of(error: Column) -> Column:
    """ok without an error; skip: for too little source text; null, that is no status, for an error that will pass; else fail:"""
    away = error.contains(TRANSIENT[0])
    for text in TRANSIENT[1:]:
        away |= error.contains(text)
    return F.when(error.isNull(), "ok").when(error.contains(INSUFFICIENT), F.concat(F.lit("skip:"), error)).when(~away, F.concat(F.lit("fail:"), error))


def _newest(rows: DataFrame) -> DataFrame:
    """The status of an id in its last batch; in one batch an ok goes before others, then the least text."""
    order = F.struct("batch", F.when(F.col("status") == "ok", 1).otherwise(0).alias("ok"), F.length("status").alias("n"), "status")
    return rows.groupBy("id").agg(F.max(order).alias("s")).select("id", "s.status", "s.batch")


def progress_log(spark: SparkSession, root: str, id_type: str = "bigint", keep: int = 16) -> FoldedTable:
    """The log under root: (id, status, batch), one row for each id that has a status."""
    return FoldedTable(spark, root, f"id {id_type}, status string, batch bigint", _newest, keep)


def log_batch(log: FoldedTable, results: DataFrame, number: int) -> bool:
    """Add results(id, error) as batch `number`; also what a stream's foreachBatch calls."""
    rows = results.select("id", status_of(F.col("error")).alias("status"), F.lit(number).cast("long").alias("batch"))
    return log.add(rows.filter("status is not null and id is not null"), number)


def run_pass(queue: DataFrame, analyse: Callable[[DataFrame], DataFrame], log: FoldedTable, chunks: int, turn: int = 0, retry_failed: bool = False) -> int:
    """One pass over queue(id, ...) in `chunks` parts by the ids' hash, each logged when it is done: the number of parts
    that this call did.

    analyse gives (id, error) for the rows of a part. Killed and started again with the same turn, a pass goes on
    behind the last part that was logged. Ids with a status are left out, except failed ones if they are to be
    tried again; ids whose error will pass have no status, so the next turn takes them up.
    """
    done = 0
    for chunk in range(chunks):
        number = turn * chunks + chunk
        if number <= log.last:
            continue
        finished = log.read().filter(~F.col("status").startswith("fail") if retry_failed else F.lit(True))
        part = queue.filter(F.pmod(F.xxhash64("id"), F.lit(chunks)) == chunk).join(finished.select("id"), "id", "left_anti")
        done += log_batch(log, analyse(part), number)
    return done
