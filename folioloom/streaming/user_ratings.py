"""User ratings as events (event_id, user_id, work_id, rating, ts): a null rating deletes.

Batch and stream give the same state: the event with the latest (ts, event_id) of a user and work counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioloom.streaming.folded import FoldedTable


def latest(events: DataFrame) -> DataFrame:
    """user_id, work_id, rating, ts, event_id of each key's last event, deletions included."""
    last = F.max(F.struct("ts", "event_id", "rating")).alias("e")
    return events.groupBy("user_id", "work_id").agg(last).select("user_id", "work_id", "e.rating", "e.ts", "e.event_id")


def current(events: DataFrame) -> DataFrame:
    """Ratings that stand: the last event of a key, unless it deletes or is out of 1 to 10."""
    return latest(events).filter(F.col("rating").between(1, 10))


def deleted(events: DataFrame) -> DataFrame:
    """Keys whose last event deletes, and whether there was a rating before."""
    had = events.groupBy("user_id", "work_id").agg(F.max(F.col("rating").isNotNull()).alias("existed"))
    return latest(events).filter("rating is null").join(had, ["user_id", "work_id"]).select("user_id", "work_id", "existed")


def community_stats(state: DataFrame) -> DataFrame:
    """work_id, count, average (2 digits) of ratings that are numbers."""
    r = F.col("rating").try_cast("int")
    return state.filter(r.isNotNull()).groupBy("work_id").agg(F.count("*").alias("count"), F.round(F.avg(r), 2).alias("average"))


def rating_of(state: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(user_id, work_id) with the user's rating and the work's stats; 0 and null where there are none."""
    out = keys.join(state.select("user_id", "work_id", "rating"), ["user_id", "work_id"], "left").join(community_stats(state), "work_id", "left")
    return out.withColumn("count", F.coalesce("count", F.lit(0)))


RATINGS = "user_id long, work_id long, rating int, ts timestamp, event_id long"


def ratings_table(spark: SparkSession, path: str, keep: int = 16, forget: str | None = None) -> FoldedTable:
    """Each key's last event under path, deletions included. A compaction drops deletions that are older than the newest event
    by the interval `forget` (as "30 days"; None: never); an event that comes later than that after its key's
    deletion, though it happened before, stands again."""

    def prune(rows: DataFrame) -> DataFrame:
        newest = rows.agg(F.max("ts").alias("newest"))  # one row
        old = F.col("ts") < F.expr(f"newest - interval {forget}")
        return rows.crossJoin(newest).filter(F.col("rating").isNotNull() | ~old).drop("newest")

    return FoldedTable(spark, path, RATINGS, latest, keep, prune if forget else None)


def add_events(table: FoldedTable, events: DataFrame, number: int) -> bool:
    """Add a batch of events: its last event of each key, found before anything is shuffled further."""
    columns = [F.col(c).cast(kind).alias(c) for c, kind in (x.split() for x in RATINGS.split(", "))]
    return table.add(events.select(*columns), number)


def live_community(events: DataFrame, table: FoldedTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that adds the stream's batches to the table of ratings; a batch that is run again adds nothing.

    The state is the table itself: late events lose against newer ones and win against older ones whenever they come,
    and a batch costs what it holds, however many keys there are. `community_of` gives the works' stats so far.
    """
    stream = events.writeStream.option("checkpointLocation", checkpoint)
    return stream.foreachBatch(lambda batch, number: add_events(table, batch, number)).trigger(**(trigger or {"availableNow": True})).start()


def community_of(table: FoldedTable) -> DataFrame:
    """work_id, count, average as community_stats() gives them for the events so far."""
    return community_stats(table.read().filter(F.col("rating").between(1, 10)))
