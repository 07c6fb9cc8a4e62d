"""The catalog's inputs as projections of the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.functions.profile import AXIS_NAMES, TROPES
from folioloom.operators.ratings import RATING_SCALE, aggregate_rating, scale_of

SOURCES = tuple(s[0] for s in RATING_SCALE)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def source_ratings(spark: SparkSession, d: str) -> DataFrame:
    """work_id, source, rating, votes: the first line of each part and source."""
    at = (F.col("l_linenumber") % 6).cast("int")
    w = Window.partitionBy("l_partkey", at).orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount")
    one = table(spark, d, "lineitem").withColumn("n", F.row_number().over(w)).filter("n = 1")
    one = one.withColumn("source", F.element_at(F.array(*map(F.lit, SOURCES)), at + 1))
    return one.select(F.col("l_partkey").alias("work_id"), "source", (scale_of(F.col("source")) * (1 - 6 * F.col("l_discount"))).alias("rating"), (3 * F.col("l_quantity")).cast("long").alias("votes"))


def plain_works(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    genres = F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))))
    return p.select(F.col("p_partkey").alias("work_id"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.array(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("authors"), genres.alias("genres"), (1950 + F.col("p_size")).alias("year"))


def works(spark: SparkSession, d: str) -> DataFrame:
    return plain_works(spark, d).join(aggregate_rating(source_ratings(spark, d)).select("work_id", "aggregate_rating"), "work_id", "left")


def records(spark: SparkSession, d: str, odd: bool) -> DataFrame:
    """Works with odd or even ids as records of one source."""
    return plain_works(spark, d).filter(F.col("work_id") % 2 == int(odd)).select(F.col("work_id").alias("id"), F.col("work_id").alias("pos"), "title", "authors", "genres")


def rating_events(spark: SparkSession, d: str) -> DataFrame:
    return rated(table(spark, d, "events"))


def rated(e: DataFrame) -> DataFrame:
    """Events, as a table or a stream, as ratings of works; errors delete."""
    rating = F.when(F.col("event_type") != "error", 1 + F.floor("value").cast("int") % 10)
    return e.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("work_id"), rating.cast("int").alias("rating"), "ts")


def reviews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.length("text") >= 25).select((F.col("doc_id") % 50).alias("work_id"), F.col("lang").alias("source"), F.col("doc_id").alias("seq"), "text")


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """work_id, author, 22 axes, themes (axes from 8), tropes, embedding."""
    keys = F.array(*map(F.lit, TROPES))
    e = table(spark, d, "embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    e = e.withColumns({n: F.least(F.lit(10), 1 + F.floor(F.abs(F.get("x", F.lit(k))) * 40)).cast("int") for k, n in enumerate(AXIS_NAMES)})
    themes = F.filter(F.array(*(F.when(F.col(n) >= 8, F.lit(n)) for n in AXIS_NAMES)), lambda t: t.isNotNull())
    tropes = F.array(F.element_at(keys, (F.col("label") + 1).cast("int")), F.element_at(keys, (F.col("label") + 2).cast("int")))
    return e.select(F.col("vec_id").alias("work_id"), (F.col("label") % 5).alias("author"), *AXIS_NAMES, themes.alias("themes"), tropes.alias("tropes"), F.col("x").alias("embedding"))
