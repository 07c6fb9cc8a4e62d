"""Reviews: keys, first occurrences, the first n of each work, bundles. reviews(work_id, source, seq, text, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def review_key(text: Column, n: int = 160) -> Column:
    """The first n characters of the lower-cased text with white space collapsed."""
    return F.substring(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 1, n)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; rows of the key are cut to one in every task before they meet."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def dedupe(reviews: DataFrame) -> DataFrame:
    """The first review with each text of each work, in the order of seq; blank texts go."""
    keyed = reviews.withColumn("_key", review_key(F.col("text"))).filter(F.col("_key") != "")
    return first_per_key(keyed, ["work_id", "_key"], [F.col("seq")]).drop("_key")


def top_n(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def attach(stored: DataFrame, foreign: DataFrame, n: int = 15) -> DataFrame:
    """Stored reviews, then those found by another id, each text once, the first n of each work, with rank."""
    both = stored.withColumn("_p", F.lit(0)).unionByName(foreign.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    keyed = both.withColumn("_key", review_key(F.col("text"))).filter(F.col("_key") != "")
    one = first_per_key(keyed, ["work_id", "_key"], [F.col("_p"), F.col("seq")])
    return top_n(one, "work_id", [F.col("_p"), F.col("seq")], n).drop("_p", "_key")


def collect(*sources: DataFrame, n: int = 10) -> DataFrame:
    """Reviews of several sources in a fixed order, each text once, the first n of each work."""
    out = None
    for k, df in enumerate(sources):
        one = df.withColumn("_p", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    keyed = out.withColumn("_key", review_key(F.col("text"))).filter(F.col("_key") != "")
    one = first_per_key(keyed, ["work_id", "_key"], [F.col("_p"), F.col("seq")])
    return top_n(one, "work_id", [F.col("_p"), F.col("seq")], n).drop("_p", "_key")


def needs_more(reviews: DataFrame, works: DataFrame, least: int = 5) -> DataFrame:
    """Works with fewer reviews than wanted."""
    n = reviews.groupBy("work_id").agg(F.count("*").alias("n"))
    return works.select("work_id").join(n, "work_id", "left").filter(F.coalesce("n", F.lit(0)) < least).select("work_id")


def bundles(reviews: DataFrame, n: int = 15) -> DataFrame:
    """work_id, count (before the cut), sources_tried, reviews (the first n in order; each group is at most n rows)."""
    one = dedupe(reviews)
    counts = one.groupBy("work_id").agg(F.count("*").alias("count"), F.array_sort(F.collect_set("source")).alias("sources_tried"))
    kept = top_n(one, "work_id", [F.col("seq")], n).groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "text"))).alias("reviews"))
    return counts.join(kept, "work_id")


def works_with_reviews(bundle: DataFrame, limit: int | None = None) -> DataFrame:
    out = bundle.filter(F.col("count") > 0).select("work_id").orderBy("work_id")
    return out.limit(limit) if limit else out
