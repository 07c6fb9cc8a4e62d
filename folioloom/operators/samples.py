"""Samples for reports: the rows of least hash, so the same ones for any split of the table into tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions.profile import AXIS_NAMES
from folioloom.operators.jobs import top_axes


def bottom_k(rows: DataFrame, k: int, by: str, strata: Sequence[str] = ()) -> DataFrame:
    """k rows of each stratum, those whose `by` has the least md5, with sample_rank from 1.

    Spark keeps the k least of a stratum in each task before it shuffles, so a frequent stratum, or a table without
    strata, sends k rows a task. Rows with a null in `by` come last; of rows with the same one any may stand.
    """
    order = F.md5(F.col(by).cast("string")).asc_nulls_last()
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(order, by))
    return rows.withColumn("sample_rank", rank).filter(F.col("sample_rank") <= k)


def match_samples(left: DataFrame, right: DataFrame, links: DataFrame, matched: int = 20, left_over: int = 10, right_over: int = 50) -> DataFrame:
    """kind, sample_rank, left_id, left_title, right_id, right_title, score: samples of the links and of the records of
    either side that have none. left, right(id, title), links(left_id, right_id, score)."""
    lefts, rights = (df.select(F.col("id").alias(f"{n}_id"), F.col("title").alias(f"{n}_title")) for df, n in ((left, "left"), (right, "right")))
    met = bottom_k(links.select("left_id", "right_id", "score"), matched, "left_id").join(lefts, "left_id").join(rights, "right_id")
    parts = [
        met.withColumn("kind", F.lit("matched")),
        bottom_k(lefts.join(links, "left_id", "left_anti"), left_over, "left_id").withColumn("kind", F.lit("left unmatched")),
        bottom_k(rights.join(links, "right_id", "left_anti"), right_over, "right_id").withColumn("kind", F.lit("right unmatched")),
    ]
    columns = ["kind", "sample_rank", "left_id", "left_title", "right_id", "right_title", "score"]
    every = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return every.select(*columns)


def axis_samples(profiles: DataFrame, n: int = 5, least: int = 8, axes: int = 7) -> DataFrame:
    """axis, sample_rank, work_id, value, top: for each axis a sample of the profiles with a summary that have `least` or more
    on it, with their highest axes."""
    every = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in AXIS_NAMES))
    told = profiles.filter(F.coalesce("summary", F.lit("")) != "")
    high = told.select("work_id", F.explode(every).alias("x")).select("work_id", "x.*").filter(F.col("value") >= least)
    chosen = bottom_k(high, n, "work_id", ["axis"])
    return chosen.join(profiles.select("work_id", top_axes(axes).alias("top")), "work_id").select("axis", "sample_rank", "work_id", "value", "top")
