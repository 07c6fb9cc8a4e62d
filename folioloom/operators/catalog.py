"""The catalog: works from several sources, their positions, and the tables that searches read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions.text import blurb, index_tokens, search_blob, search_normalize, stable_id
from folioloom.operators import link
from folioloom.operators.staging import written


def places(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with pos, from 1 in order. Ranges are written once and sorted each by itself, as many as Spark shuffles
    into; only their row counts meet in one task."""
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(slices, *order).withColumn("slice", F.spark_partition_id()), "ranged")
    inside = ranged.withColumn("n", F.row_number().over(Window.partitionBy("slice").orderBy(*order)))
    above = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("slice").agg(F.count("*").alias("rows")).select("slice", F.coalesce(F.sum("rows").over(above), F.lit(0)).alias("offset"))
    return inside.join(F.broadcast(offsets), "slice").withColumn("pos", F.col("n") + F.col("offset")).drop("slice", "n", "offset")  # one row a slice


def catalog_position(works: DataFrame) -> DataFrame:
    """works with pos, from 1 by falling rating (null as 0), lower-cased title and id."""
    return places(works, [F.coalesce("aggregate_rating", F.lit(0.0)).desc(), F.lower("title"), F.col("work_id")])


def token_hits(works: DataFrame) -> DataFrame:
    """token, pos: the inverted index."""
    blob = search_normalize(search_blob(F.col("title"), F.col("authors"), F.col("genres")))
    return works.select(F.explode(index_tokens(blob)).alias("token"), "pos")


def bridge(works: DataFrame, column: str, name: str) -> DataFrame:
    """{name}_lower, {name}, pos: one row for each distinct value of an array column of each work."""
    one = works.select("pos", F.explode(column).alias(name)).filter(F.trim(name) != "")
    return one.select(F.lower(F.trim(name)).alias(f"{name}_lower"), name, "pos").dropDuplicates([f"{name}_lower", "pos"])


def index_entries(works: DataFrame) -> DataFrame:
    """The light rows of result lists: everything but the description, of which the beginning stays."""
    return works.withColumn("search_blurb", blurb(F.col("description"))).drop("description") if "description" in works.columns else works


def publishable(kind: Column, aggregate: Column, rating: Column, download: Column) -> Column:
    """Which rows go on: merged ones from 60, catalog rows always, extras with a score, one kind also by a download."""
    return F.when(kind == "merged", F.coalesce(aggregate >= 60, F.lit(False))).when(kind == "catalog", True).when(kind == "bookmix", rating.isNotNull() & (aggregate.isNotNull() | download.isNotNull())).otherwise(aggregate.isNotNull())


def attach_source(works: DataFrame, records: DataFrame, source: str) -> DataFrame:
    """Each work in catalog order takes its best unused record of a source: adds {source}_id and the record's genres."""
    left = works.select(F.col("work_id").alias("id"), "pos", "title", "authors")
    links = link.one_to_one(link.classes(left, records))
    extra = links.join(records.select(F.col("id").alias("right_id"), F.col("genres").alias("more")), "right_id", "left")
    out = works.join(extra.select(F.col("left_id").alias("work_id"), F.col("right_id").alias(f"{source}_id"), "more"), "work_id", "left")
    return out.withColumn("genres", ordered_union(F.col("genres"), F.coalesce("more", F.array().cast("array<string>")))).drop("more")


def attach_unused(works: DataFrame, records: DataFrame, used: DataFrame) -> DataFrame:
    """Works without a download take the best record that no link uses: adds download_url from it."""
    free = records.join(used.select(F.col("right_id").alias("id")), "id", "left_anti")
    open_ = works.filter(F.col("download_url").isNull()).select(F.col("work_id").alias("id"), "pos", "title", "authors")
    links = link.one_to_one(link.classes(open_, free)).join(free.select(F.col("id").alias("right_id"), F.col("download_url").alias("url")), "right_id")
    return works.join(links.select(F.col("left_id").alias("work_id"), "url"), "work_id", "left").withColumn("download_url", F.coalesce("download_url", "url")).drop("url")


def leftovers(records: DataFrame, links: DataFrame, prefix: str) -> DataFrame:
    """Records that no link uses, as works of their own with an id made from their source's prefix and id."""
    rest = records.join(links.select(F.col("right_id").alias("id")), "id", "left_anti")
    return rest.withColumn("work_uuid", stable_id(F.concat(F.lit(f"{prefix}:"), F.col("id").cast("string")))).withColumn("source_origin", F.lit(prefix))


def union_catalogs(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def ordered_union(a: Column, b: Column) -> Column:
    """The values of two arrays, first occurrences in order."""
    return F.array_distinct(F.concat(a, b))


def any_all(bridge_rows: DataFrame, selected: DataFrame, match: str = "any") -> DataFrame:
    """query_id, pos of works that have any or all of the selected values. selected(query_id, genre_lower)."""
    wanted = selected.distinct()
    hits = bridge_rows.join(wanted, "genre_lower").groupBy("query_id", "pos").agg(F.count_distinct("genre_lower").alias("n"))
    if match == "any":
        return hits.select("query_id", "pos")
    return hits.join(wanted.groupBy("query_id").agg(F.count("*").alias("all")), "query_id").filter("n = all").select("query_id", "pos")


def longest_description(candidates: DataFrame, priority: tuple[str, ...] = ("fantasy_worlds", "bookmix", "fantlab")) -> DataFrame:
    """candidates(work_id, source, text) -> the longest text of each work; equals by the order of the sources."""
    rank = F.coalesce(*(F.when(F.col("source") == s, -k) for k, s in enumerate(priority)), F.lit(-len(priority)))
    return candidates.filter("text is not null").groupBy("work_id").agg(F.max_by(F.struct("text", "source"), F.struct(F.length("text"), rank)).alias("b")).select("work_id", F.col("b.text").alias("description"), F.col("b.source").alias("description_source"))


def catalog_report(works: DataFrame) -> DataFrame:
    """One row of conditional counts over the works; columns that are missing count 0."""
    has = lambda c: F.count_if(F.col(c).isNotNull()) if c in works.columns else F.lit(0).cast("long")
    return works.agg(F.count("*").alias("total"), has("aggregate_rating").alias("rated"), has("download_url").alias("with_download"), has("description").alias("with_description"))
