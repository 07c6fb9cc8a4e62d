"""Reading the inputs: record dumps, keyed JSON objects, folders of pages, profiles with bad rows among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions.text import normalize_authors, normalize_title

RECORD = "source string, external_id string, title string, authors array<string>, rating double, rating_max double, vote_count bigint, rank int, work_type string, year int, url string, genres array<string>"


def read_records(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """A JSON array of objects as records; keys that are not in the schema are left out, normal forms are added."""
    df = spark.read.schema(RECORD).json(path, multiLine=True)
    df = df.withColumn("source", F.lit(source)) if source else df
    empty = F.array().cast("array<string>")
    df = df.withColumns({"rating_max": F.coalesce("rating_max", F.lit(10.0)), "authors": F.coalesce("authors", empty), "genres": F.coalesce("genres", empty)})
    return df.withColumn("normalized_title", normalize_title(F.col("title"))).withColumn("normalized_authors", normalize_authors(F.col("authors")))


def read_keyed(spark: SparkSession, path: str, payload: str) -> DataFrame:
    """JSON objects used as maps -> key, and the fields of the payload (a struct's DDL)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,struct<{payload}>>")).alias("key", "p")).select("key", "p.*")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A folder of saved pages: page_id (the file's stem), html with undecodable bytes replaced, bytes."""
    files = spark.read.format("binaryFile").load(path)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    return files.select(stem.alias("page_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"), F.col("length").alias("bytes"))


def read_profiles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Profile rows in JSON; rows that can't be read, or have no id, are left out."""
    df = spark.read.schema(f"{schema}, _bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return df.filter("_bad is null and work_id is not null").drop("_bad")
