"""The serving tables as snapshots: written whole, made valid at once, and laid out so that a lookup shuffles no index."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from folioloom.operators import catalog, search
from folioloom.operators.staging import Pointer

#: The column by which a table is looked up, and so bucketed.
KEYS = {"token_hits": "token", "genre_works": "genre_lower", "author_works": "author_lower"}


def _name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str, key: str | None, buckets: int) -> None:
    if key is None:
        df.write.parquet(path)
        return
    # rows of a bucket are brought together first, so that each is one file; the name in the session is only lent
    name = _name("written")
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


def _read(spark: SparkSession, table: dict) -> DataFrame:
    schema = StructType.fromJson(json.loads(table["schema"]))
    if table["key"] is None:
        return spark.read.schema(schema).parquet(table["path"])
    name, columns = _name("read"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{table['key']}`) SORTED BY (`{table['key']}`) INTO {table['buckets']} BUCKETS LOCATION '{table['path']}'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def write_tables(spark: SparkSession, tables: dict[str, DataFrame], root: str, buckets: int = 64) -> dict[str, int]:
    """Write the tables as the next snapshot under root; their row counts.

    The snapshot becomes valid when all of it is written, so readers see the one before or this one and never tables of
    both; what a killed job has left is in neither. The one before stays for readers that have begun, those before it go.
    Choose buckets so that one of the largest table fits a task.
    """
    pointer = Pointer(spark, root)
    before = pointer.read() or {"number": 0, "folder": None, "replaced": None}
    folder, state = f"{pointer.root}/snapshot-{uuid.uuid4().hex}", {}
    for name, df in tables.items():
        path, key = f"{folder}/{name}", KEYS.get(name)
        _write(df, path, key, buckets)
        state[name] = {"path": path, "key": key, "buckets": buckets, "schema": df.schema.json(), "rows": spark.read.parquet(path).count()}
    pointer.publish({"folder": folder, "tables": state, "replaced": before["folder"]}, before["number"] + 1)
    if before["replaced"]:
        pointer.delete(before["replaced"])
    return {name: t["rows"] for name, t in state.items()}


def write_catalog(works: DataFrame, genres: DataFrame, root: str, buckets: int = 64) -> dict[str, int]:
    """The next snapshot of all serving tables: works, token_hits, genre_works, author_works, catalog_genres."""
    works = catalog.catalog_position(works)
    tables = {
        "works": catalog.index_entries(works), "token_hits": catalog.token_hits(works), "genre_works": catalog.bridge(works, "genres", "genre"),
        "author_works": catalog.bridge(works, "authors", "author"), "catalog_genres": genres,
    }
    return write_tables(works.sparkSession, tables, root, buckets)


def read_catalog(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the valid snapshot, all of the same one."""
    state = Pointer(spark, root).read()
    if state is None:
        raise FileNotFoundError(f"{root} has no snapshot")
    return {name: _read(spark, table) for name, table in state["tables"].items()}


def search_catalog(spark: SparkSession, root: str, queries: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """search() over the valid snapshot."""
    t = read_catalog(spark, root)
    return search.search(t["works"], t["token_hits"], t["genre_works"], t["catalog_genres"], queries, **how)
