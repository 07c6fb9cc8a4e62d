"""What the operators of this subpackage share: table access, the shared folder and text patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where it is unset a local session, whose
    driver and executors are one process, gets a temporary folder; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def staged(df: DataFrame, name: str, by: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder, in folders by the column `by` if there is one, and read it again: cuts
    lineage, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def step(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """staged(), for jobs of many steps: the shuffle files of the step go as soon as its table is written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return staged(df, name, compression=compression)
    finally:
        conf.set(key, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables that staged() or step() wrote, once no later step reads them."""
    for table in tables:
        for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:  # one, or one for each value that the table is cut by
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def n_words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(text))
