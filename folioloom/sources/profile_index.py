"""An index of profile files that follows its folder and parses only the files that are new or changed."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.functions.profile import AXIS_NAMES
from folioloom.operators.jobs import profile_view
from folioloom.operators.staging import Pointer

PROFILE = f"work_id bigint, author bigint, {', '.join(f'{a} int' for a in AXIS_NAMES)}, themes array<string>, tropes array<string>, badge string, summary string"
ROWS = f"{PROFILE}, file string, line string, build int, trope_labels array<string>"
BAD = "file string, line string, reason string, build int"
FILES = "file string, modified timestamp, bytes bigint, build int"


class ProfileIndex:
    """Profiles from the JSON files (an object a line) below `folder`, as tables under `root`.

    build() compares the files' times and sizes with those of the build before; none is opened for that. It parses
    files that are new or differ, and rows of files that differ or are gone stop counting. Files are picked by the least time among
    the changed ones, so one that is put there with an old time is found, at the price of reading those since then again.
    Rows count by their file and its build, so a build writes only its own rows; after `keep` builds they are folded
    into one table. Lines that are no profile are kept apart with their file and reason, and stop no build. Profiles
    are light, without embeddings; empty tropes and badges are filled by rule from axes and genres. Of a work in several
    files the newest file's row counts, of one file's the one with the least text. One job builds at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, root: str, keep: int = 8):
        self.spark, self.folder, self.root, self.keep = spark, folder, root.rstrip("/"), keep
        self.pointer = Pointer(spark, root)

    def _state(self) -> dict:
        return self.pointer.read() or {"number": 0, "files": None, "rows": [], "bad": []}

    def _files(self, state: dict) -> DataFrame:
        return self.spark.read.schema(FILES).parquet(state["files"]) if state["files"] else self.spark.createDataFrame([], FILES)

    def _listed(self) -> DataFrame:
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.folder)
        meta = F.col("_metadata")
        return found.select(meta["file_path"].alias("file"), meta["file_modification_time"].alias("modified"), meta["file_size"].alias("bytes"))

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _parsed(self, since: str, files: DataFrame) -> DataFrame:
        """The lines of `files`, all of them newer than `since`: PROFILE, file, line, reason (null for a profile)."""
        text = self.spark.read.text(self.folder, recursiveFileLookup=True, modifiedAfter=since)
        lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).join(files.select("file"), "file", "left_semi")
        lines = lines.filter(F.trim("line") != "").withColumn("p", F.from_json("line", f"{PROFILE}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
        reason = F.when(F.col("p").isNull() | F.col("p._bad").isNotNull(), "malformed").when(F.col("p.work_id").isNull(), "no id")
        return lines.select("p.*", "file", "line", reason.alias("reason")).drop("_bad")

    def build(self, works: DataFrame) -> int:
        """Bring the index up to date with the folder: the number of files that were parsed. works(work_id, genres)."""
        state = self._state()
        build, old = state["number"] + 1, self._files(state)
        listed, was = self._listed(), old.select("file", F.col("modified").alias("m"), F.col("bytes").alias("b"), F.col("build").alias("n"))
        same = F.col("modified").eqNullSafe(F.col("m")) & F.col("bytes").eqNullSafe(F.col("b"))
        now = listed.join(was, "file", "left").select("file", "modified", "bytes", F.when(same, F.col("n")).otherwise(build).cast("int").alias("build"))
        files = self._write(now, f"files-{build}")
        now = self.spark.read.schema(FILES).parquet(files)
        changed = now.filter(F.col("build") == build)
        oldest = F.min(F.when(F.col("build") == build, F.col("modified"))) - F.expr("interval 2 seconds")  # modifiedAfter has whole seconds
        count, since, held = now.agg(F.count_if(F.col("build") == build), F.date_format(oldest, "yyyy-MM-dd'T'HH:mm:ss"), F.count("*")).first()
        if not count and held == old.count():
            self.pointer.delete(files)
            return 0
        new = {k: list(state[k]) for k in ("rows", "bad")}
        if count:
            lines = self._parsed(since, changed).withColumn("build", F.lit(build))
            bad = self._write(lines.filter("reason is not null").select("file", "line", "reason", "build"), f"bad-{build}")
            good = lines.filter("reason is null").drop("reason").withColumn("tropes", F.coalesce("tropes", F.array().cast("array<string>")))
            rows = self._write(profile_view(good, works), f"rows-{build}")
            new = {"rows": [*new["rows"], rows], "bad": [*new["bad"], bad]}
        if len(new["rows"]) > self.keep:
            new = {k: [self._write(self._counting(tables, ROWS if k == "rows" else BAD, now), f"{k}-to-{build}")] for k, tables in new.items()}
        self.pointer.publish({"files": files, **new}, build)
        return count

    def _counting(self, tables: list[str], schema: str, files: DataFrame) -> DataFrame:
        """Rows of the files as they are now."""
        every = reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(t) for t in tables], self.spark.createDataFrame([], schema))
        return every.join(files.select("file", "build"), ["file", "build"], "left_semi")

    def read(self) -> DataFrame:
        """One row for each work."""
        state = self._state()
        newest = Window.partitionBy("work_id").orderBy(F.col("modified").desc(), F.col("file").desc(), "line")
        files = self._files(state)
        rows = self._counting(state["rows"], ROWS, files).join(files.select("file", "modified"), "file")
        return rows.withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n", "line", "modified", "build")

    def bad(self) -> DataFrame:
        """file, line, reason of the lines that are no profile."""
        state = self._state()
        return self._counting(state["bad"], BAD, self._files(state)).select("file", "line", "reason")
