"""Tables that grow by numbered batches and that a fold makes smaller: keyed logs and running sums."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from folioloom.operators.staging import Pointer


class FoldedTable:
    """Rows under `root`, added in batches with ascending numbers; what counts is fold(all rows).

    fold must give the same for folded parts as for all rows: a sum by key, or each key's last row. A batch counts
    from the moment that the pointer names it; one whose number isn't above the last is a repeat and adds nothing,
    so a job that was killed, or a stream that runs a batch again, leaves each batch once. After `keep` batches they
    are folded into one table, less what `prune` drops, so neither the number of files nor the rows to read grow with
    the number of batches.
    Tables that a compaction replaces stay until the next, for readers that have begun.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, fold: Callable[[DataFrame], DataFrame], keep: int = 16, prune: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.root, self.schema, self.fold, self.keep, self.prune = spark, root.rstrip("/"), schema, fold, keep, prune
        self.pointer = Pointer(spark, root)

    def _state(self) -> dict:
        return self.pointer.read() or {"number": 0, "last": -1, "tables": [], "replaced": []}

    @property
    def last(self) -> int:
        """The number of the last batch, -1 if there is none."""
        return self._state()["last"]

    def _union(self, tables: list[str]) -> DataFrame:
        if not tables:
            return self.spark.createDataFrame([], self.schema)
        return reduce(DataFrame.unionByName, [self.spark.read.schema(self.schema).parquet(t) for t in tables])

    def read(self) -> DataFrame:
        return self.fold(self._union(self._state()["tables"]))

    def _write(self, rows: DataFrame, name: str) -> str:
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def add(self, rows: DataFrame, number: int) -> bool:
        """Add a batch; False if it is a repeat."""
        state = self._state()
        if number <= state["last"]:
            return False
        path = self._write(self.fold(rows), f"batch-{number}")
        self.pointer.publish({"last": number, "tables": [*state["tables"], path], "replaced": state["replaced"]}, state["number"] + 1)
        if len(state["tables"]) + 1 > self.keep:
            self.compact()
        return True

    def compact(self) -> None:
        """Fold all tables into one."""
        state = self._state()
        rows = self.fold(self._union(state["tables"]))
        path = self._write(self.prune(rows) if self.prune else rows, "base")
        self.pointer.publish({"last": state["last"], "tables": [path], "replaced": state["tables"]}, state["number"] + 1)
        self.pointer.delete(*state["replaced"])
