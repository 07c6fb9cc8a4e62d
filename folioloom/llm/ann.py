"""Approximate nearest neighbours: a forest of random-projection trees and exact reranking of leaf candidates.

Trees are grown on a bounded sample of the vectors: each inner node splits along a random direction at the median
of its rows. Every vector of the table is then sent down every tree, and Spark counts the rows of each leaf. A
query walks all trees at once through one priority queue, nearest boundary first, until the leaves it has reached
hold PROBE * n ** 0.75 rows of n, counted over all trees, so a query's work grows slower than the table. Leaves meet their queries in blocks of bounded size, which
compute exact cosines and hand on the best of each block; the best of all blocks are the result.

Equal vectors are one row of the index with their k + 1 smallest ids, so large groups of copies cost nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.llm.common import staged

#: Rows that the trees are grown on, and how many of them a leaf must have; rows of the table that a leaf is to have
#: (more, once the sample allows no deeper trees); trees; what is searched (see above); rows in a block.
FIT_ROWS, LEAST, LEAF, TREES, PROBE, BLOCK = 32_768, 8, 256, 24, 6.5, 4096


@dataclass(frozen=True)
class Forest:
    """normals[tree, node] and cuts[tree, node] of complete binary trees; leaves are numbered after the nodes."""

    normals: np.ndarray
    cuts: np.ndarray
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x in each tree."""
        out = np.zeros((len(x), len(self.normals)), np.int32)
        for t, (normals, cuts) in enumerate(zip(self.normals, self.cuts)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (np.einsum("ij,ij->i", x, normals[at]) > cuts[at])
            out[:, t] = at - (2**self.depth - 1)
        return out

    def probe(self, x: np.ndarray, sizes: np.ndarray, wanted: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until the leaves hold `wanted` rows."""
        first = 2**self.depth - 1
        margins = self.normals @ x - self.cuts if first else None
        queue = [(-np.inf, t, 0) for t in range(len(sizes))]
        out, held = [], 0.0
        while queue and held < wanted:
            far, t, node = heapq.heappop(queue)
            if node >= first:
                out.append((t, node - first))
                held += sizes[t, node - first]
                continue
            m = margins[t, node]
            heapq.heappush(queue, (max(far, -m), t, 2 * node + 2))
            heapq.heappush(queue, (max(far, m), t, 2 * node + 1))
        return out


def grow(x: np.ndarray, trees: int = TREES, leaf: int = LEAF, rows: int | None = None, seed: int = 3) -> Forest:
    """Trees on the sample x of a table of so many rows."""
    rng = np.random.default_rng(seed)
    depth = max(0, int(np.floor(np.log2(max(1, min((rows or len(x)) / leaf, len(x) / LEAST))))))
    normals, cuts = np.zeros((trees, max(1, 2**depth - 1), x.shape[1])), np.zeros((trees, max(1, 2**depth - 1)))
    for t in range(trees):
        parts = [np.arange(len(x))]
        for d in range(depth):
            below = []
            for j, rows in enumerate(parts):
                a = rng.normal(size=x.shape[1])
                side = x[rows] @ (a := a / np.linalg.norm(a))
                cut = np.median(side) if len(side) else 0.0
                normals[t, 2**d - 1 + j], cuts[t, 2**d - 1 + j] = a, cut
                below += [rows[side <= cut], rows[side > cut]]
            parts = below
    return Forest(normals, cuts, depth)


def _rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    vectors = batch[column]
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, whose square may be no double."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _route(forest: Forest) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = forest.leaves(_unit(_rows(batch, "v")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.int32()))], [*batch.schema.names, "leaves"])

    return run


def _probes(forest: Forest, sizes: np.ndarray, wanted: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = [forest.probe(x, sizes, wanted) for x in _unit(_rows(batch, "v"))]
                at = np.repeat(np.arange(len(batch)), [len(f) for f in found])
                tree, leaf = (pa.array([p[i] for f in found for p in f], pa.int32()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), tree, leaf], [*batch.schema.names, "tree", "leaf"])

    return run


def _best(keep: int) -> Callable:
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "class_id": [], "score": []})
        ids = rows["class_id"].to_numpy()
        near = _unit(np.stack(queries["v"].to_numpy()).astype(np.float64)) @ _unit(np.stack(rows["v"].to_numpy()).astype(np.float64)).T
        n = min(keep, len(ids))
        least = np.partition(near, -n, axis=1)[:, -n] if n < len(ids) else near.min(1)
        q, r = np.nonzero(near >= least[:, None])
        order = np.lexsort((ids[r], -near[q, r], q))
        q, r = q[order], r[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        q, r = q[rank < n], r[rank < n]
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[q], "class_id": ids[r], "score": np.clip(near[q, r], -1.0, 1.0)})

    return run


def usable(v: Column) -> Column:
    """True for vectors without null or non-finite components that are not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def neighbours(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", trees: int = TREES, probe: float = PROBE, fit_rows: int = FIT_ROWS, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of vectors that is_query holds for, its k nearest rows
    found by cosine, in double precision; equal scores by smaller id; all rows if there are fewer than k.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids; of vectors of several lengths
    those of the most frequent length (the largest of equals) take part. Rows equal in id and vector are one row.
    A query never finds rows with its own id. An empty table gives an empty result. Other columns are ignored.
    """
    single = vectors.select(F.col(embedding)).dtypes[0][1] == "array<float>"  # half the bytes to shuffle; cosines are doubles
    kind = "array<float>" if single else "array<double>"
    v = F.col(embedding).cast(kind)
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), is_query.alias("asks")).filter(F.col("vec_id").isNotNull()).filter(usable(F.col("v")))
    dims = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), F.col("dim").desc()).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return vectors.sparkSession.createDataFrame([], schema)
    base = base.filter(F.size("v") == dims["dim"]).dropDuplicates(["vec_id", "v"])
    # the rows of one vector: its smallest ids, cut to k + 1 for each in every task before they meet
    w = Window.partitionBy("v").orderBy("vec_id")
    few = base.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1)
    classes = few.groupBy("v").agg(F.min("vec_id").alias("class_id"), F.sort_array(F.collect_list("vec_id")).alias("ids"))

    fit = base.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h").limit(fit_rows).select("v").toPandas()
    n = classes.count()
    forest = grow(_unit(np.stack(fit["v"].to_numpy()).astype(np.float64)), trees, leaf, n)
    n_leaves = 2**forest.depth
    columns = f"class_id long, ids array<bigint>, v {kind}"
    index = staged(classes.select("class_id", "ids", "v").mapInArrow(_route(forest), f"{columns}, leaves array<int>"), "leaves")
    member = index.select("class_id", "v", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = np.zeros((trees, n_leaves))
    for r in index.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect():
        sizes[r["tree"], r["leaf"]] = r["count"]
    queries = base.filter("asks").select(F.col("vec_id").alias("query_id"), "v")
    wanted = probe * n**0.75
    probes = staged(queries.mapInArrow(_probes(forest, sizes, wanted), f"query_id long, v {kind}, tree int, leaf int"), "probes")

    # each leaf's rows and queries are dealt into blocks; every block of rows meets every block of queries
    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    cells = parts(member, "row_parts").join(parts(probes, "query_parts"), ["tree", "leaf"])
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    rows = member.join(cells, ["tree", "leaf"]).select("tree", "leaf", deal("class_id", "row_parts").alias("rp"), F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("qp"), "class_id", "v")
    asked = probes.join(cells, ["tree", "leaf"]).select("tree", "leaf", deal("query_id", "query_parts").alias("qp"), F.explode(F.sequence(F.lit(0), F.col("row_parts") - 1)).alias("rp"), "query_id", "v")
    key = ["tree", "leaf", "rp", "qp"]
    best = rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_best(k + 1), "query_id long, class_id long, score double")
    best = best.groupBy("query_id", "class_id").agg(F.max("score").alias("score"))
    top = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "class_id")
    best = best.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1).drop("n")
    found = best.join(index.select("class_id", "ids"), "class_id").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id != query_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
