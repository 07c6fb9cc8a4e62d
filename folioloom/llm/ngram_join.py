"""N-gram Jaccard join: a prefix-tree join over sets of word shingles.

Sets that are equal are one row. A global order puts shingles that many sets hold last. Let y lack a of the n
shingles of x and hold b others. A Jaccard likeness of t means a + t * b <= (1 - t) * n, and a shingle
that is missing breaks two pairs of neighbours in the order, one that is added breaks one: fewer than
2 * (1 - t) * n + 1 in all. So of the first 2 * (1 - t) * n + 2 shingles of two linked sets a pair of neighbours is the
same, and sets with such a pair in common are candidates. Single shingles, which long texts share by chance, are not
enough; that keeps candidate blocks small.

A block's sets are stored in a prefix tree, ordered by the block's frequencies; a set is compared with all others
in one walk that shares partial overlaps and leaves subtrees whose remaining lengths can't reach t. Sets that are
already known to be connected are not walked to again, so a block of near copies takes few steps for each set.
Blocks beyond BLOCK shingles are cut by size into parts that meet pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.llm.common import staged, text_key
from folioloom.llm.components import components
from folioloom.llm.shingles import mixed, sets, signatures, text_chunks

#: A shingle that COMMON sets or more hold comes late in the order; at most MAX_COMMON are told apart from the
#: others, the most frequent ones. Neither has an effect on the result. BLOCK: shingles of a task's tree, twice as many at most.
COMMON, MAX_COMMON, BLOCK, SALTS = 6, 3_000_000, 1_500_000, 64


def _marks(n: int):
    """Set sizes and signatures of texts; and for each batch the smaller half of its different sets' shingles (those
    that a prefix can hold), cut to 32 bits: sorted, in 256 buckets by their first byte, the other bytes laid out one after the other so that they compress."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, seen, known = [], [], [], set()
            for _, data, bounds in text_chunks(batch["text"]):
                s, at = sets(data, bounds, n)
                sig = signatures(s, at)
                sizes += np.diff(at).tolist()
                names += sig
                new = np.array([x is not None and x not in known and not known.add(x) for x in sig], bool)
                size = np.diff(at)
                first = np.arange(len(s)) - np.repeat(at[:-1], size) <= np.repeat(size, size) // 2
                seen.append((s[np.repeat(new, size) & first] >> np.uint64(32)).astype(np.uint32))
            short = np.sort(np.concatenate(seen) if seen else np.zeros(0, np.uint32))
            parts = np.split(short & np.uint32(0xFFFFFF), np.searchsorted(short, np.arange(1, 256, dtype=np.uint64) << np.uint64(24)))
            held = [(i, x.view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()) for i, x in enumerate(parts) if len(x)]
            docs, more = len(batch), len(held)
            null = lambda k, kind: pa.nulls(k, kind)
            both = lambda a, b: pa.concat_arrays([a, b])
            yield pa.RecordBatch.from_arrays(
                [both(batch["doc_id"], null(more, pa.int64())), both(batch["k"], null(more, pa.binary())), pa.array(sizes + [None] * more, pa.int64()), pa.array(names + [None] * more, pa.binary()), pa.array([None] * docs + [i for i, _ in held], pa.int32()), pa.array([None] * docs + [x for _, x in held], pa.binary())],
                ["doc_id", "k", "n_shingles", "sig", "bucket", "rest"],
            )

    return run


def _frequent(least: int):
    """Rows (bucket, rest) sorted by bucket to (key, times) of the cut shingles that stand in `least` sets or more.
    The counters of a bucket have a fixed size, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, counts = None, np.zeros(0, np.uint16)

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(counts >= least)
            return pa.RecordBatch.from_arrays([pa.array(at + (bucket << 24), pa.int64()), pa.array(counts[at].astype(np.int64))], ["key", "times"])

        for batch in batches:
            for b, rest in zip(batch["bucket"].to_pylist(), batch["rest"].to_pylist()):
                if b != bucket:
                    if bucket is not None:
                        yield out()
                    bucket, counts = b, np.zeros(1 << 24, np.uint16)
                x = np.frombuffer(rest, np.uint8).reshape(3, -1).astype(np.uint32)
                at, n = np.unique(x[0] | x[1] << 8 | x[2] << 16, return_counts=True)
                counts[at] = np.minimum(counts[at].astype(np.int64) + n, 65535)
        if bucket is not None:
            yield out()

    return run


def _prefixes(n: int, percent: int, order_of_common):
    """(key, salt, c): the pairs of neighbours in the prefix of each set, c being the first 8 bytes of its signature.
    order_of_common: sorted cut shingles that come late."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = order_of_common.value
        for batch in batches:
            known: set[bytes] = set()
            for _, data, bounds in text_chunks(batch["text"]):
                s, at = sets(data, bounds, n)
                sig = signatures(s, at)
                size = np.diff(at)
                late = _among((s >> np.uint64(32)).astype(np.uint32), common)
                of = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((s, late, of))
                place = np.arange(len(s)) - np.repeat(at[:-1], size)
                length = np.minimum(size, 2 * (100 - percent) * size // 100 + 2)
                new = np.array([x is not None and x not in known and not known.add(x) for x in sig], bool)
                keep = (place + 1 < length[of]) & new[of]
                c = np.array([int.from_bytes(x[:8], "big", signed=True) if x else 0 for x in sig], np.int64)
                at_ = np.flatnonzero(keep)
                chosen, after = order[at_], order[np.minimum(at_ + 1, len(order) - 1)]
                key = mixed(s[chosen] * np.uint64(3) + s[after])
                salt = np.where(late[chosen] & late[after], 1 + (c[of[at_]] % SALTS + SALTS) % SALTS, 0)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(c[of[at_]])], ["key", "salt", "c"])

    return run


def _among(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(s), bool)
    return table[np.minimum(np.searchsorted(table, s), len(table) - 1)] == s


class _Node:
    """A stretch of shingles that a subtree's sets share. least, most: sizes of its sets; live: sets not yet reached."""

    __slots__ = ("tokens", "depth", "below", "sets", "parent", "least", "most", "live")

    def __init__(self, tokens: np.ndarray, depth: int, parent: _Node | None) -> None:
        self.tokens, self.depth, self.parent = tokens, depth, parent
        self.below: list[_Node] = []
        self.sets: list[int] = []
        self.least, self.most, self.live = 1 << 60, 0, 0


def prefix_tree(ordered: list[np.ndarray]) -> tuple[_Node, list[_Node]]:
    """The tree of ordered sets of numbers (stretches without branches are one node), and the node of each set."""
    root = _Node(np.zeros(0, np.int64), 0, None)
    ends: list[_Node] = [root] * len(ordered)
    path = [root]
    last = np.zeros(0, np.int64)
    for i in sorted(range(len(ordered)), key=lambda i: ordered[i].astype(">u4").tobytes()):
        now = ordered[i]
        n = min(len(last), len(now))
        other = np.flatnonzero(last[:n] != now[:n])
        shared = int(other[0]) if len(other) else n
        while path[-1].depth > shared:
            node = path.pop()
            if path[-1].depth < shared:  # the branch leaves this stretch: cut it in two
                head = _Node(node.tokens[: shared - path[-1].depth], shared, path[-1])
                path[-1].below[-1] = head
                node.tokens, node.parent = node.tokens[len(head.tokens) :], head
                head.below.append(node)
                path.append(head)
        if len(now) > shared:
            node = _Node(now[shared:], len(now), path[-1])
            path[-1].below.append(node)
            path.append(node)
        path[-1].sets.append(i)
        ends[i] = path[-1]
        last = now
    for i, node in enumerate(ends):
        size = len(ordered[i])
        while node is not None:
            node.least, node.most, node.live = min(node.least, size), max(node.most, size), node.live + 1
            node = node.parent
    return root, ends


def joined(found: list[np.ndarray], percent: int = 80) -> list[int]:
    """For each set of hashes the number of the first set that links connect it with."""
    if not found:
        return []
    values, at, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-times, kind="stable")] = np.arange(len(values))
    ordered = [np.sort(x) for x in np.split(rank[at], np.cumsum([len(x) for x in found])[:-1])]
    root, ends = prefix_tree(ordered)

    def reach(i: int) -> None:
        node = ends[i]
        while node is not None:
            node.live -= 1
            node = node.parent

    out = [-1] * len(ordered)
    mine = np.zeros(len(values), bool)
    for i in range(len(ordered)):
        if out[i] >= 0:
            continue
        out[i] = i
        reach(i)
        todo = [i]
        while todo and root.live:
            x = ordered[todo.pop()]
            size = len(x)
            mine[x] = True
            walk = [(child, 0) for child in root.below]
            while walk:
                node, had = walk.pop()
                if not node.live or 100 * min(size, node.most) < percent * max(size, node.least):
                    continue
                had += int(np.count_nonzero(mine[node.tokens]))
                most = had + min(size - had, node.most - node.depth)
                if (100 + percent) * most < percent * (size + node.least):
                    continue
                for j in node.sets:
                    if out[j] < 0 and 100 * had >= percent * (size + len(ordered[j]) - had):
                        out[j] = i
                        reach(j)
                        todo.append(j)
                walk += [(child, had) for child in node.below]
            mine[x] = False
    return out


def _links(n: int, percent: int):
    """Sorted rows (task, sig, text) to (a, b): each set with the first of those that it is connected with."""

    def solve(rows: dict[bytes, bytes | None]) -> pa.RecordBatch:
        found: list[np.ndarray] = []
        for _, data, bounds in text_chunks(pa.array(list(rows.values()), pa.binary())):
            s, at = sets(data, bounds, n)
            found += [s[a:b] for a, b in zip(at, at[1:])]
        names = list(rows)
        pairs = [(names[i], names[r]) for i, r in enumerate(joined(found, percent)) if i != r]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, {}
        for batch in batches:
            for t, sig, text in zip(batch["task"].to_pylist(), batch["sig"].to_pylist(), batch["text"].to_pylist()):
                if t != task and rows:
                    yield solve(rows)
                    rows = {}
                task = t
                rows[sig] = text
        if rows:
            yield solve(rows)

    return run


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, k (md5 of its text), n_shingles, sig (of its set) and component_id, the
    smallest id that links reach. Sets link when 100 * intersection >= percent * union.

    Texts without words, empty and null ones have no shingles and are components of their own. Rows that repeat an
    id or a text are rows of the result. Null ids never are a component's id unless all of its ids are null. An
    empty table gives an empty result. Other columns of docs are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text_key(F.col(text)), F.lit(b"")).alias("k"), F.col(text).cast("binary").alias("text"))
    marks = staged(rows.mapInArrow(_marks(n), "doc_id long, k binary, n_shingles long, sig binary, bucket int, rest binary"), "marks")
    of_docs = marks.filter("n_shingles is not null").select("doc_id", "k", "n_shingles", "sig")
    classes = staged(of_docs.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "k")).alias("at")), "classes")
    # at most MAX_COMMON numbers, the most frequent ones; they change the order of shingles, not the result
    counted = marks.filter("bucket is not null").select("bucket", "rest").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_frequent(COMMON), "key long, times long")
    common = np.sort(counted.orderBy(F.col("times").desc(), "key").limit(MAX_COMMON).select("key").toPandas()["key"].to_numpy(dtype=np.uint32))

    order = docs.sparkSession.sparkContext.broadcast(common)
    keys = rows.select("text").mapInArrow(_prefixes(n, percent, order), "key long, salt int, c long")
    # one pass over the keys; of keys in a single set nothing is left. Common keys are dealt out by salt first.
    least = F.min("c").over(Window.partitionBy("key", "salt"))
    shared = staged(keys.withColumn("least", least).filter("c != least or salt > 0"), "shared")
    salted = shared.filter("salt > 0").select("key", F.col("least").alias("c")).distinct()
    across = salted.withColumn("least", F.min("c").over(Window.partitionBy("key")))
    edges = shared.select("c", "least").unionByName(across.select("c", "least")).filter("c != least")
    blocks = components(edges.select(F.col("c").alias("a"), F.col("least").alias("b")).distinct())

    prefix = F.conv(F.hex(F.substring("sig", 1, 8)), 16, -10).cast("long")
    members = staged(classes.withColumn("node", prefix).join(blocks, "node").select(F.col("root").alias("block"), "sig", "n_shingles", "at.doc_id", "at.k"), "members")
    # texts are smaller than sets of hashes, so texts are dealt to the tasks and shingled there again
    work = members.join(_tasks(members, percent), "sig").select(F.col("doc_id").alias("id"), F.col("k").alias("text_k"), "sig", "task")
    dealt = rows.join(work, rows["doc_id"].eqNullSafe(work["id"]) & (rows["k"] == work["text_k"])).select("task", "sig", "text").repartition("task").sortWithinPartitions("task")
    roots = components(dealt.mapInArrow(_links(n, percent), "a binary, b binary"))

    label = classes.join(roots, classes["sig"] == roots["node"], "left").select("sig", "first_id", F.coalesce("root", "sig").alias("root"))
    least = label.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = label.join(least, "root").select("sig", "component_id")
    out = of_docs.join(named, "sig", "left")
    return out.select("doc_id", "k", "n_shingles", "sig", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _tasks(members: DataFrame, percent: int) -> DataFrame:
    """members(block, sig, n_shingles) -> sig, task: blocks of up to BLOCK shingles are a task; larger ones are cut by
    size into parts, and each pair of parts with sizes that can link is a task."""
    counted = members.groupBy("block").agg(F.sum("n_shingles").alias("held"))
    small = members.join(counted.filter(F.col("held") <= BLOCK), "block").select("sig", F.concat_ws(":", "block").alias("task"))
    large = members.join(counted.filter(F.col("held") > BLOCK), "block")
    before = F.sum("n_shingles").over(Window.partitionBy("block").orderBy("n_shingles", "sig"))
    large = staged(large.withColumn("part", F.floor(before / BLOCK)), "parts")
    ranges = large.groupBy("block", "part").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    a, b = ranges.alias("a"), ranges.alias("b")
    pairs = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.part") <= F.col("b.part")) & (F.col("b.least") * percent <= F.col("a.most") * 100)).select(F.col("a.block").alias("block"), F.array(F.col("a.part"), F.col("b.part")).alias("both"))
    of_part = pairs.select("block", F.explode(F.array_distinct("both")).alias("part"), F.concat_ws(":", "block", F.concat_ws("-", F.transform("both", lambda x: x.cast("string")))).alias("task"))
    return small.unionByName(large.join(of_part, ["block", "part"]).select("sig", "task"))
