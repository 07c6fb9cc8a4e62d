"""Dedup of byte strings by a sparse suffix array that all tasks sort together.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Suffixes are sorted from anchors:
of the grams of GRAM bytes inside any LENGTH bytes the one with the least hash is an anchor, so equal strings have an anchor
at the same place. What an anchor can decide lies in its context, LENGTH bytes ahead and LENGTH - GRAM bytes back.

Anchors whose gram stands nowhere else are no one's partner. The others' different contexts are sorted twice, by what lies
ahead (the suffix) and by what lies back, each time dealt out by ranges of the whole context, so that no group of equal
grams, prefixes or passages falls to one task. A task sorts its range deep-shallow: multikey quicksort on words of 8 bytes
down to SHALLOW bytes, then a blind trie for each group that is still alike. Contexts whose gram has no more than NEAR
others on either side in the first order are compared with all of them. Of other grams the neighbours in either order have
the longest common strings ahead and back, so they bound what a context shares with any other. Where a neighbour doesn't
reach the bound, a task sorts a gram that lies in its range alone by what lies back too, and a string that two contexts have
is a class in both orders; of grams that ranges cut, the strings that two contexts' bounds allow are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from folioloom.llm.common import discard, step

LENGTH, GRAM, SHALLOW = 200, 32, 40
#: Bytes that are hashed together, and contexts that a task sorts, about.
CHUNK, PART = 1 << 15, 1 << 17
#: Neighbours on either side that a context is compared with.
NEAR = 8
#: Stands in no UTF-8 text: ends a context that ends with its document.
END = 0xFF


def _gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """A hash for each gram, from words of 8 bytes doubled to the gram's length, a multiple of 8 by a power of two."""
    n = len(data) - gram + 1
    padded = data + bytes(16)
    v = np.empty(len(data), np.uint64)
    for k in range(min(8, len(data))):
        v[k::8] = np.frombuffer(padded, "<u8", (len(data) - k + 7) // 8, k)
    size = 8
    while size < gram:
        a, b = v[:-size] * np.uint64(0x9E3779B97F4A7C15), v[size:]
        a += (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(32)
        v, size = a * np.uint64(0x94D049BB133111EB), 2 * size
    return v[:n]


def _sliding(v: np.ndarray, width: int, fold: np.ufunc) -> np.ndarray:
    """fold over all windows of `width`, from windows of 1, 2, 4, ... that overlap."""
    size = 1
    while 2 * size <= width:
        v, size = fold(v[:-size], v[size:]), 2 * size
    rest = width - size
    return fold(v[: len(v) - rest], v[rest:]) if rest else v


def _anchors(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are least in some window of `length` bytes (all of them in a tie)."""
    v = _gram_hashes(data, gram)
    width = length - gram + 1
    if len(v) < width:
        return np.zeros(0, np.int64), v[:0]
    least = _sliding(v, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == v)
    return at, v[at]


def _anchored(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the text, places, hashes); short texts are hashed together, long ones in overlapping parts."""
    todo: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if not todo:
            return
        starts = np.cumsum([0, *(len(x[2]) + 1 for x in todo)])
        at, h = _anchors(bytes([END]).join(x[2] for x in todo), length, gram)
        part = np.searchsorted(starts, at, "right") - 1
        good = at + gram < starts[part + 1]
        at, h, part = at[good], h[good], part[good]
        cuts = np.searchsorted(part, np.arange(len(todo) + 1))
        for k, (i, offset, _) in enumerate(todo):
            yield i, at[cuts[k] : cuts[k + 1]] - starts[k] + offset, h[cuts[k] : cuts[k + 1]]

    for i, body in enumerate(texts):
        for start in range(0, max(len(body) - length, 0) + 1, CHUNK):
            piece = body[start : start + CHUNK + length - 1]
            todo.append((i, start, piece))
            held += len(piece)
            if held >= CHUNK:
                yield from flush()
                todo, held = [], 0
    yield from flush()


_MARKS = pa.schema([("k", pa.int64()), ("id", pa.int64()), ("pos", pa.list_(pa.int32())), ("gram", pa.list_(pa.int64())), ("ctx", pa.list_(pa.binary()))])


def _marker(length: int, gram: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k, id, text) -> the text's anchors: place, hash of the gram, digest of the context."""
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [x.as_buffer().to_pybytes() for x in part.column(2)]
                found: list[list[np.ndarray]] = [[] for _ in texts]
                for i, places, hashes in _anchored(texts, length, gram):
                    found[i].append(np.stack([places, hashes.view(np.int64)]))
                back, places, digests = length - gram, [], []
                for body, parts in zip(texts, found, strict=True):
                    both = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)
                    if len(parts) > 1:
                        both = both[:, np.unique(both[0], return_index=True)[1]]
                    places.append(both)
                    # the seed tells where in the context its anchor is
                    digests += [xxh3_128_digest(body[max(p - back, 0) : p + length], seed=min(p, back)) for p in both[0].tolist()]
                cuts = pa.array(np.cumsum([0, *(x.shape[1] for x in places)]), pa.int32())
                flat = np.concatenate(places, axis=1)
                offsets = np.arange(len(digests) + 1, dtype=np.int32) * 16
                ctx = pa.Array.from_buffers(pa.binary(), len(digests), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(digests))])
                lists = [pa.ListArray.from_arrays(cuts, x) for x in (pa.array(flat[0].astype(np.int32)), pa.array(flat[1]), ctx)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], names=_MARKS.names)

    return mark


def _cutter(length: int, gram: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text, wanted) -> ctx, many, ahead, back (from the anchor away), both of fixed length."""
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for body, wanted in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    body = body.as_buffer().to_pybytes()
                    for x in wanted:
                        p = x["pos"]
                        back = body[max(p - length + gram, 0) : p][::-1]
                        out.append((x["ctx"], x["many"], body[p : p + length].ljust(length, b"\xff"), back.ljust(length - gram, b"\xff")))
                columns = zip(*out, strict=True) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.binary(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["ctx", "many", "ahead", "back"])

    return cut


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the rows of words, all segments split by their pivots at once: (order, group of each place).
    Rows of one group have equal words."""
    order, seg = np.arange(len(words)), np.zeros(len(words), np.int64)
    depth = np.zeros(1, np.int64)
    while True:
        starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(seg) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(seg)])
        open_ = (sizes > 1) & (depth < words.shape[1])
        if not open_.any():
            return order, seg
        at = np.flatnonzero(np.repeat(open_, sizes))
        own = seg[at]
        value = words[order[at], depth[own]]
        middle = order[starts + sizes // 2]
        pivot = words[middle, np.minimum(depth, words.shape[1] - 1)][own]
        key = seg * 3
        key[at] += 1 + (value > pivot) - (value < pivot).astype(np.int64)
        by = np.argsort(key[at], kind="stable")
        order[at] = order[at][by]
        key[at] = key[at][by]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        depth = depth[key[first] // 3] + (open_[key[first] // 3] & (key[first] % 3 == 1))
        seg = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))


def blind_order(rows: list[bytes]) -> list[int]:
    """The order of equally long byte strings, by a blind trie: inner nodes hold a depth and a branch for each byte there. A
    string goes down by those bytes alone to some leaf, and one comparison with that leaf tells where it belongs."""
    size = len(rows[0])
    numbers = [int.from_bytes(x, "big") for x in rows]
    root: list | int = 0  # a leaf is an index, a node [depth, branches, leaves equal to each other]
    same: dict[int, list[int]] = {}
    for i in range(1, len(rows)):
        row, node = rows[i], root
        path = []
        while isinstance(node, list):
            path.append(node)
            branch = node[1].get(row[node[0]])
            node = branch if branch is not None else next(iter(node[1].values()))
        other = numbers[i] ^ numbers[node]
        if not other:
            same.setdefault(node, []).append(i)
            continue
        common = size - (other.bit_length() + 7) // 8
        above, below = None, root
        for x in path:
            if x[0] >= common:
                break
            above, below = x, x[1][row[x[0]]] if row[x[0]] in x[1] else None
        if isinstance(below, list) and below[0] == common:
            below[1][row[common]] = i
            continue
        fresh = [common, {row[common]: i, rows[node][common]: below}]
        if above is None:
            root = fresh
        else:
            above[1][row[above[0]]] = fresh
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out += [node, *same.get(node, ())]
    return out


def deep_shallow_order(table: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """The order of the rows of a table of bytes."""
    order, group = multikey_order(np.ascontiguousarray(table[:, :shallow]).view(">u8").astype(np.uint64))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        if b - a > 1:
            own = order[a:b]
            order[a:b] = own[blind_order([table[i].tobytes() for i in own])]
    return order


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that rows of a and b have in common from the left, as far as both go."""
    differ = (a != b) | (a == END)
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


_REACH = pa.schema([("ctx", pa.binary()), ("gram", pa.int64()), ("l", pa.int32()), ("r", pa.int32()), ("got_l", pa.int32()), ("got_r", pa.int32()), ("done", pa.bool_()), ("prev_l", pa.int32()), ("prev_r", pa.int32()), ("part", pa.int32()), ("edge", pa.int32()), ("key", pa.binary())])
REACH = "ctx binary, gram long, l int, r int, got_l int, got_r int, done boolean, prev_l int, prev_r int, part int, edge int, key binary"


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * width, column.offset * width).reshape(-1, width) if len(column) else np.zeros((0, width), np.uint8)


def _sides(keys: np.ndarray, length: int, gram: int, ahead_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ahead, back) of contexts in either form of key."""
    back = length - gram
    if ahead_first:
        return keys[:, :length], keys[:, length:]
    return np.concatenate([keys[:, :gram], keys[:, gram + back :]], 1), keys[:, gram : gram + back]


def _shared_in_group(ahead: np.ndarray, back: np.ndarray, length: int, known: np.ndarray) -> np.ndarray:
    """(got_l, got_r) of all contexts of one gram, in their order by what lies ahead; `known` are those so far. Contexts with
    a string in common that begins d bytes before the anchor are neighbours, by length - d bytes ahead and by d
    bytes back. Only the d that bounds allow and that neighbours leave open for some context are tried."""
    n = len(ahead)
    order = deep_shallow_order(back)
    r, l = _common(ahead[:-1], ahead[1:]), _common(back[order[:-1]], back[order[1:]])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    low = length - np.maximum(np.r_[r, 0], np.r_[0, r])
    high = np.maximum(np.r_[l, 0], np.r_[0, l])[place]
    none = known[0] < 0
    open_ = np.zeros(length + 2, np.int64)
    for a, b in ((low, np.where(none, high, np.minimum(high, length - known[1] - 1))), (np.where(none, high + 1, np.maximum(low, known[0] + 1)), high)):
        np.add.at(open_, a[a <= b], 1)
        np.add.at(open_, b[a <= b] + 1, -1)
    got = known.copy()
    for d in np.flatnonzero(np.cumsum(open_)).tolist():
        by_ahead, by_back = np.cumsum(np.r_[0, r < length - d]), np.cumsum(np.r_[0, l < d])[place]
        key = by_ahead * n + by_back
        by = np.argsort(key, kind="stable")
        equal = key[by[1:]] == key[by[:-1]]
        at = np.unique(np.concatenate([by[1:][equal], by[:-1][equal]]))
        got[0, at], got[1, at] = np.maximum(got[0, at], d), np.maximum(got[1, at], length - d)
    return got


def _sorter(length: int, gram: int, ahead_first: bool):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(ctx, many, gram, key) of one range -> for each context how far a neighbour shares it ahead (r) and back (l), how
        far one that shares `length` bytes does (got_r, got_l; -1: none), whether all others of its gram were met (done),
        what it shares with the one before it in the first order (prev_l, prev_r); the range's ends with their keys."""
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got).combine_chunks().to_batches()[0]
        keys = _rows(whole.column(3), 2 * length - gram)
        order = deep_shallow_order(keys)
        out, previous = np.full((4, len(order)), -1, np.int32), np.full((2, len(order)), -1, np.int32)
        met = np.zeros((2, len(order)), bool)
        same = whole.column(2).to_numpy()[order]
        for lo in range(0, len(order) - 1, 8192):
            hi = min(lo + 8192 + NEAR, len(order))
            ahead, back = _sides(keys[order[lo:hi]], length, gram, ahead_first)
            first = np.ascontiguousarray(back[:, :8]).view(np.uint64).ravel()
            reach = np.zeros(hi - lo - 1, np.int64)
            for s in range(1, min(NEAR if ahead_first else 1, hi - lo - 1) + 1):
                at = np.flatnonzero(same[lo : hi - s] == same[lo + s : hi])
                alone = np.flatnonzero(same[lo : hi - s] != same[lo + s : hi]) + lo
                met[0, alone] = met[1, alone + s] = True
                if s == 1:
                    l, r = _common(back[at], back[at + s]), _common(ahead[at], ahead[at + s])
                    reach[at] = r
                    if ahead_first:
                        previous[:, at + lo + 1] = l, r
                    apart = reach
                else:  # what they share ahead is the least of what those between share with the next
                    apart = np.minimum(apart[:-1], reach[s - 1 :])
                    at = at[(apart[at] > length - 8) | (first[at] == first[at + s])]
                    l, r = _common(back[at], back[at + s]), apart[at]
                enough = l + r >= length
                for where in (at + lo, at + lo + s):
                    for row, value in enumerate((l, r, np.where(enough, l, -1), np.where(enough, r, -1))):
                        out[row, where] = np.maximum(out[row, where], value)
        done = met.all(0) & ahead_first
        starts = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
        for a, b in zip(starts[1:-1].tolist(), starts[2:].tolist(), strict=True) if ahead_first else ():
            if not done[a:b].all():
                ahead, back = _sides(keys[order[a:b]], length, gram, True)
                out[2:, a:b] = _shared_in_group(ahead, back, length, out[2:, a:b])
                done[a:b] = True
        many = np.asarray(whole.column(1).to_numpy(zero_copy_only=False), bool)[order]
        for at in np.array_split(np.flatnonzero(many), max(many.sum() // 8192, 1)):
            ahead, back = _sides(keys[order[at]], length, gram, ahead_first)
            own_l, own_r = (back != END).sum(1), (ahead != END).sum(1)
            for row, value in enumerate((own_l, own_r, own_l, own_r)):
                out[row, at] = np.where(own_l + own_r >= length, value, out[row, at])
        task = TaskContext.get().partitionId()
        ctx, grams = whole.column(0).take(pa.array(order)), whole.column(2).take(pa.array(order))
        for lo in range(0, len(order), 16384):
            n = len(order[lo : lo + 16384])
            yield pa.RecordBatch.from_arrays([ctx.slice(lo, n), grams.slice(lo, n), *(pa.array(x[lo : lo + n]) for x in out), pa.array(done[lo : lo + n]), *(pa.array(x[lo : lo + n]) for x in previous), pa.array([task] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_REACH)
        ends = pa.array([0, len(order) - 1])
        none = pa.array([-1, -1], pa.int32())
        yield pa.RecordBatch.from_arrays([ctx.take(ends), grams.take(ends), none, none, none, none, pa.array([False, False]), none, none, pa.array([task] * 2, pa.int32()), pa.array([0, 1], pa.int32()), whole.column(3).take(pa.array(order[[0, -1]]))], schema=_REACH)

    return sort


def _joiner(length: int, gram: int, ahead_first: bool):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(ctx, gram, key, next_ctx, next_gram, next_key): the last context of a range with the first of the next."""
        for batch in batches:
            keys = np.concatenate([_rows(batch.column(i), 2 * length - gram) for i in (2, 5)])
            ahead, back = _sides(keys, length, gram, ahead_first)
            n = batch.num_rows
            l, r = _common(back[:n], back[n:]).astype(np.int32), _common(ahead[:n], ahead[n:]).astype(np.int32)
            got = [np.where(l + r >= length, x, -1).astype(np.int32) for x in (l, r)]
            for i in (0, 3):
                yield pa.RecordBatch.from_arrays([batch.column(i), batch.column(i + 1), *(pa.array(x) for x in (l, r, *got)), pa.array([False] * n), *[pa.array([-1] * n, pa.int32())] * 2, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_REACH)

    return join


def sorted_reach(contexts: DataFrame, parts: int, length: int, gram: int, ahead_first: bool) -> DataFrame:
    """contexts(ctx, many, gram, ahead, back) -> rows of REACH from one sort, the ends of neighbouring ranges compared too."""
    cut = F.substring("ahead", 1, gram), F.substring("ahead", gram + 1, length)
    key = F.concat("ahead", "back") if ahead_first else F.concat(cut[0], F.col("back"), cut[1])
    dealt = contexts.select("ctx", "many", "gram", key.alias("key")).repartitionByRange(parts, "key")
    found = step(dealt.mapInArrow(_sorter(length, gram, ahead_first), REACH), "reach")
    along = Window.orderBy("part", "edge")
    ends = found.filter("edge is not null").select("ctx", "gram", "key", "edge", *(F.lead(c).over(along).alias(f"next_{c}") for c in ("ctx", "gram", "key")))
    ends = ends.filter("edge = 1 and next_ctx is not null").drop("edge").repartition(1)
    return found.unionByName(ends.mapInArrow(_joiner(length, gram, ahead_first), REACH))


def _unproved(reach: DataFrame, length: int) -> DataFrame:
    """rows of REACH -> ctx, ds: for the grams whose neighbours leave it open whether some context shares `length` bytes
    further than they do, the lengths d of the part before the anchor that are in question and that this context's own
    bounds allow, each with `own`, whether it is in question for this one. Of contexts that follow each other in the first
    order with equal strings for a d, only the first stands for them."""
    low, high = F.lit(length) - F.col("r"), F.col("l")
    seq = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    before = seq(F.greatest(low, F.col("got_l") + 1), high)
    behind = seq(low, F.least(high, F.lit(length) - F.col("got_r") - 1))
    own = F.when(F.col("got_l") < 0, seq(low, high)).otherwise(F.array_union(before, behind))
    reach = reach.filter("not done").withColumn("own", own)
    asked = reach.select("gram", F.explode("own").alias("d")).distinct().groupBy("gram").agg(F.collect_list("d").alias("ds"))
    as_before = lambda d: (d <= F.col("prev_l")) & (F.lit(length) - d <= F.col("prev_r"))
    allowed = F.filter("ds", lambda d: (d <= F.col("l")) & (F.lit(length) - d <= F.col("r")) & ~as_before(d))
    ds = F.transform(allowed, lambda d: F.struct(d.alias("d"), F.array_contains("own", d).alias("own")))
    return reach.join(asked, "gram").select("ctx", ds.alias("ds")).filter(F.size("ds") > 0)


def _shared_windows(contexts: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """contexts(ctx, gram, ahead, back), open_(ctx, ds) -> ctx, got_l, got_r: strings of `length` bytes around an anchor that
    two contexts have. They are counted in each task first; only those in question are joined with the counts."""
    near = contexts.join(open_, "ctx").select("ctx", "gram", "ahead", "back", F.explode("ds").alias("x")).select("ctx", "gram", "ahead", "back", "x.*")
    string = F.concat(F.substring(F.col("back"), F.lit(1), F.col("d")), F.substring(F.col("ahead"), F.lit(1), F.lit(length) - F.col("d")))
    near = step(near.select("ctx", "gram", "d", "own", F.xxhash64("d", string).alias("string")), "windows")
    twice = near.groupBy("gram", "string").count().filter("count > 1").drop("count")
    return near.filter("own").join(twice, ["gram", "string"], "left_semi").select("ctx", F.col("d").alias("got_l"), (F.lit(length) - F.col("d")).cast("int").alias("got_r"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, cuts) -> doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256."""
    for batch in batches:
        out = []
        for doc_id, body, cuts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            body = body.as_buffer().to_pybytes() if body.is_valid else b""
            kept, n_spans, at = [], 0, 0
            if cuts.is_valid:
                inner = cuts.values
                both = np.stack([inner.field(0).to_numpy(), inner.field(1).to_numpy()])
                both = both[:, np.argsort(both[0], kind="stable")]
                reach = np.maximum.accumulate(both[1])
                apart = np.flatnonzero(np.r_[True, both[0][1:] > reach[:-1]])
                stops = reach[np.r_[apart[1:] - 1, len(reach) - 1]]
                for a, b in zip(both[0][apart].tolist(), stops.tolist(), strict=True):
                    kept.append(body[at:a])
                    n_spans, at = n_spans + 1, b
            kept.append(body[at:])
            kept = b"".join(kept)
            out.append((doc_id, len(body), len(body) - len(kept), n_spans, kept, sha256(kept).hexdigest()))
        columns = zip(*out, strict=True) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (*[pa.int64()] * 4, pa.binary(), pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def covered(docs: DataFrame, length: int, gram: int, part: int = PART) -> DataFrame:
    """docs(k, id, text) -> k, id, cuts: array of struct(first, stop), the bytes covered by a string that stands elsewhere."""
    long = docs.filter(F.octet_length("text") >= length)
    marks = step(long.mapInArrow(_marker(length, gram), "k long, id long, pos array<int>, gram array<long>, ctx array<binary>"), "anchors")
    flat = marks.select("k", "id", F.explode(F.arrays_zip("pos", "gram", "ctx")).alias("a")).select("k", "id", "a.pos", "a.gram", "a.ctx")
    again = step(flat.groupBy("gram").count().filter("count > 1").select("gram"), "grams")  # written, so that a frequent gram's join can be split
    found = step(flat.join(again, "gram", "left_semi"), "candidates")
    discard(marks, again)
    firsts = found.groupBy("ctx").agg(F.first("k").alias("k"), F.first("id").alias("id"), F.first("pos").alias("pos"), (F.count("*") > 1).alias("many"))
    wanted = firsts.groupBy("k", "id").agg(F.collect_list(F.struct("pos", "ctx", "many")).alias("wanted"))
    cut = long.dropDuplicates(["k", "id"]).join(wanted, ["k", "id"]).select("text", "wanted").mapInArrow(_cutter(length, gram), "ctx binary, many boolean, ahead binary, back binary")
    contexts = step(cut.withColumn("gram", F.xxhash64(F.substring("ahead", 1, gram))), "contexts", compression="zstd")
    parts = contexts.count() // part + 1
    most = [F.max(c).alias(c) for c in ("l", "r", "got_l", "got_r", "done", "prev_l", "prev_r")]
    sorts = [sorted_reach(contexts, parts, length, gram, ahead_first) for ahead_first in (True, False)]
    reach = step(sorts[0].unionByName(sorts[1]).groupBy("ctx", "gram").agg(*most), "reached")
    discard(*sorts)
    open_ = step(_unproved(reach, length), "unproved")
    spans = reach.select("ctx", "got_l", "got_r").unionByName(_shared_windows(contexts, open_, length)).groupBy("ctx").agg(*most[2:4])
    spans = step(spans.filter("got_l >= 0"), "spans")
    discard(contexts, reach, open_)
    cuts = found.select("k", "id", "pos", "ctx").join(spans, "ctx").select("k", "id", F.struct((F.col("pos") - F.col("got_l")).alias("first"), (F.col("pos") + F.col("got_r")).alias("stop")).alias("cut"))
    return cuts.groupBy("k", "id").agg(F.collect_set("cut").alias("cuts"))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, part: int = PART) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that are left), kept_sha256.

    A byte goes if a string of `length` bytes over it also starts elsewhere, in this or another row; strings end with their
    document and are judged on the input. Rows equal in id and text are two documents and lose all if they are long
    enough, with equal results. Null texts count as empty; texts below `length` bytes lose nothing; an empty table gives an
    empty result; only the two columns named are read. Texts are told apart by a 64-bit hash with their id, contexts
    by 128-bit digests, strings around one anchor by 64-bit hashes.
    """
    i = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k"), i.alias("id"), F.col(text).alias("text"))
    out = rows.join(covered(rows.select("k", "id", "text"), length, gram, part), ["k", "id"], "left").select("doc_id", "text", "cuts")
    return out.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
