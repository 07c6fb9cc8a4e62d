"""Runs of words that repeat with a period, found in tiles of each period octave.

A run with period q is a stretch over which words q apart are equal, so the starts of equal pairs fill an interval of
max(q, MIN_LENGTH - q) words or more. Octave o has the periods from 2^o below 2^(o+1). Its tiles are windows around
boundaries that stand so close that each such interval holds a boundary with a gram behind it. For a boundary c the
Z-value at shift q is how far the words from c on go on like those from c + q on, and that of the reversed words how far
it goes back; both end at the tile's edge. A shift whose gram differs at once has no run there, the others'
values come from hashes of stretches of 2, 4, 8, ... words. A tile's interval is a fragment; fragments are shuffled by
document and period and stitched where they touch.

A text of up to LONG words is cut into its tiles inside the task that reads it. Of longer ones each octave's tiles are rows
of their own that are dealt to all tasks: their length grows with the octave, so their number and that of the words
in them stay in proportion to the text for each octave.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.llm.common import staged, text_key

MIN_LENGTH, LONG = 12, 1 << 16
#: Words that are searched together.
CHUNK = 1 << 17
#: Gram behind a boundary and distance of the boundaries, for the octaves below 4; from there on both are half the octave.
SMALL = ((4, 4), (4, 4), (4, 3), (4, 4))


def words_of(doc_id: int | None, text: bytes | None) -> list[bytes]:
    """The words of a text, those of every tenth document (by the crc32 of its id) made periodic from a word on."""
    words = (text or b"").split()  # ASCII white space
    h, n = crc32(b"%d" % doc_id) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _ids(words: list[bytes]) -> np.ndarray:
    known = dict(zip(dict.fromkeys(words), count(), strict=False))
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _doubled(ids: np.ndarray, levels: int) -> list[np.ndarray]:
    """Hashes of the stretches of 1, 2, 4, ... words from each place on."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    out = [h * np.uint64(0xBF58476D1CE4E5B9)]
    for k in range(levels - 1):
        a, b = out[-1][: -(1 << k)], out[-1][1 << k :]
        h = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + (b ^ (b >> np.uint64(31))) * np.uint64(0xA0761D6478BD642F)
        out.append(h ^ (h >> np.uint64(33)))
    return out


def _reach(hashes: list[np.ndarray], top: int, c: np.ndarray, q: np.ndarray, back: bool) -> np.ndarray:
    """Z-values: how many words from c on (or before c) equal those q behind, up to 2^(top+1) - 1."""
    got = np.zeros(len(c), np.int64)
    for k in range(min(top, len(hashes) - 1), -1, -1):
        at = c - got - (1 << k) if back else c + got
        inside = (at >= 0) & (at + q < len(hashes[k]))
        at = np.where(inside, at, 0)
        got += np.where(inside & (hashes[k][at] == hashes[k][np.where(inside, at + q, 0)]), 1 << k, 0)
    return got


def _octave(hashes: list[np.ndarray], o: int, n: int, min_length: int) -> tuple[np.ndarray, ...]:
    """Fragments (q, first, last) of the first n words with periods of octave o that no shorter period makes."""
    gram, step = SMALL[o] if o < 4 else (1 << (o - 1), 1 << (o - 1))
    h = hashes[gram.bit_length() - 1][: max(n - gram + 1, 0)]
    low, high = 1 << o, 2 << o
    found: list[tuple[np.ndarray, np.ndarray]] = []
    starts = h[::step]
    if len(starts) < low:  # few boundaries: all shifts of one at once
        for c in range(0, len(h), step):
            hits = np.flatnonzero(h[c + low : c + high] == h[c])
            found.append((np.full(len(hits), c), hits + low))
    else:
        for q in range(low, min(high, len(h))):
            other = h[q::step]
            hits = np.flatnonzero(starts[: len(other)] == other)
            found.append((hits * step, np.full(len(hits), q)))
    c, q = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    top = max(o + 1, 3)
    back, ahead = _reach(hashes, top, c, q, True), _reach(hashes, top, c, q, False)
    good = back + ahead >= np.maximum(q, min_length - q)
    c, q, first, last = c[good], q[good], (c - back)[good], (c + ahead)[good]
    # a divisor of q that is a period of two of its repeats is one of the whole run
    whole = np.ones(len(q), bool)

    def strike(at: np.ndarray, r: np.ndarray) -> None:
        shift, s, level = q[at] // r, first[at], hashes[o]
        end = s + q[at] - (1 << o)
        whole[at] &= ~((level[s] == level[s + shift]) & (level[end] == level[end + shift]))

    rest, r = q.copy(), 2
    while r * r <= rest.max(initial=1):
        if len(at := np.flatnonzero(rest % r == 0)):
            strike(at, np.full(len(at), r))
        while (more := rest % r == 0).any():
            rest[more] //= r
        r += 1
    at = np.flatnonzero(rest > 1)
    strike(at, rest[at])
    return q[whole], first[whole], last[whole]


def _fragments(texts: list[np.ndarray], octaves: range | None = None, min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """For each text (as numbers of its words) the fragments (period, start, stop of the starts of equal pairs), those
    that touch made one. The texts are searched as one array in which no two share a number, the longest first."""
    order = sorted((i for i in range(len(texts)) if len(texts[i]) >= min_length), key=lambda i: -len(texts[i]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not order:
        return out
    sizes = np.array([len(texts[i]) for i in order])
    ends = np.cumsum(sizes)
    most = np.array([texts[i].max() + 1 for i in order])
    joined = np.concatenate([texts[i] for i in order]) + np.repeat(np.cumsum(most) - most, sizes)
    top = int(sizes[0]).bit_length()
    hashes = _doubled(joined, top + 1)
    parts = []
    for o in octaves if octaves is not None else range(top):
        n = int(ends[np.searchsorted(-sizes, -max(2 << o, min_length), "right") - 1]) if sizes[0] >= max(2 << o, min_length) else 0
        if n:
            parts.append(_octave(hashes, o, n, min_length))
    q, first, last = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
    doc = np.searchsorted(ends, first, "right")
    by = np.lexsort((first, q, doc))
    q, first, last, doc = q[by], first[by], last[by], doc[by]
    base = ends - sizes
    for d, p, a, b in zip(doc.tolist(), q.tolist(), (first - base[doc]).tolist(), (last - base[doc]).tolist(), strict=True):
        own = out[order[d]]
        if own and own[-1][0] == p and own[-1][2] >= a:
            own[-1] = (p, own[-1][1], max(b, own[-1][2]))
        else:
            own.append((p, a, b))
    return out


_FRAGMENT = pa.struct([("period", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("k", pa.binary()), ("n_words", pa.int64()), ("plain", pa.string()), ("text", pa.string()), ("fragments", pa.list_(_FRAGMENT)), ("tiles", pa.list_(pa.struct([("octave", pa.int64()), ("octaves", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])))])
READ = "doc_id long, k binary, n_words long, plain string, text string, fragments array<struct<period:long,first:long,last:long>>, tiles array<struct<octave:long,octaves:long,start:long,ids:binary>>"


def _tiles(ids: np.ndarray, long: int) -> list[tuple[int, int, int, bytes]]:
    """A long text's tiles: (first octave, number of octaves, start, ids as int32). One tile size serves all octaves that
    need no longer one; a tile holds 16 octaves' lengths and overlaps the next by half."""
    n, out = len(ids), []
    ids = ids.astype("<i4")
    octaves = range(n.bit_length())
    base = max(long.bit_length() - 5, 0)  # the last octave of which 16 lengths fit in a tile of `long`
    groups = [(0, min(base + 1, len(octaves)))] + [(o, 1) for o in octaves[base + 1 :]]
    for o, many in groups:
        size = 16 << (o + many - 1)
        for start in range(0, max(n - size // 2, 1), size // 2):
            out.append((o, many, start, ids[start : start + size].tobytes()))
    return out


def _reader(long: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, k, text) -> a row with its fragments, or tiles if it is long; texts without either are done."""
        for batch in batches:
            at = 0
            ids, keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            while at < batch.num_rows:
                rows, held = [], 0
                while at < batch.num_rows and held < CHUNK:
                    words = words_of(ids[at], texts[at].as_buffer().to_pybytes() if texts[at].is_valid else None)
                    rows.append((at, words, _ids(words)))
                    held += len(words)
                    at += 1
                short = [x[2] if len(x[2]) <= long else x[2][:0] for x in rows]
                out = []
                for (i, words, numbers), fragments in zip(rows, _fragments(short), strict=True):
                    tiles = _tiles(numbers, long) if len(numbers) > long else []
                    open_ = bool(fragments or tiles)
                    plain = None if open_ else sha256(b" ".join(words)).hexdigest()
                    out.append((ids[i], keys[i], len(words), plain, texts[i].as_py() if open_ else None, fragments, tiles))
                columns = list(zip(*out, strict=True))
                columns[5] = [[dict(zip(("period", "first", "last"), f, strict=True)) for f in x] for x in columns[5]]
                columns[6] = [[dict(zip(("octave", "octaves", "start", "ids"), t, strict=True)) for t in x] for x in columns[6]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _READ, strict=True)], schema=_READ)

    return read


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of long texts (doc_id, k, octave, octaves, start, ids) -> their fragments."""
    for batch in batches:
        for doc_id, k, o, many, start, ids in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            found = _fragments([np.frombuffer(ids, "<i4").astype(np.int64)], range(o, o + many))[0]
            if found:
                q, a, b = (np.array(x, np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(q), pa.int64()), pa.array([k] * len(q), pa.binary()), pa.array(q), pa.array(a + start), pa.array(b + start)], ["doc_id", "k", "period", "first", "last"])


def stitched(fragments: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """fragments(doc_id, k, period, first, last) -> doc_id, k, start, length, period: intervals of a document and period that
    touch are one, and what is long enough is a run."""
    w = Window.partitionBy("doc_id", "k", "period").orderBy("first", "last")
    reached = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = fragments.withColumn("apart", F.when(F.col("first") <= reached, 0).otherwise(1)).withColumn("part", F.sum("apart").over(w))
    runs = parts.groupBy("doc_id", "k", "period", "part").agg(F.min("first").alias("start"), F.max("last").alias("last"))
    runs = runs.withColumn("length", F.col("last") - F.col("start") + F.col("period"))
    return runs.filter((F.col("length") >= min_length) & (F.col("length") >= 2 * F.col("period"))).select("doc_id", "k", "start", "length", "period")


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """(rows, runs): rows(doc_id, k, n_words, plain, text), one for each row of docs, where texts that can have no run
    have the digest `plain` of their words and no text; and runs(doc_id, k, start, length, period)."""
    i = F.col(doc_id).cast("long")
    key = text_key(F.concat(F.coalesce(i.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))
    rows = staged(docs.select(i.alias("doc_id"), key.alias("k"), F.col(text).alias("text")).mapInArrow(_reader(long), READ), "words")
    near = rows.select("doc_id", "k", F.explode("fragments").alias("f")).select("doc_id", "k", "f.*")
    tiles = rows.filter(F.size("tiles") > 0).select("doc_id", "k", F.explode("tiles").alias("t")).select("doc_id", "k", "t.*")
    far = tiles.repartition("k", "octave", "start").mapInArrow(_solve, "doc_id long, k binary, period long, first long, last long")
    return rows.select("doc_id", "k", "n_words", "plain", "text"), stitched(near.unionByName(far))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, plain, starts, lengths, periods) -> the digests of the runs and of the words that stay."""
    for batch in batches:
        out = []
        for doc_id, body, plain, runs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            runs = sorted((x["start"], x["length"], x["period"]) for x in runs or ())
            listed = sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
            if plain is None:
                words = words_of(doc_id, body.encode())
                gone = np.zeros(len(words) + 1, np.int64)
                for s, n, p in runs:
                    gone[s + p] += 1
                    gone[s + n] -= 1
                keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
                plain = sha256(b" ".join([words[i] for i in keep])).hexdigest()
            s, n, p = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
            out.append((doc_id, len(runs), s, n, p, 1000 * n // p if runs else None, listed, plain))
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names)


def collapsed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", long: int = LONG) -> DataFrame:
    """One row for each row of docs: doc_id, n_runs, the longest run (start, length, period, exponent_milli), and digests of
    all runs and of the text without its repeats: the words after a run's first period go.

    Null and empty texts have no words and no runs; a null id makes no text periodic; rows equal in id and text have equal
    results, as the shuffles know a row by its id and the md5 of both. An empty table gives an empty result. Only the
    two columns named are read. Words of a text are told apart exactly, stretches of them by 64-bit hashes.
    """
    rows, runs = periodic_runs(docs, text, doc_id, long)
    own = runs.groupBy("k").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    done = rows.filter("plain is not null").select("doc_id", "text", "plain", F.lit(None).cast("array<struct<start:long,length:long,period:long>>").alias("runs"))
    open_ = rows.filter("plain is null").join(own, "k", "left").select("doc_id", "text", "plain", "runs")
    result = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return done.unionByName(open_).mapInArrow(_collapse, result)
