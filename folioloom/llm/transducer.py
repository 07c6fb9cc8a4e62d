"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled into four machines. The normaliser writes a mark before the text and for each space, and
every other character as it is; it is composed with the alphabet of the pieces, so texts are read as they are. The
piece machine is a trie whose arcs read characters and write ids; a piece weighs minus its score. Where a character
has no piece, byte arcs spell its UTF-8 bytes. The pair acceptor reads the written ids: for a byte-pair model piece b
may follow piece a only if merging their joint text never merges across the border between them, every other pair
weighs infinity; for a model of the unigram kind all pairs weigh nothing.

The composition with an input is a lattice of arcs between its positions, and the encoding is the path of least
weight in it (the tropical semiring: weights add along a path, the least of all paths counts). Under the pair
acceptor the best path to a position is the byte-pair encoding of the text up to there, so the last piece is all of
the acceptor's state that a position has to keep. Lattices of many inputs are built and solved together in numpy.

No piece crosses from another character into a mark, so texts fall into segments, each a run of marks and the
characters up to the next mark; segments that repeat are composed once in a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_KEEP, _PAIRS = 500_000, 1 << 20  # segments and pairs that a task keeps
_AT_ONCE = 1 << 20  # characters whose lattices are solved together; a longer segment is solved alone
_ROWS = 1000  # texts that are encoded together
_SEGMENT = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
_UNKNOWN, _NONE = -2, -1
_FAR = 1e3  # weight of a character without a piece


@dataclass(frozen=True)
class Vocabulary:
    """What the machines are compiled from."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str  # for each piece n (ordinary), b (a byte) or - (never encoded)
    pairs: bool  # a byte-pair model
    unknown: int

    @staticmethod
    def load(path: str = MODEL_FILE) -> Vocabulary:
        """Read a model file on the driver. Normalisers other than the identity, white space removal and marks
        behind words are refused."""
        from sentencepiece import sentencepiece_model_pb2 as model

        m = model.ModelProto()
        m.ParseFromString(Path(path).read_bytes())
        spec = m.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only an identity normaliser with a mark before the text is compiled")
        kind = {1: "n", 4: "n", 6: "b"}
        kinds = "".join(kind.get(p.type, "-") for p in m.pieces)
        return Vocabulary(tuple(p.piece for p in m.pieces), tuple(p.score for p in m.pieces), kinds, m.trainer_spec.model_type == 2, m.trainer_spec.unk_id)


class Table:
    """Numbers by 64-bit keys that are not negative, looked up for many keys at once (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of keys that want one place the last is let in
            there = self.keys[at] == keys
            self.values[at[there]] = values[there]
            keys, values, at = keys[~there], values[~there], self._next(at[~there])

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; _NONE for keys that are not there."""
        at = self._home(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], _NONE)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        at = at[todo]
        while len(todo):
            at = self._next(at)
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (held >= 0)
            todo, at = todo[on], at[on]
        return out


def merge_steps(text: str, ids: dict[str, int], scores: tuple[float, ...]) -> list[tuple[list[str], float]]:
    """Byte-pair merging as defined, the best-scored neighbouring pair first, the leftmost of equals: the parts before
    each merge with the score of that merge, and the last parts with a score of minus infinity."""
    parts, out = list(text), []
    while True:
        found = [(scores[i], -k) for k in range(len(parts) - 1) if (i := ids.get(parts[k] + parts[k + 1])) is not None]
        best = max(found, default=None)
        out.append((list(parts), best[0] if best else -np.inf))
        if best is None:
            return out
        k = -best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


@dataclass(frozen=True)
class Machines:
    """The compiled machines as arrays of a fixed size, sent to every task.

    symbols: code points of the alphabet, with their symbols (the normaliser is composed in: a space has the symbol of
    the mark; 0 stands for characters without a piece). arcs: node * width + symbol to node; ends: the piece that
    ends in a node, or _NONE. joins: a * pieces + b to the piece that a and b make. steps: where the history of a
    piece begins; first, last and head: the first and last part of the piece before each merge, and its score.
    """

    pairs: bool
    unknown: int
    symbols: tuple[np.ndarray, np.ndarray]
    width: int
    arcs: Table
    ends: np.ndarray
    weights: np.ndarray
    joins: Table
    steps: np.ndarray
    first: np.ndarray
    last: np.ndarray
    head: np.ndarray
    surface: list[bytes]
    byte_ids: dict[int, int]


@lru_cache(maxsize=4)
def compiled(v: Vocabulary) -> Machines:
    ids = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == "n"}
    if v.pairs and not all(c in ids for c in set("".join(ids))):
        raise ValueError("a byte-pair model whose characters are no pieces is not compiled")
    if any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError("a model with marks inside pieces is not compiled")
    n = len(v.pieces)
    steps, first, last, head = np.zeros(n, np.int64), [], [], []
    reached = set()
    if v.pairs:
        for p, i in ids.items():
            steps[i] = len(head)
            history = merge_steps(p, ids, v.scores)
            if len(history[-1][0]) == 1:
                reached.add(i)
            for parts, score in history:
                first.append(ids[parts[0]])
                last.append(ids[parts[-1]])
                head.append(score)
    cuts = [(ids[p[:k]] * n + ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids] if v.pairs else []
    alphabet = {c: k for k, c in enumerate(sorted(set("".join(ids)) | {MARK}), 1)}
    width = len(alphabet) + 1
    nodes: dict[int, int] = {}
    ends = [_NONE]
    for p, i in ids.items():
        node = 0
        for c in p:
            node = nodes.setdefault(node * width + alphabet[c], len(ends))
            if node == len(ends):
                ends.append(_NONE)
        if not v.pairs or i in reached:
            ends[node] = i
    reads = alphabet | {" ": alphabet[MARK]}
    numbers = lambda x, kind: np.fromiter(x, kind, len(x))
    return Machines(
        v.pairs, v.unknown, (numbers(list(map(ord, reads)), np.int64), numbers(list(reads.values()), np.int32)), width,
        Table(numbers(nodes.keys(), np.int64), numbers(nodes.values(), np.int32)), np.array(ends, np.int32), -np.array(v.scores),
        Table(np.array([k for k, _ in cuts], np.int64), np.array([i for _, i in cuts], np.int32)),
        steps, np.array(first, np.int64), np.array(last, np.int64), np.array(head),
        [bytes([int(p[3:5], 16)]) if k == "b" else p.encode() if k == "n" else b"" for p, k in zip(v.pieces, v.kinds)],
        {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == "b"},
    )


class Composer:
    """Composes the machines with inputs, and keeps segments and pairs that were met before."""

    def __init__(self, machines: Machines) -> None:
        self.m = machines
        self.read = np.zeros(0x110000, np.int32)
        self.read[machines.symbols[0]] = machines.symbols[1]
        self.mark = int(self.read[ord(MARK)])
        self.known: dict[str, bytes] = {}
        self.pair_keys, self.pair_open = np.full(_PAIRS, -1, np.int64), np.zeros(_PAIRS, bool)

    def survives(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the border between pieces a and b outlives the merging of their joint text. Both sides merge as they
        would alone, the better merge first, until a merge across the border is better than the next of either."""
        m, n = self.m, len(self.m.weights)
        at, bt = m.steps[a], m.steps[b]
        todo, out = np.arange(len(a)), np.ones(len(a), bool)
        while len(todo):
            joint = m.joins.get(m.last[at] * n + m.first[bt])
            across = np.where(joint >= 0, -m.weights[joint], -np.inf)
            left, right = m.head[at], m.head[bt]
            merged = (joint >= 0) & (across > left) & (across >= right)
            out[todo[merged]] = False
            on = ~merged & ((left > -np.inf) | (right > -np.inf))
            step = left >= right
            todo, at, bt = todo[on], (at + step)[on], (bt + ~step)[on]
        return out

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pair acceptor has an arc for each piece of b after that of a; anything may follow no piece."""
        out = np.ones(len(a), bool)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[at].astype(np.int64) * len(self.m.weights) + b[at]
        place = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) & (_PAIRS - 1)
        known = self.pair_open[place]
        miss = np.flatnonzero(self.pair_keys[place] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            found = self.survives(new // len(self.m.weights), new % len(self.m.weights))
            known[miss] = found[back]
            self.pair_keys[place[miss]], self.pair_open[place[miss]] = key[miss], known[miss]
            clash = self.pair_keys[place[miss]] != key[miss]  # two new pairs with one place: keep neither
            self.pair_keys[place[miss[clash]]] = -1
        out[at] = known
        return out

    def lattice(self, symbols: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs (from position, length, piece) of the piece machine and its byte fallback over all segments; limit is
        the end of each position's segment."""
        at, node = np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
        single = np.zeros(len(symbols), bool)
        found, n = [], 0
        while len(at):
            node = self.m.arcs.get(node * self.m.width + symbols[at + n]).astype(np.int64)
            on = node >= 0
            at, node, n = at[on], node[on], n + 1
            piece = self.m.ends[node]
            whole = piece >= 0
            found.append((at[whole], np.full(int(whole.sum()), n), piece[whole]))
            if n == 1:
                single[at[whole]] = True
            on = at + n < limit[at]
            at, node = at[on], node[on]
        none = np.flatnonzero(~single)
        found.append((none, np.ones(len(none), np.int64), np.full(len(none), _UNKNOWN, np.int32)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def shortest_paths(self, segments: list[str]) -> list[bytes]:
        """Ids on the path of least weight of each segment, as 32-bit numbers."""
        if not segments:
            return []
        length = np.fromiter(map(len, segments), np.int64, len(segments)) + 1
        points = np.frombuffer((MARK + MARK.join(segments)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        symbols = self.read[points].astype(np.int64)
        begin = np.cumsum(length) - length
        of = np.repeat(np.arange(len(segments)), length)
        start, size, piece = self.lattice(symbols, np.repeat(begin + length, length))
        # places: a segment of n characters has n + 1
        source = start + of[start]
        offset = start - begin[of[start]] + size
        order = np.argsort(offset, kind="stable")
        source, size, piece = source[order], size[order], piece[order]
        cost = np.where(piece >= 0, self.m.weights[piece], _FAR)
        weight = np.full(len(symbols) + len(segments), np.inf)
        last, came = np.full(len(weight), _NONE, np.int32), np.zeros(len(weight), np.int64)
        weight[begin + np.arange(len(segments))] = 0
        bounds = np.searchsorted(offset[order], np.arange(1, int(length.max()) + 2))
        for a, b in zip(bounds[:-1], bounds[1:]):
            src, pc = source[a:b], piece[a:b]
            total = weight[src] + cost[a:b]
            if self.m.pairs:
                open_ = np.flatnonzero(np.isfinite(total))
                open_ = open_[self.follows(last[src[open_]], pc[open_])]
                src, pc, total = src[open_], pc[open_], total[open_]
                to = src + size[a:b][open_]
            else:
                to = src + size[a:b]
            np.minimum.at(weight, to, total)
            best = (total == weight[to]) & np.isfinite(total)
            last[to[best]], came[to[best]] = pc[best], src[best]
        # walk back from the ends of all segments at once
        place, on = begin + length + np.arange(len(segments)), np.arange(len(segments))
        seg, ids = [], []
        stop = begin + np.arange(len(segments))
        while len(on):
            seg.append(on)
            ids.append(np.where(last[place] >= 0, last[place], -2 - points[np.minimum(came[place] - on, len(points) - 1)]))
            place = came[place]
            more = place > stop[on]
            on, place = on[more], place[more]
        seg, ids = np.concatenate(seg[::-1]), np.concatenate(ids[::-1])
        by_segment = np.argsort(seg, kind="stable")
        ids = ids[by_segment]
        count = np.bincount(seg, minlength=len(segments))
        spelled = np.flatnonzero(ids < 0)
        if len(spelled):
            by = {i: self._bytes(-2 - i) for i in set(ids[spelled].tolist())}
            room = np.ones(len(ids), np.int64)
            room[spelled] = [len(by[i]) for i in ids[spelled].tolist()]
            count = np.add.reduceat(room, np.cumsum(count) - count)
            more = np.repeat(ids, room)
            more[more < 0] = list(chain.from_iterable(by[i] for i in ids[spelled].tolist()))
            ids = more
        flat, at = ids.astype(np.int32).tobytes(), (4 * np.r_[0, np.cumsum(count)]).tolist()
        return [flat[a:b] for a, b in zip(at, at[1:])]

    def _bytes(self, point: int) -> list[int]:
        return [self.m.byte_ids.get(x, self.m.unknown) for x in chr(point).encode("utf-8", "surrogatepass")]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers. A segment is named by what follows its first mark."""
        cut = []
        for text in texts:
            if not text:
                cut.append([])
            elif text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text:
                cut.append(text.split(" "))
            else:
                cut.append([s[1:] for s in _SEGMENT.findall(" " + text)])
        new = list(set().union(*cut).difference(self.known))
        if len(self.known) + len(new) > _KEEP:
            self.known = {}
            new = list(set().union(*cut))
        k = 0
        while k < len(new):
            some, held = k, 0
            while k < len(new) and (k == some or held + len(new[k]) < _AT_ONCE):
                held += len(new[k]) + 1
                k += 1
            self.known.update(zip(new[some:k], self.shortest_paths(new[some:k])))
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, ids: list[int]) -> str:
        """The inverse machine: surfaces end to end, marks to spaces, without the mark before the text."""
        out = b"".join(map(self.m.surface.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return out[1:] if out.startswith(" ") else out


def _encoded(machines, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        composer = Composer(machines.value)
        for batch in batches:
            keep = [n for n in batch.schema.names if n != "text"]
            for k in range(0, len(batch), _ROWS):
                some = batch.slice(k, _ROWS)
                texts = [t or "" for t in some["text"].to_pylist()]
                found = composer.encode(texts)
                at = np.r_[0, np.cumsum([len(x) // 4 for x in found])].astype(np.int32)
                flat = np.frombuffer(b"".join(found), np.int32)
                same = [None] * len(texts)
                if check:
                    same = [composer.decode(flat[a:b].tolist()) == t.replace(MARK, " ") for t, a, b in zip(texts, at, at[1:])]
                ids = pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(some[n] for n in keep), ids, pa.array(same, pa.bool_())], [*keep, "ids", "round_trip"])

    return run


def _sent(docs: DataFrame, model_file: str):
    return docs.sparkSession.sparkContext.broadcast(compiled(Vocabulary.load(model_file)))


def encode(docs: DataFrame, text: str = "text", model_file: str = MODEL_FILE, check: bool = False) -> DataFrame:
    """Every row of docs as struct `row`, with ids array<int> and, if check is set, round_trip: whether decoding
    gives the text again (marks in a text come back as spaces). Null and empty texts have no ids. Repeated rows are
    encoded as often as they stand; an empty table gives an empty table. Equal weights do not occur for byte-pair
    models; for others the longer last piece wins. Columns of docs may have any names: they stay in `row`."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    schema = StructType([rows.schema["row"], StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())])
    return rows.mapInArrow(_encoded(_sent(docs, model_file), check), schema)


def _decoded(machines):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        composer = Composer(machines.value)
        for batch in batches:
            keep = [n for n in batch.schema.names if n != "ids"]
            texts = [composer.decode(ids or []) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in keep), pa.array(texts, pa.string())], [*keep, "decoded"])

    return run


def decode(docs: DataFrame, ids: str = "ids", model_file: str = MODEL_FILE) -> DataFrame:
    """Every row of docs as struct `row`, with decoded: the text of its ids; empty for null and empty ids. Repeated
    rows are decoded as often as they stand; an empty table gives an empty table."""
    rows = docs.select(F.struct("*").alias("row"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decoded(_sent(docs, model_file)), StructType([rows.schema["row"], StructField("decoded", StringType())]))
