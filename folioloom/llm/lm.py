"""LM scoring: a causal self-attention model over subword ids, trained and applied in numpy.

A text is its words (ASCII lower case) and one end. Words are spelled in the pieces of a public SentencePiece
model, whose first one starts with a mark, so a text is one row of pieces in which each word and the end begin with a
starting piece. The attention model reads windows of 16 pieces that overlap by half; each window scores its last 8
pieces, so that every piece is scored once with at least 8 before it. It gives the class of the next piece; the
piece within the class follows from its predecessor in the word by counts over all training documents. Starting
pieces and others are in different classes, so the model also gives the probability that a word ends.

Given the text before it, a word's first piece has its probability among the starting pieces. What follows in the word
is the mean of two distributions: the word's share of all training words with that first piece, and the model's
probability of its other pieces and of the word's end. The first weighs n / (n + k) for n training words, k of them
different, with that piece (Witten and Bell's estimate). A small part of each word's probability is its share of the words
that the text had before it. Over all words these probabilities sum to at most 1.

Counts of words and of piece pairs cover all training documents. Words that make up 1 / HEAD of the corpus or
more are at most HEAD, so they are sent to every task; all other words meet their counts in a join, where none
is frequent. The attention weights are fitted on all stretches of STRETCH words of all training documents (one in SHARE), dealt to rounds by the
hash of what a stretch holds: in each round every task goes on from the same weights over its windows of the
round, and the mean of the tasks' weights, by the pieces that they saw, opens the next round. So the last digits of
scores depend on how the table is cut into tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat
from pathlib import Path
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import as_strided
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.llm.common import discard, staged, step
from folioloom.llm.labelled import fold_of
from folioloom.llm.shingles import mixed

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
HEAD = 500_000
#: Share of the pieces' own frequencies in their probabilities, so that none is far below what it is by itself.
ALONE = 0.02
#: Share that the text's own words reach in a word's probability, and how many there are when it is half of that.
RECALL, HALF_RECALL = 0.1, 30
#: Pieces with an output of their own (the last two stand for all other starting and other pieces), predecessors told
#: apart, width of the model, pieces in a window.
OUT, PREV, DIM, SPAN = 4096, 1024, 16, 16
#: Frequent outputs with a class of their own, classes for the other starting pieces and as many for the others.
OWN, GROUPS = 40, 12
CLASSES = OWN + 2 * GROUPS
#: The attention weights see one stretch of STRETCH words in SHARE, which is every one, in ROUNDS rounds a pass; passes are repeated up to
#: EPOCHS times until FIT_WINDOWS windows were seen.
SHARE, STRETCH, ROUNDS, FIT_WINDOWS, EPOCHS = 1, 32, 6, 120_000, 8
#: Bytes of texts that a task makes windows of at once.
SLICE = 1 << 20
_KEEP, _FLUSH, _HALF = 300_000, 300_000, SPAN // 2
_PLACES = 128 * _HALF  # places that are scored at once
_MARK = "\u2581"


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different lower-cased words of texts, the end (the empty word) first; the words of all texts by their
    numbers among these, each text's end behind it; and the number of each text's tokens."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = cut.flatten().dictionary_encode()
    words = pa.concat_arrays([pa.array([b""]), coded.dictionary.cast(pa.binary())])
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(cut).to_numpy(zero_copy_only=False))
    empty = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) == 0)
    if len(empty) > 1:  # white space at the ends of a text
        full = codes != empty[1]
        codes, of = codes[full], of[full]
    n = np.bincount(of, minlength=len(texts)) + 1
    out = np.zeros(int(n.sum()), np.int64)
    out[np.arange(len(codes)) + of] = codes
    return words, out, n


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """texts in parts of SLICE bytes, or of one text: windows and the arrays that they are made with take some hundred times a
    word's bytes, so a task must not make them of a whole batch."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, SLICE + (size[at - 1] if at else 0), "right")))
        yield texts.slice(at, end - at)
        at = end


def _listed(words: pa.Array) -> list[bytes]:
    """The words as Python objects; many times faster than to_pylist."""
    return words.to_numpy(zero_copy_only=False).tolist()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and how often they stand, added up in Arrow while they are few."""
    held: list[pa.Table] = []

    def added() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

    rows = 0
    for batch in batches:
        for at in range(0, len(batch), 1000):
            words, codes, _ = _tokens(batch["text"].slice(at, 1000))
            held.append(pa.table({"word": words, "c": np.bincount(codes, minlength=len(words)).astype(np.int64)}))
            rows += len(words)
            if rows > 2 * _FLUSH:
                held = [added()]
                rows = len(held[0])
                if rows > _FLUSH:
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from added().to_batches()


class Speller:
    """Words to piece ids, in order of need; the end has an id of its own behind all pieces."""

    def __init__(self, model: bytes, counts: dict[bytes, int] | None = None) -> None:
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_proto=model)
        self.end = self.sp.vocab_size()
        self.starts = np.array([*(self.sp.id_to_piece(i).startswith(_MARK) for i in range(self.end)), True])
        self.counts = counts or {}
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0
        self.start, self.length, self.count = np.zeros((3, 1 << 18), np.int64)

    def add(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words among those that are kept."""
        found = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        miss = np.flatnonzero(found < 0)
        new = list(dict.fromkeys(words[i] for i in miss.tolist()))
        if len(self.known) + len(new) > _KEEP:
            self.clear()
            miss = np.arange(len(words))
            new = list(dict.fromkeys(words))
        if len(miss):
            ids, length = self._spelled(new)
            k, n = len(self.known), int(length.sum())
            while self.used + n > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while k + len(new) > len(self.start):
                self.start, self.length, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.count))
            self.flat[self.used : self.used + n] = ids
            self.start[k : k + len(new)] = self.used + np.cumsum(length) - length
            self.length[k : k + len(new)] = length
            self.count[k : k + len(new)] = np.fromiter(map(self.counts.get, new, repeat(0)), np.int64, len(new))
            self.known.update(zip(new, range(k, k + len(new))))
            self.used += n
            if len(new) == len(miss):
                found[miss] = np.arange(k, k + len(new))
            else:
                found[miss] = np.fromiter(map(self.known.__getitem__, (words[i] for i in miss.tolist())), np.int64, len(miss))
        return found

    def _spelled(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of different words end to end, and the number of each word's pieces. Words are spelled some at a
        time, as pieces never reach over a space. A mark inside a word is spelled as a noncharacter, so that only first
        pieces start with marks."""
        end = words.index(b"") if b"" in words else None
        some = [w for w in words if w]
        texts = [b" ".join(some[k : k + 200]).decode("utf-8", "replace").replace(_MARK, "\uffff") for k in range(0, len(some), 200)]
        ids = np.fromiter(chain.from_iterable(self.sp.encode(texts, num_threads=1)), np.int32)
        length = np.diff(np.r_[np.flatnonzero(self.starts[ids]), len(ids)])
        if end is not None:
            ids, length = np.insert(ids, length[:end].sum(), self.end), np.insert(length, end, 1)
        return ids, length

    def pieces(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the numbered words end to end, and the number of each word's pieces."""
        n = self.length[at]
        first = np.cumsum(n) - n
        return self.flat[np.repeat(self.start[at] - first, n) + np.arange(n.sum())], n


def _pairs(model):
    """Counts of (piece before in the word or -1, piece), each word as often as it stands in the corpus (n) and once (k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(model.value)
        for batch in batches:
            at = speller.add(_listed(batch["word"]))
            ids, n = speller.pieces(at)
            before = np.r_[-1, ids[:-1]]
            before[np.cumsum(n) - n] = -1
            pair, back = np.unique((before.astype(np.int64) + 1) << 20 | ids, return_inverse=True)
            times = np.bincount(back, weights=np.repeat(batch["c"].to_numpy(), n)).astype(np.int64)
            prev, piece = (pair >> 20).astype(np.int32) - 1, (pair & 0xFFFFF).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (prev, piece, times, np.bincount(back))], ["prev", "piece", "n", "k"])

    return run


@dataclass(frozen=True)
class Model:
    """rank: piece id to output number; rare: log share of a rare piece among those of its output, 0 for others;
    group: class of each output; starting: 1 for the classes of starting pieces; within[previous, output]: log share of
    the output in its class; net: weights; alone: share of each piece among all; alone_start: that of starting ones;
    begun: training words that begin with each piece; trust: weight of their shares."""

    rank: np.ndarray
    rare: np.ndarray
    group: np.ndarray
    starting: np.ndarray
    within: np.ndarray
    net: dict[str, np.ndarray]
    alone: np.ndarray
    alone_start: float
    begun: np.ndarray
    trust: np.ndarray


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    e /= e @ np.ones((z.shape[-1], 1), e.dtype)
    return e


def _by(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w as one product over all rows of all windows."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[-1])


def _to_softmax(z: np.ndarray, times: np.ndarray | None = None) -> None:
    """Makes each row of z its softmax, times a factor where given."""
    if z.max() > 60:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z *= ((1 if times is None else times) / (z @ np.ones(z.shape[1], z.dtype)))[:, None]


#: Within a window the last half attends to all places up to its own.
_MASK = np.where(np.arange(SPAN)[None] <= np.arange(_HALF, SPAN)[:, None], 0.0, -1e9).astype(np.float32)


def _forward(net: dict[str, np.ndarray], ids: np.ndarray) -> tuple:
    """The pass written plainly; steps and scores do the same in arrays that are made once."""
    x = net["emb"][ids] + net["pos"]
    last = x[:, _HALF:]
    q, k, v = _by(last, net["q"]), _by(x, net["k"]), _by(x, net["v"])
    a = _softmax(q @ k.transpose(0, 2, 1) * DIM**-0.5 + _MASK)
    h = np.concatenate([last, a @ v], -1)
    z = _by(h, net["out"])
    z += net["bias"]
    return x, q, k, v, a, h, z


def _fresh(share: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Weights to begin with; share is that of each class among all targets."""
    small = lambda *shape: rng.normal(0, shape[0] ** -0.5 if len(shape) > 1 else 0, shape).astype(np.float32)
    return {"emb": small(OUT + 1, DIM) * 4, "pos": small(SPAN, DIM) * 0.5, "q": small(DIM, DIM), "k": small(DIM, DIM), "v": small(DIM, DIM), "out": small(2 * DIM, CLASSES), "bias": np.log(share).astype(np.float32)}


#: Windows of a step, and the rate to begin with.
_SIZE, _RATE = 256, 0.01


class _Adam:
    """Steps on the cross entropy of the class of the piece after each place of a window's last half; places behind a
    text's end are no targets. The gradients are written out. Steps of up to _SIZE windows work in arrays that are made once;
    weights, gradients and moments are one row each, of which `net` and `grad` are views."""

    def __init__(self, net: dict[str, np.ndarray], group: np.ndarray) -> None:
        self.group, self.n = group, 0
        # keys and values share one product, as do outputs and their bias, to which a column of ones belongs
        shapes = {"emb": (OUT + 1, DIM), "pos": (SPAN, DIM), "q": (DIM, DIM), "kv": (DIM, 2 * DIM), "weights": (2 * DIM + 1, CLASSES)}
        ends = np.cumsum([0, *map(np.prod, shapes.values())])
        self.w, self.g, self.m, self.s, self.t = np.zeros((5, ends[-1]), np.float32)
        self.own, self.grad = ({n: row[at : at + np.prod(shape)].reshape(shape) for (n, shape), at in zip(shapes.items(), ends)} for row in (self.w, self.g))
        kv, weights = self.own["kv"], self.own["weights"]
        self.net = {n: self.own[n] for n in ("emb", "pos", "q")} | {"k": kv[:, :DIM], "v": kv[:, DIM:], "out": weights[:-1], "bias": weights[-1]}
        for name, w in net.items():
            self.net[name][...] = w
        places, targets = _SIZE * SPAN, _SIZE * _HALF
        self.at_places = [np.empty((places, m), np.float32) for m in (DIM, DIM, 2 * DIM, 2 * DIM)]
        self.at_targets = [np.empty((targets, m), np.float32) for m in (DIM, DIM, SPAN, SPAN, 2 * DIM + 1, 2 * DIM, DIM, DIM, CLASSES)]
        self.at_targets[4][:, -1] = 1
        self.cells = np.arange((OUT + 1) * DIM).reshape(-1, DIM)

    def step(self, windows: np.ndarray, rate: float) -> int:
        """Returns the number of targets."""
        own, grad, n, scale = self.own, self.grad, len(windows), np.float32(DIM**-0.5)
        ids, aim = windows[:, :SPAN].astype(np.intp).ravel(), windows[:, _HALF + 1 :].astype(np.intp).ravel()
        real = aim < OUT
        count = int(real.sum())
        x, dx, kv, dkv = (y[: n * SPAN] for y in self.at_places)
        q, dq, a, ds, h, dh, c, dc, z = (y[: n * _HALF] for y in self.at_targets)
        full = lambda y: y.reshape(n, SPAN, -1)
        half = lambda y: y.reshape(n, _HALF, -1)
        turned = lambda y: y.transpose(0, 2, 1)
        k, v, dk, dv = full(kv)[..., :DIM], full(kv)[..., DIM:], full(dkv)[..., :DIM], full(dkv)[..., DIM:]
        own["emb"].take(ids, 0, x, "clip")
        full(x)[...] += own["pos"]
        half(h)[..., :DIM] = full(x)[:, _HALF:]
        last = h[:, :DIM]
        np.matmul(last, own["q"], out=q)
        np.matmul(x, own["kv"], out=kv)
        np.matmul(half(q), turned(k), out=half(a))
        a *= scale
        half(a)[...] += _MASK
        _to_softmax(a)
        np.matmul(half(a), v, out=half(c))
        h[:, DIM : 2 * DIM] = c
        np.matmul(h, own["weights"], out=z)
        share = real.astype(np.float32) / np.float32(max(1, count))
        _to_softmax(z, share)  # from here z is its gradient, as are those named d
        z.reshape(-1)[np.arange(0, z.size, CLASSES) + self.group[aim]] -= share
        np.matmul(z, own["weights"][:-1].T, out=dh)
        dc[...] = dh[:, DIM:]
        np.matmul(half(dc), turned(v), out=half(ds))
        ds -= np.einsum("ij,ij->i", dc, c)[:, None]  # the sum of ds * a
        ds *= a
        ds *= scale
        np.matmul(half(ds), k, out=half(dq))
        np.matmul(turned(half(ds)), half(q), out=dk)
        np.matmul(turned(half(a)), half(dc), out=dv)
        np.matmul(dkv, own["kv"].T, out=dx)
        np.matmul(dq, own["q"].T, out=c)
        c += dh[:, :DIM]
        full(dx)[:, _HALF:] += half(c)
        np.matmul(last.T, dq, out=grad["q"])
        np.matmul(x.T, dkv, out=grad["kv"])
        np.matmul(h.T, z, out=grad["weights"])
        np.sum(full(dx), 0, out=grad["pos"])
        grad["emb"].ravel()[...] = np.bincount(self.cells.take(ids, 0).ravel(), dx.ravel(), self.cells.size)
        self.n += 1
        g, m, s, t = self.g, self.m, self.s, self.t
        np.subtract(g, m, out=t)
        t *= np.float32(0.1)
        m += t
        np.multiply(g, g, out=t)
        t -= s
        t *= np.float32(0.01)
        s += t
        np.divide(s, np.float32(1 - 0.99**self.n), out=t)
        np.sqrt(t, out=t)
        t += np.float32(1e-8)
        np.divide(m, t, out=t)
        t *= np.float32(rate / (1 - 0.9**self.n))
        self.w -= t
        return count


def train(windows: np.ndarray, group: np.ndarray, epochs: int = EPOCHS, rate: float = _RATE, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights fitted on windows at hand: windows[:, :SPAN] are inputs, group gives each output's class."""
    rng = np.random.default_rng(seed)
    goal = group[windows[:, _HALF + 1 :]]
    fit = _Adam(_fresh((np.bincount(goal.ravel(), minlength=CLASSES) + 1.0) / (goal.size + CLASSES), rng), group)
    steps = max(1, epochs * -(-len(windows) // _SIZE))
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(windows), _SIZE):
            fit.step(windows[order[at : at + _SIZE]], rate * (1 - 0.9 * (fit.n + 1) / steps))
    return fit.net


def _flat(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[n].ravel() for n in sorted(net)]).astype(np.float64)


def _unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    names = sorted(like)
    parts = np.split(values.astype(np.float32), np.cumsum([like[n].size for n in names])[:-1])
    return {n: x.reshape(like[n].shape) for n, x in zip(names, parts)}


def _stretches(words: pa.Array, codes: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of the stretches that are learned from, the number of each one's tokens, whether it begins a text, and
    its round; chosen by a hash of the words that it holds."""
    place = np.arange(len(codes)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    first = np.flatnonzero(place % STRETCH == 0)
    h = np.fromiter(map(crc32, _listed(words)), np.uint64, len(words))[codes]
    h = mixed(np.add.reduceat(h * _ODD[place % STRETCH], first)) if len(first) else np.zeros(0, np.uint64)
    some = np.flatnonzero(h % np.uint64(SHARE) == 0)
    length = np.diff(np.r_[first, len(codes)])
    chosen = np.repeat(np.isin(np.arange(len(first)), some), length)
    rounds = (h[some] // np.uint64(SHARE) % np.uint64(ROUNDS)).astype(int)
    return codes[chosen], length[some], place[first[some]] == 0, rounds


_ODD = np.random.default_rng(6).integers(0, 2**63, STRETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _windows(out: np.ndarray, n_pieces: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows over stretches, and the number of each one's stretch. What begins inside a text has no window with
    marks of a start."""
    inputs, starts = _layout(out, n_pieces)
    halves = -(-n_pieces // _HALF)
    of = np.repeat(np.arange(len(n_pieces)), halves)
    first = np.r_[True, of[1:] != of[:-1]]
    keep = ~first | begins[of]
    return inputs[starts[keep, None] + np.arange(SPAN + 1)].astype(np.uint16), of[keep]


def _outputs(model, rank: np.ndarray):
    """The windows to learn from as bytes, by round; and a row for each task with what stands near what in them: counts
    of (output, one of the first OWN outputs) at the distances 1, 2, 4 and 8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(model.value)
        near = np.zeros(OUT * OWN)
        kinds = pa.schema([("windows", pa.binary()), ("k", pa.int32()), ("v", pa.binary()), ("round", pa.int32())])
        for texts in chain.from_iterable(_slices(batch["text"]) for batch in batches):
            words, codes, n_words = _tokens(texts)
            codes, n_words, begins, rounds = _stretches(words, codes, n_words)
            if not len(codes):
                continue
            there, codes = np.unique(codes, return_inverse=True)
            _, out, _, _, _, n = _ranked(speller, rank, words.take(pa.array(there)), codes, n_words)
            windows, of = _windows(out, n, begins)
            rounds = rounds[of]
            for shift in (1, 2, 4, 8):
                a, b = windows[:, :-shift].ravel().astype(np.int64), windows[:, shift:].ravel().astype(np.int64)
                for x, y in ((a, b), (b, a)):
                    keep = (y < OWN) & (x < OUT)
                    near += np.bincount(x[keep] * OWN + y[keep], minlength=OUT * OWN)
            found = [windows[rounds == r].tobytes() for r in range(ROUNDS)]
            none = [None] * ROUNDS
            yield pa.RecordBatch.from_pydict({"windows": found, "k": none, "v": none, "round": list(range(ROUNDS))}, kinds)
        yield pa.RecordBatch.from_pydict({"windows": [None], "k": [_lane()], "v": [near.tobytes()], "round": [-1]}, kinds)

    return run


def _lane() -> int:
    """Rows of tasks are added up in 16 groups before they go to the driver."""
    return TaskContext.get().partitionId() % 16


def _added(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all rows' vectors: k (group), v (doubles as bytes)."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size)
        for v in part["v"]:
            total += np.frombuffer(v)
        return pd.DataFrame({"v": [total.tobytes()]})

    return sum((np.frombuffer(r["v"]) for r in rows.groupBy("k").applyInPandas(add, "v binary").collect()), np.zeros(size))


def _round(shared, rate: float, held: int = 50_000):
    """Weights after a task's windows, times the number of targets, and this number behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, group = shared.value
        fit, rng, seen = _Adam(net, group), np.random.default_rng(7), 0
        parts: list[np.ndarray] = []

        def learn() -> int:
            windows = rng.permutation(np.concatenate(parts)).astype(np.int32)
            parts.clear()
            return sum(fit.step(windows[at : at + _SIZE], rate) for at in range(0, len(windows), _SIZE))

        for batch in batches:
            for some in batch["windows"]:
                parts.append(np.frombuffer(some.as_buffer(), np.uint16).reshape(-1, SPAN + 1))
                if sum(map(len, parts)) >= held:
                    seen += learn()
        if parts:
            seen += learn()
        total = np.r_[_flat(fit.net) * seen, seen].tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([_lane()], pa.int32()), pa.array([total], pa.binary())], ["k", "v"])

    return run


def _fit(windows: DataFrame, group: np.ndarray, counts: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights fitted on all rows of windows(windows: uint16 as bytes, round)."""
    share = np.bincount(group[:OUT], counts, CLASSES) + 1.0
    net = _fresh(share / share.sum(), np.random.default_rng(seed))
    expected = max(1.0, counts.sum() / _HALF / SHARE)
    passes = int(np.clip(np.ceil(FIT_WINDOWS / expected), 1, EPOCHS))
    size, steps = len(_flat(net)) + 1, passes * ROUNDS
    for step in range(steps):
        some = windows.filter(F.col("round") == step % ROUNDS).select("windows")
        shared = windows.sparkSession.sparkContext.broadcast((net, group))
        rate = _RATE * (1 - 0.9 * (step + 0.5) / steps)
        total = _added(some.mapInArrow(_round(shared, rate), "k int, v binary"), size)
        if total[-1]:
            net = _unflat(total[:-1] / total[-1], net)
        shared.unpersist()
    return net


def _classes(counts: np.ndarray, near: np.ndarray, starts: np.ndarray, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The class of each output, and 1 for the classes of starting pieces. Frequent outputs and the end have a class
    each; others share classes with outputs of their kind that stand near the same frequent ones (k-means over the
    co-occurrences in the windows that are learned from). starts: whether an output is a starting piece."""
    group, starting = np.zeros(OUT, np.int64), np.zeros(CLASSES, np.float32)
    group[:OWN] = np.arange(OWN)
    starting[:OWN] = starts[:OWN]
    starting[OWN : OWN + GROUPS] = 1
    near = near.reshape(OUT, OWN) + 0.02
    near = np.sqrt(near / near.sum(1, keepdims=True))
    rng = np.random.default_rng(seed)
    for kind, first in ((True, OWN), (False, OWN + GROUPS)):
        of = OWN + np.flatnonzero(starts[OWN:] == kind)
        if not len(of):
            continue
        x, weight = near[of], counts[of, None] + 1.0
        many = min(GROUPS, len(of))
        centre = x[rng.choice(len(x), many, replace=False, p=(weight / weight.sum()).ravel())]
        for _ in range(15):
            at = (x @ centre.T).argmax(1)
            for c in range(many):
                if (at == c).any():
                    centre[c] = (x[at == c] * weight[at == c]).sum(0)
                    centre[c] /= np.linalg.norm(centre[c])
        group[of] = first + (x @ centre.T).argmax(1)
    return group, starting


def _within(pairs: np.ndarray, counts: np.ndarray, group: np.ndarray, pull: float = 3.0) -> np.ndarray:
    """Log of each output's share in its class after each predecessor, pulled to its share over all."""
    member = np.zeros((OUT, CLASSES))
    member[np.arange(OUT), group] = 1
    counts = counts + 0.5
    share = counts / (counts @ member)[group]
    return np.log((pairs + pull * share) / ((pairs @ member)[:, group] + pull)).astype(np.float32)


def _ranked(speller: Speller, rank: np.ndarray, words: pa.Array, codes: np.ndarray, n_words: np.ndarray):
    """Numbers of all words, outputs of all texts end to end, pieces, predecessors, pieces of each word, pieces of each
    text."""
    numbers = speller.add(_listed(words))[codes]
    ids, per_word = speller.pieces(numbers)
    out = np.take(rank, ids)
    before = np.r_[PREV, np.minimum(out[:-1], PREV - 1)]
    first = np.cumsum(per_word) - per_word
    before[first] = PREV
    return numbers, out, ids, before, per_word, np.add.reduceat(per_word, np.r_[0, np.cumsum(n_words)[:-1]])


def _layout(out: np.ndarray, n_pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs padded for windows, and for each half window that is scored its place among them. A text stands
    behind half a window of start marks and one more; windows never reach from one text into another."""
    halves = -(-n_pieces // _HALF)
    room = (halves + 1) * _HALF + 1
    begin = np.cumsum(room) - room
    inputs = np.full(room.sum() + SPAN, OUT, np.int32)
    first = np.cumsum(n_pieces) - n_pieces
    inputs[np.repeat(begin + _HALF + 1 - first, n_pieces) + np.arange(len(out))] = out
    starts = np.repeat(begin - _HALF * (np.cumsum(halves) - halves), halves) + _HALF * np.arange(halves.sum())
    return inputs, starts


def _spans(rows: np.ndarray, n: int) -> np.ndarray:
    """The n windows of rows, which overlap by half, as views."""
    step = rows.strides[0]
    return as_strided(rows, (n, SPAN, DIM), (_HALF * step, step, rows.strides[1]), writeable=False)


def probabilities(model: Model, out: np.ndarray, ids: np.ndarray, before: np.ndarray, n_pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece of some texts its probability, and that of any starting piece in its place, by batches of
    windows, of which each scores its last half."""
    # each text has a half window of marks and one for each that is scored; a half attends to itself and the one before
    halves = -(-n_pieces // _HALF)
    room = (halves + 1) * _HALF
    first = np.cumsum(n_pieces) - n_pieces
    begin = np.cumsum(room) - room + _HALF
    at = np.repeat(begin - first, n_pieces) + np.arange(len(out))  # where a piece is predicted; the next place holds it
    inputs, goal = np.full(int(room.sum()), OUT, np.int32), np.zeros(int(room.sum()), np.int64)
    goal[at] = model.group[out]
    inside = np.ones(len(out), bool)
    inside[first + n_pieces - 1] = False
    inputs[at[inside] + 1] = out[inside]
    net, scale, n = model.net, np.float32(DIM**-0.5), _PLACES // _HALF
    # what a piece gives by itself is taken from tables; what its place gives is added
    keys, values, queries, faces = net["emb"] @ net["k"], net["emb"] @ net["v"], net["emb"] @ net["q"] * scale, net["emb"]
    pos = np.tile(net["pos"][_HALF:], (n, 1))
    key_pos, value_pos, query_pos = (net["pos"] @ net["k"]).T.copy(), net["pos"] @ net["v"], pos @ net["q"] * scale
    weights, one = np.r_[net["out"], net["bias"][None]], np.ones((SPAN, 1), np.float32)  # a column of ones brings the bias
    sums = np.stack([model.starting, np.ones(CLASSES, np.float32)], 1)
    scored, start = np.empty(len(inputs), np.float32), np.empty(len(inputs), np.float32)
    goal = goal[_HALF:] + np.arange(len(goal) - _HALF) % _PLACES * CLASSES  # among a batch's outputs
    k, v = np.empty((2, _PLACES + _HALF, DIM), np.float32)
    q, x, c, u = np.empty((4, _PLACES, DIM), np.float32)
    w, reach, h, z = (np.empty((_PLACES, m), np.float32) for m in (SPAN, SPAN, 2 * DIM + 1, CLASSES))
    h[:, -1] = 1
    halves_of = lambda *ys: [y.reshape(n, _HALF, -1) for y in ys]
    spans, by_half = [_spans(k, n).transpose(0, 2, 1), _spans(v, n)], halves_of(q, w, reach, u)
    for a in range(_HALF, len(inputs), _PLACES):
        b = min(len(inputs), a + _PLACES)
        if b - a < _PLACES:
            n, m = (b - a) // _HALF, b - a
            k, v = k[: m + _HALF], v[: m + _HALF]
            pos, query_pos, q, x, c, u, w, reach, h, z = (y[:m] for y in (pos, query_pos, q, x, c, u, w, reach, h, z))
            spans, by_half = [_spans(k, n).transpose(0, 2, 1), _spans(v, n)], halves_of(q, w, reach, u)
        there, here = inputs[a - _HALF : b], inputs[a:b]
        for table, of, to in ((keys, there, k), (values, there, v), (queries, here, q), (faces, here, x)):
            table.take(of, 0, to, "clip")
        q += query_pos
        np.matmul(q, key_pos, out=w)
        np.matmul(by_half[0], spans[0], out=by_half[2])
        w += reach
        np.add(by_half[1], _MASK, out=by_half[1])
        if w.max() > 60:
            np.minimum(w, 60, out=w)
        np.exp(w, out=w)  # what is behind the mask vanishes
        np.matmul(w, value_pos, out=c)
        np.matmul(by_half[1], spans[1], out=by_half[3])
        c += u
        np.add(x, pos, out=h[:, :DIM])
        np.divide(c, w @ one, out=h[:, DIM : 2 * DIM])
        np.matmul(h, weights, out=z)
        if z.max() > 60:
            np.minimum(z, 60, out=z)
        np.exp(z, out=z)
        of_start, all_ = (z @ sums).T
        np.divide(z.take(goal[a - _HALF : b - _HALF]), all_, out=scored[a:b])
        np.divide(of_start, all_, out=start[a:b])
    in_class = np.exp(np.take(model.within, before.astype(np.int64) * OUT + out) + model.rare[ids])
    piece = (1 - ALONE) * (scored[at] * in_class) + ALONE * model.alone[ids]
    return piece, (1 - ALONE) * start[at] + ALONE * model.alone_start


def spelled_words(piece: np.ndarray, start: np.ndarray, per_word: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each word's first piece among starting ones, and that of its other pieces and of a starting
    piece behind them. ends: whether a word is a text's end, which nothing follows."""
    first = np.cumsum(per_word) - per_word
    begins = np.log10(start[first].astype(np.float64))
    follows = np.where(ends, 0.0, np.r_[begins[1:], 0.0])
    log = np.log10(piece.astype(np.float64))
    return log[first] - begins, np.add.reduceat(log, first) - log[first] + follows


def _mixed(c: np.ndarray, share: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """log10 of c * 10 ** share + 10 ** rest; added as logarithms, as spellings can be too small."""
    rest = rest * np.log(10)
    return np.where(c > 0, np.logaddexp(share * np.log(10) + np.log(np.maximum(c, 1)), rest), rest) / np.log(10)


def _mixed_column(c: Column, share: Column, rest: Column) -> Column:
    share = share + F.log10(c)
    return F.when(c > 0, F.greatest(share, rest) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(share - rest)))).otherwise(rest)


def _recalled(numbers: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its share of the words before it in its text, and the weight of that share."""
    of = np.repeat(np.arange(len(n_words)), n_words)
    before = np.arange(len(numbers)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    key = of * (int(numbers.max(initial=0)) + 1) + numbers
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order[1:]] != key[order[:-1]]][: len(key)]
    at = np.flatnonzero(new)
    times = np.empty(len(key), np.int64)
    times[order] = np.arange(len(key)) - np.repeat(at, np.diff(np.r_[at, len(key)]))
    return times / np.maximum(1, before), RECALL * before / (before + HALF_RECALL)


def _scores(model_file, shared):
    """A row for each text with what its frequent words add up to; and a row for each other
    word of it: log10 of the weighed share of one training word (base) and of all else that speaks for it (mixed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head = shared.value
        speller = Speller(model_file.value, head)
        share = np.log10(np.where(model.begun > 0, model.trust / np.maximum(model.begun, 1), 1.0))
        rest = np.log10(1 - model.trust)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                words, codes, n_words = _tokens(part["text"])
                numbers, out, ids, before, per_word, n_pieces = _ranked(speller, model.rank, words, codes, n_words)
                ends = np.zeros(len(codes), bool)
                ends[np.cumsum(n_words) - 1] = True
                begun, spelled = spelled_words(*probabilities(model, out, ids, before, n_pieces), per_word, ends)
                piece = ids[np.cumsum(per_word) - per_word]
                own, recall = _recalled(numbers, n_words)
                begun += np.log10(1 - recall)
                of_share, spelled = begun + share[piece], begun + rest[piece] + spelled
                again = np.flatnonzero(own)
                spelled[again] = np.logaddexp(spelled[again] * np.log(10), np.log(own[again] * recall[again])) / np.log(10)
                c = speller.count[numbers].astype(np.float64)
                known = c > 0
                found = np.where(known, _mixed(c, of_share, spelled), 0.0)
                first = np.r_[0, np.cumsum(n_words)[:-1]]
                sums = [np.add.reduceat(x, first) for x in (known.astype(np.int64), np.log10(c + 1), found)]
                more = np.flatnonzero(~known)
                of = pa.array(np.repeat(np.arange(len(part)), n_words)[more])
                columns = {
                    "rid": (part["rid"], part["rid"].take(of)), "doc_id": (part["doc_id"], pa.nulls(len(more), pa.int64())),
                    "n_tokens": (pa.array(n_words), pa.nulls(len(more), pa.int64())), "known": (pa.array(sums[0]), pa.nulls(len(more), pa.int64())),
                    "base": (pa.array(sums[1]), pa.array(of_share[more])), "mixed": (pa.array(sums[2]), pa.array(spelled[more])),
                    "word": (pa.nulls(len(part), pa.binary()), words.take(pa.array(codes[more]))),
                }
                yield pa.RecordBatch.from_pydict({n: pa.concat_arrays(list(x)) for n, x in columns.items()})

    return run


def score_texts(docs: DataFrame, folds: int = 7, held_out: int = 2, text: str = "text", doc_id: str = "doc_id", model_file: str = MODEL_FILE) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose fold is not held out are learned from; null ids belong to fold 0. Null and empty texts are one
    end token. Without training documents every word is spelled, the base's counts are 0. Repeated rows are scored
    as often as they stand (and counted as often). An empty table gives an empty result; other columns of docs are
    ignored.
    """
    spark = docs.sparkSession
    fold = fold_of(F.col(doc_id), folds)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), (fold == held_out).alias("held_out"))
    train_rows = rows.filter(~F.col("held_out"))
    vocabulary = step(train_rows.select("text").mapInArrow(_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    size = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = size["n"], size["v"]
    # at most HEAD words can have a count of total / HEAD or more
    head = {bytes(r["word"]): r["c"] for r in vocabulary.filter(F.col("c") >= max(1, total / HEAD)).collect()}

    proto = spark.sparkContext.broadcast(Path(model_file).read_bytes())
    speller = Speller(proto.value)
    end = speller.end
    pairs = staged(vocabulary.mapInArrow(_pairs(proto), "prev int, piece int, n long, k long").groupBy("prev", "piece").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "pairs")
    seen, begun, different = np.zeros((3, end + 1))
    first = F.col("prev") == -1
    for r in pairs.groupBy("piece").agg(F.sum("n").alias("n"), F.sum(F.when(first, F.col("n"))).alias("b"), F.sum(F.when(first, F.col("k"))).alias("k")).collect():  # a row for each piece of the model
        seen[r["piece"]], begun[r["piece"]], different[r["piece"]] = r["n"], r["b"] or 0, r["k"] or 0
    order = np.argsort(-np.where(np.arange(end + 1) == end, np.inf, seen), kind="stable")
    starts = speller.starts
    rank = np.where(starts, OUT - 2, OUT - 1).astype(np.int32)
    rank[order[: OUT - 2]] = np.arange(OUT - 2)
    rare = np.zeros(end + 1)
    for r in (OUT - 2, OUT - 1):
        of = rank == r
        rare[of] = np.log((seen[of] + 1) / (seen[of] + 1).sum())
    out_starts = np.r_[starts[order[: OUT - 2]], True, False]
    places = spark.createDataFrame([(i, int(r)) for i, r in enumerate(rank)], "piece int, r int")
    table = np.zeros((PREV + 1, OUT))
    by_rank = pairs.join(places, "piece").join(places.select(F.col("piece").alias("prev"), F.col("r").alias("p")), "prev", "left").groupBy(F.coalesce(F.least("p", F.lit(PREV - 1)), F.lit(PREV)).alias("p"), "r").agg(F.sum("n").alias("n")).toPandas()  # at most (PREV + 1) * OUT rows
    table[by_rank["p"].to_numpy(dtype=int), by_rank["r"].to_numpy(dtype=int)] = by_rank["n"].to_numpy(dtype=float)
    counts = table.sum(0)

    outputs = staged(train_rows.select("text").mapInArrow(_outputs(proto, rank), "windows binary, k int, v binary, round int"), "outputs", by="round")
    group, starting = _classes(counts, _added(outputs.filter("round = -1").select("k", "v"), OUT * OWN), out_starts)
    net = _fit(outputs.filter("round >= 0"), np.r_[group, 0], counts)
    discard(outputs)
    alone = (seen + 1) / (seen + 1).sum()
    model = Model(rank, rare.astype(np.float32), group, starting, _within(table, counts, group), net, alone.astype(np.float32), float(alone[starts].sum()), begun, begun / np.maximum(1, begun + different))

    shared = spark.sparkContext.broadcast((model, head))
    kinds = "rid long, doc_id long, n_tokens long, known long, base double, mixed double, word binary"
    parts = staged(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(_scores(proto, shared), kinds), "scores")
    c = F.coalesce("c", F.lit(0))
    rest = parts.filter("word is not null").join(vocabulary, "word", "left")
    rest = rest.select("rid", F.log10(c + 1.0).alias("b"), _mixed_column(c, F.col("base"), F.col("mixed")).alias("m"), (c > 0).cast("long").alias("k"))
    rest = rest.groupBy("rid").agg(F.sum("b").alias("b"), F.sum("m").alias("m"), F.sum("k").alias("k"))
    out = parts.filter("word is null").join(rest, "rid", "left")
    both = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    base = both("base", "b") - F.col("n_tokens") * float(np.log10(total + distinct + 1))
    fold = (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out")
    tokens = F.lit(total).cast("long").alias("train_tokens")
    return out.select("doc_id", fold, "n_tokens", both("known", "k").alias("n_known"), tokens, base.alias("base_score"), both("mixed", "m").alias("score"))
