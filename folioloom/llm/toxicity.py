"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, maps letters of other scripts that look like Latin ones and digits that stand for letters,
and turns everything else into spaces. Terms are whole words or beginnings of words; their weights are the lower
bounds of their log odds among labelled rows. A document's weights, without those inside exception phrases, are
summed and related to its length; a logistic curve fitted on the same labelled rows makes a score of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folioloom.llm.labelled import fold_of, sample

#: At most so many labelled rows are learned from, and so many terms are kept.
FIT_ROWS, MAX_TERMS = 20_000, 2_000
# Terms that need no evidence, and phrases in which a term is harmless.
SEED_TERMS = tuple(f" {w} " for w in "idiot idiots moron morons imbecile stupid dumbass scum scumbag worthless pathetic loser losers trash disgusting clown clowns bastard bitch asshole retard".split())
EXCEPTIONS = tuple(f" {p} " for p in ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "clown car", "idiot proof", "pond scum", "soap scum", "sore loser", "loser bracket", "not stupid", "not worthless", "not disgusting"))
SEED_WEIGHT = 3.0
# Look-alikes of Latin letters, and digits read as letters.
_ALIKE = dict(zip("аеорсухіјѕԁһӏвкмнтαενορτυχικ", "aeopcyxijsdhlbkmhtaevoptuxik"))
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
_SIGNS = {"$": "s", "@": "a", "!": "i", "|": "l", "+": "t", "€": "e"}
_INNER = re.compile(r"(?<=[^\W_])[$@!|+€]+(?=[^\W_])|(?<![^\s])[$@€](?=[^\W\d_]{2})")


class _Folding(dict):
    """Code point to folded text, filled as characters appear."""

    def __missing__(self, point: int) -> str:
        c = chr(point).lower()
        if 0xFF01 <= point <= 0xFF5E:
            c = chr(point - 0xFEE0).lower()
        c = _ALIKE.get(c, _DIGITS.get(c, c))
        self[point] = out = c if c.isalnum() else " "
        return out


_FOLD = _Folding()


def fold(text: str) -> str:
    """The folded text with a space at each end. Signs count as letters inside a word or before one."""
    if any(s in text for s in _SIGNS):
        text = _INNER.sub(lambda m: "".join(map(_SIGNS.get, m[0])), text)
    return f" {text.translate(_FOLD)} "


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of labelled texts: for clean ones counts by batch; for toxic ones each term with the words around its
    first place, so that copies of one text count as one piece of evidence."""
    for batch in batches:
        clean: Counter[str] = Counter()
        toxic: set[tuple[str, int]] = set()
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
            words = fold(text or "").split()
            if not label:
                clean.update({t for w in set(words) for t in _forms(w)})
                continue
            mine: dict[str, int] = {}
            for i, w in enumerate(words):
                for t in _forms(w):
                    if t not in mine:
                        mine[t] = crc32(" ".join(words[max(0, i - 1) : i + 2]).encode())
            toxic.update(mine.items())
        yield pa.RecordBatch.from_arrays([pa.array([*clean, *(t for t, _ in toxic)], pa.string()), pa.array([None] * len(clean) + [c for _, c in toxic], pa.int64()), pa.array([*clean.values(), *[0] * len(toxic)], pa.int64())], ["term", "near", "clean"])


def _forms(word: str) -> list[str]:
    return [f" {word} ", *(f" {word[:n]}" for n in range(4, min(8, len(word))))] if 3 <= len(word) <= 40 else []


@dataclass(frozen=True)
class Model:
    """weights: by term. bias and slopes: of the logistic curve over the two features."""

    weights: dict[str, float]
    bias: float = -4.0
    slopes: tuple[float, float] = (1.5, 0.5)

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for term, w in self.weights.items():
            out.add_word(term, (len(term), w))
        for phrase in EXCEPTIONS:
            if phrase not in self.weights:
                out.add_word(phrase, (len(phrase), 0.0))
        if not len(out):
            out.add_word(" \0 ", (3, 0.0))
        out.make_automaton()
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + features @ np.array(self.slopes), -30, 30)))


def features(text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    """log(1 + sum of weights) and log(1 + sum of weights per 100 words). Of terms that begin at one place the
    heaviest counts; terms inside an exception phrase count nothing."""
    folded = fold(text or "")
    at: dict[int, float] = {}
    free: list[tuple[int, int]] = []
    for end, (length, w) in automaton.iter(folded):
        begin = end - length + 1
        if w:
            at[begin] = max(w, at.get(begin, 0.0))
        else:
            free.append((begin, end))
    total, k, reach = 0.0, 0, -1
    free.sort()
    for b in sorted(at) if free else at:  # phrases and terms in order: reach is where the phrases met so far end
        while k < len(free) and free[k][0] <= b:
            reach = max(reach, free[k][1] - 1)
            k += 1
        if b >= reach:
            total += at[b]
    if not total:
        return 0.0, 0.0
    return math.log1p(total), math.log1p(100 * total / max(20, len(folded.split())))


def _with_features(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Model(weights).automaton()
        for batch in batches:
            found = np.array([features(t, automaton) for t in batch["text"].to_pylist()], dtype=float).reshape(-1, 2)
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in keep), pa.array(found[:, 0]), pa.array(found[:, 1])], [*keep, "heavy", "dense"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Bias and slopes by Newton's method, with a ridge on the slopes."""
    x = np.c_[np.ones(len(x)), x]
    b = np.zeros(x.shape[1])
    pull = np.diag([1e-6, *[ridge * max(1, len(x)) ** 0.5] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull, x.T @ (y - p) - pull @ b)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", rows: int = FIT_ROWS) -> Model:
    """Learn from at most `rows` labelled documents that are not held out. Without labels of both kinds the seed
    terms and fixed slopes remain, so also for empty tables. Null texts count as empty; of several labels of one id the
    largest counts; a document that repeats counts as often as it stands; terms of equal weight are taken in order."""
    known = sample(docs, labels, label, folds, held_out, rows, text, doc_id)
    sizes = known.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("toxic"), F.count("*").alias("all")).first()
    n_toxic, n_clean = sizes["toxic"], sizes["all"] - sizes["toxic"]
    weights = dict.fromkeys(SEED_TERMS, SEED_WEIGHT)
    if not n_toxic or not n_clean:
        return Model(weights)
    counts = known.mapInArrow(_terms, "term string, near long, clean long").groupBy("term").agg(F.count_distinct("near").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    low = odds - 1.64 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    counts = counts.withColumn("low", low).filter((F.col("toxic") >= 4) & (F.col("low") > 2.4) | F.col("term").isin(*SEED_TERMS))
    best = counts.orderBy(F.col("term").isin(*SEED_TERMS).desc(), F.col("low").desc(), "term").limit(MAX_TERMS).collect()
    support = {r["term"]: r["toxic"] for r in best}
    # a beginning says no more than a longer term with nearly its support
    weaker = {t[:n] for t, k in support.items() for n in range(5, len(t)) if 0.8 * support.get(t[:n], 1e9) <= k}
    for r in (r for r in best if r["term"] not in weaker):
        if r["low"] > 1 or r["term"] not in weights:
            weights[r["term"]] = max(r["low"], SEED_WEIGHT if r["term"] in weights and r["clean"] == 0 else 0.0)
        elif r["clean"] > 3:
            del weights[r["term"]]
    seen = known.mapInArrow(_with_features(weights), "label int, heavy double, dense double").toPandas()
    b = logistic(seen[["heavy", "dense"]].to_numpy(), seen["label"].to_numpy(dtype=float))
    return Model(weights, float(b[0]), (float(b[1]), float(b[2])))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of docs as struct `row`, with score in 0 to 1. Null and empty texts score as texts without hits; rows
    that repeat are scored as often as they stand, equal texts alike; an empty table gives an empty table. Columns of
    docs may have any names: they stay in `row`."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    schema = StructType([rows.schema["row"], StructField("heavy", DoubleType()), StructField("dense", DoubleType())])
    found = rows.mapInArrow(_with_features(model.weights), schema)
    return found.select("row", (1 / (1 + F.exp(-(F.lit(model.bias) + model.slopes[0] * F.col("heavy") + model.slopes[1] * F.col("dense"))))).alias("score"))


def held_out(doc_id: str, folds: int = 4, rest: int = 2):
    return fold_of(F.col(doc_id), folds) == rest
