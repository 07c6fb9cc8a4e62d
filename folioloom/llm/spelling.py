"""Spelling variants: the permuterm rotations of all words, sorted and scanned.

A word of n code points, marked by a terminator, has n + 1 rotations. Words that differ in one code point have rotations
that are equal up to their last code point, and a word that lacks one code point of another has a rotation that is
the other's without its last: the edited code point is skipped, and a prefix range of the sorted rotations holds all words
that agree in the rest. The ranges are dealt to tasks by that prefix, sorted there and scanned. A range has at most one
word for each letter and one without, so its size is bounded by the alphabet; a scan gives each of its words the
number of the others and the best of them, never the pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm.common import staged

#: Letters of a word, as code points; only A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, TYPO = 5, 3, 97
MARK = "$"
#: A task hands its counts on when it holds so many different words.
HELD = 200_000


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo: int = TYPO) -> DataFrame:
    """word, n: the words of all texts and how often they occur.

    A run of letters counts as it stands, lower-cased in A-Z, unless `typo` divides the crc32 of id:run; then it
    lacks one code point. Counts are summed up in each task before they are shuffled. Null and empty texts have no words,
    a null id counts as an empty one, rows that repeat count each, a text of any length is one Python string.
    """
    run = re.compile(f"[{LETTERS}]{{{min_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not body.is_valid:
                    continue
                # bytes.lower() changes A-Z only
                own = Counter(run.findall(body.as_buffer().to_pybytes().lower().decode("utf-8", "replace")))
                start = crc32(b"%d:" % i if i is not None else b":")
                for word, n in own.items():
                    h = crc32(word.encode(), start)
                    if h % typo == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield _counted(held)
                    held = Counter()
        if held:
            yield _counted(held)

    counted = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) -> the word's rotations, as (key, tail, word, n): without its last code point, which is the tail, for
    words that agree up to there, and whole, with an empty tail, for words that have one code point more."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            keys, tails, words, counts = [], [], [], []
            for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                size, marked = len(word), word + MARK
                for i in range(size):
                    keys.append(marked[i + 1 :] + word[:i])
                    tails.append(word[i])
                for i in range(size + 1):
                    keys.append(marked[i:] + word[:i])
                    tails.append("")
                words += [word] * (2 * size + 1)
                counts += [n] * (2 * size + 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(tails, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["key", "tail", "word", "n"])


def _scan(key: str, group: list[tuple[str, str, int]], out: list[list]) -> None:
    """What the words of one range have in each other. A code point that repeats the one before it may be deleted at
    either place: only the first counts, so that no two words meet in two ranges by the same edit."""
    whole = group[0] if group[0][0] == "" else None
    rest = sorted(group[1:] if whole else group, key=lambda x: (-x[2], x[1]))
    for k, (tail, word, _) in enumerate(rest):
        best, n_near = (rest[1] if k == 0 else rest[0]) if len(rest) > 1 else None, len(rest) - 1
        if whole and tail != key[-1]:
            n_near += 1
            best = min((x for x in (best, whole) if x), key=lambda x: (-x[2], x[1]))
        if best:
            for column, value in zip(out, (word, n_near, best[2], best[1]), strict=True):
                column.append(value)
    if whole and (longer := [x for x in rest if x[0] != key[-1]]):
        for column, value in zip(out, (whole[1], len(longer), longer[0][2], longer[0][1]), strict=True):
            column.append(value)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rotations -> (word, n_near, best_n, best) for each word of each range that holds another."""
    open_key, group = None, []
    out: list[list] = [[], [], [], []]
    for batch in batches:
        for key, tail, word, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if key != open_key:
                if len(group) > 1:
                    _scan(open_key, group, out)
                open_key, group = key, []
            group.append((tail, word, n))
        if len(out[0]) > 8192:
            yield _found(out)
            out = [[], [], [], []]
    if len(group) > 1:
        _scan(open_key, group, out)
    yield _found(out)


def _found(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """words(word, n) -> word, n_near, best, best_n: for each word with another one edit away, how many there are and the
    most frequent of them (ties: the least in code-point order)."""
    turned = words.select("word", "n").mapInArrow(_rotations, "key string, tail string, word string, n long")
    found = turned.repartition("key").sortWithinPartitions("key", "tail").mapInArrow(_scanned, "word string, n_near long, best_n long, best string")
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b"))
    return out.select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) without cycles -> word, root: the last of the forms that follow from a word. Every round
    doubles how far a word sees, so their number grows with the logarithm of the longest chain; each is written."""
    seen = staged(forms.filter("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots")
    while not seen.filter("open").isEmpty():
        further = seen.select(F.col("word").alias("root"), F.col("root").alias("next"))
        seen = staged(seen.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "roots")
    return seen.select("word", "root")


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo: int = TYPO) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words of docs, see word_counts().

    The form of a word is the most frequent word that one inserted, deleted or replaced code point makes of it (ties: the
    least in code-point order), if that is at least twice as frequent; the root is the last form of the chain. An
    empty table, or one without words, gives an empty result. Columns of docs but the two named are not read.
    """
    words = staged(word_counts(docs, text, doc_id, min_length, min_count, typo), "words")
    near = words.join(near_words(words), "word", "left")
    form = F.when(F.col("best_n") >= 2 * F.col("n"), F.col("best"))
    near = staged(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n")), "near")
    return near.join(roots(near), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
