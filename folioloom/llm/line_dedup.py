"""Line dedup: winnowing over line hashes.

A gram is a line with the lines after it until they hold MIN_WORDS words. Of the grams that start within
GUARANTEE - MIN_WORDS words of each other the one with the least hash is a fingerprint, so any two runs of
equal lines of GUARANTEE words or more share one. Positions with equal fingerprints are joined, and each match is
extended both ways over equal lines: a fingerprint has a key for its gram and one for each line that an extension can
reach before another fingerprint must follow (only lines shorter than MIN_WORDS words, within GUARANTEE words; a longer
line is a fingerprint itself). Each key stands for all lines from the gram to that line, so the least position of a
key tells whether any earlier text, not only the first with that gram, goes on alike as far as there. Lines with an
earlier position go, with the blank lines behind them.

Equal texts are handled once: only the first row of each text goes through the lines, later copies are one
repeated run as a whole. No pairs of positions are made: a key that many texts share is dealt out by salt, each part
finds its least position, and the parts' least positions meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.llm.common import WORD, staged, text_key

MIN_WORDS, GUARANTEE, SALTS = 5, 8, 64
_LAST = 2**63 - 1


def _lines(classes: DataFrame) -> DataFrame:
    """classes(k, fd, copies, lines) -> one row for each line with words: pos and to (its place and that of the last
    blank line behind it), start (words before it), h, words; all partitioned by k."""
    every = classes.select("k", F.coalesce("fd", F.lit(_LAST)).alias("fd"), "copies", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    every = every.select("k", "fd", "copies", "n", "pos", "line.h", "line.words").filter("words > 0")
    w = Window.partitionBy("k").orderBy("pos")
    before = F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return every.select("*", F.coalesce(before, F.lit(0)).cast("long").alias("start"), (F.coalesce(F.lead("pos").over(w), F.col("n")) - 1).alias("to"))


def _extensions(side: int, lines: Column) -> Column:
    """A key for each number of lines that follow a gram on one side, with the last of them."""
    many = F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lambda t: t <= F.size(lines))

    def one(t: Column) -> Column:
        at = F.element_at(lines, t)
        key = F.xxhash64(F.col("g"), F.lit(side), F.transform(F.slice(lines, F.lit(1), t), lambda x: x["h"]))
        return F.struct(key.alias("key"), at["pos"].alias("first"), at["to"].alias("last"))

    return F.transform(many, one)


def fingerprints(classes: DataFrame, min_words: int = MIN_WORDS, guarantee: int = GUARANTEE) -> DataFrame:
    """classes(k, fd, copies, lines) -> the keys of each text's window minima: k, fd, start (words before the gram), key,
    first, last (the lines that the key decides on); and a row without key for each text that has words: copies, held
    (its words)."""
    lines = _lines(classes)
    w = Window.partitionBy("k").orderBy("start")
    line = F.struct("start", "h", "words", "pos", "to")
    whole = Window.partitionBy("k")
    near = lines.select(
        "k", "fd", "copies", "start", F.sum("words").over(whole).alias("all_words"),
        F.collect_list(line).over(w.rowsBetween(0, min_words + guarantee - 1)).alias("ahead"),
        F.reverse(F.collect_list(line).over(w.rangeBetween(min_words - guarantee, -1)) if guarantee > min_words else F.filter(F.array(line), lambda x: F.lit(False))).alias("back"),
    )
    gram = F.filter("ahead", lambda x: x["start"] < F.col("start") + min_words)
    near = near.withColumn("gram", gram)
    end = F.element_at("gram", -1)
    near = near.select("*", F.xxhash64(F.transform("gram", lambda x: x["h"])).alias("g"), (end["start"] + end["words"] - F.col("start")).alias("held"), end.alias("end"))
    least = F.min(F.when(F.col("held") >= min_words, F.struct("g", (-F.col("start")).alias("at")))).over(w.rangeBetween(0, guarantee - min_words))
    near = near.withColumn("least", -least["at"])
    chosen = F.array_contains(F.collect_list("least").over(w.rangeBetween(min_words - guarantee, 0)), F.col("start"))
    near = near.withColumn("chosen", chosen & (F.col("held") >= min_words)).filter(F.col("chosen") | (F.col("start") == 0))
    # behind the gram: short lines up to the first long one; a long line that ends a gram is a fingerprint itself
    open_ = F.col("chosen") & ((F.col("end")["words"] < min_words) | (F.col("end")["start"] == F.col("start")))
    stop = F.col("start") + F.col("held")
    behind = F.filter("ahead", lambda x: open_ & (x["start"] >= stop) & (x["start"] < stop + guarantee))
    near = near.withColumn("behind", behind)
    stop = F.array_position(F.transform("behind", lambda x: x["words"] >= min_words), True)
    near = near.withColumn("behind", F.slice("behind", F.lit(1), F.when(stop > 0, (stop - 1).cast("int")).otherwise(F.size("behind"))))
    own = F.struct(F.col("g").alias("key"), F.element_at("gram", 1)["pos"].alias("first"), F.col("end")["to"].alias("last"))
    keys = F.concat(F.array(own), _extensions(1, F.col("behind")), _extensions(2, F.col("back")))
    none = F.struct(F.lit(None).cast("long").alias("key"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    both = F.concat(F.when(F.col("start") == 0, F.array(none)).otherwise(F.slice(F.array(none), 1, 0)), F.when(F.col("chosen"), keys).otherwise(F.slice(keys, 1, 0)))
    return near.select("k", "fd", "start", "copies", F.col("all_words").alias("held"), F.explode(both).alias("x")).select("k", "fd", "start", "copies", "held", "x.key", "x.first", "x.last")


def repeated_lines(marks: DataFrame) -> DataFrame:
    """marks(k, fd, start, key, first, last) -> k, first, last: lines of texts that a key with an earlier position holds.
    A key's rows are dealt out by salt; all but the least position of a part are repeats, and those least
    positions, SALTS of a key at most, are compared with each other."""
    at = F.struct("fd", "k", "start")
    parts = Window.partitionBy("key", F.pmod(F.xxhash64("k"), F.lit(SALTS)))
    dealt = staged(marks.select("k", "fd", "start", "key", "first", "last", F.min(at).over(parts).alias("least")), "dealt")
    repeats = dealt.filter(at > F.col("least")).select("k", "first", "last")
    firsts = dealt.filter(at == F.col("least")).withColumn("least", F.min(at).over(Window.partitionBy("key")))
    return repeats.unionByName(firsts.filter(at > F.col("least")).select("k", "first", "last"))


def _ranges(cuts: DataFrame) -> DataFrame:
    """cuts(k, first, last) -> k, cuts: the ranges, those that touch or overlap made one, in order."""
    w = Window.partitionBy("k").orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = cuts.withColumn("apart", F.when(F.col("first") <= before + 1, 0).otherwise(1)).withColumn("island", F.sum("apart").over(w))
    one = apart.groupBy("k", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return one.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("cuts"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, guarantee: int = GUARANTEE) -> DataFrame:
    """Every row of docs as struct `row`, with clean (its text without repeated runs), n_lines and n_removed.

    Texts come in order of their smallest id (null last), then of their bytes' hash; the first occurrence of a
    run stays. A line goes if it lies in a run of equal lines, of min_words words or more and with a fingerprint of both,
    that stands in an earlier text or earlier in its own; all such runs of `guarantee` words or more have one. Later
    rows with the same text and another id lose all of it if it has min_words words or more; rows equal in id and text
    share one result. Shorter texts are left alone, null and empty ones too (null stays null, with 0 lines). An empty
    table gives an empty table. Lines and grams are told apart by 64-bit hashes. Columns of docs may have any names:
    they stay in `row`.
    """
    body = F.col(text)
    hashed = F.transform(F.split(body, "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    texts = docs.filter(body.isNotNull()).select(text_key(body).alias("k"), F.col(doc_id).cast("long").alias("id"), hashed.alias("lines"))
    classes = texts.groupBy("k").agg(F.min("id").alias("fd"), F.count("*").alias("copies"), F.first("lines").alias("lines"))
    marks = staged(fingerprints(classes, min_words, guarantee), "marks")
    cuts = _ranges(repeated_lines(marks.filter("key is not null")))
    heads = marks.filter(F.col("key").isNull() & (F.col("held") >= min_words)).select("k", "fd", "copies")
    known = heads.join(cuts, "k", "left").filter((F.col("copies") > 1) | F.col("cuts").isNotNull())
    rows = docs.select(F.struct("*").alias("row"), text_key(body).alias("k"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("id"))
    out = rows.join(known, "k", "left")
    body = F.col("row")[text]
    out = out.withColumn("parts", F.when(F.col("cuts").isNotNull() & (F.col("id") == F.col("fd")), F.split(body, "\n", -1)))
    n, size = F.size("cuts"), F.size("parts")

    def kept(i: Column) -> Column:
        """The lines before the cut i, behind the one before it."""
        begin = F.when(i == 0, 0).otherwise(F.get("cuts", i - 1)["last"] + 1)
        stop = F.when(i == n, size).otherwise(F.get("cuts", i)["first"])
        return F.slice("parts", begin + 1, F.greatest(stop - begin, F.lit(0)))

    left = F.when(F.col("parts").isNotNull(), F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), kept)), "\n"))
    clean = F.when(F.col("fd").isNull(), body).when(F.col("id") != F.col("fd"), F.lit("")).when(F.col("cuts").isNull(), body).otherwise(left)
    out = out.select("row", clean.alias("clean"))
    count = lambda c: F.when(F.length(c) > 0, F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    n_lines = F.coalesce(count(body), F.lit(0)).cast("long")
    return out.select("row", "clean", n_lines.alias("n_lines"), (n_lines - F.coalesce(count(F.col("clean")), F.lit(0))).cast("long").alias("n_removed"))
