"""Joins of strings by likeness: equi-joins on rare q-grams find every pair that can reach a ratio, then it is worked out.

A ratio is 2 * lcs / (both lengths), so a least ratio bounds the insertions and deletions between two strings and with
them the q-grams of a string that a partner can lack. Of its q-grams, repeats numbered, rarest first, a string needs as
keys only one more than it can lose: with a partner that is like enough it shares one of them. Nothing is lost, no pair
is met that shares frequent grams alone, and no side is copied whole.

`sides` writes the different strings of two DataFrames with a column s as one table (nulls are left out), which the joins
read; results have the columns a (from left) and b (from right).
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions import fuzzy
from folioloom.operators.staging import written

#: Characters of the keys for containment at most, and a margin for sums of floating-point numbers.
PIECE, EPS = 3, 1e-9


def sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """s, n (its length), on_right: the different strings of both sides."""
    both = left.select("s", F.lit(False).alias("on_right")).unionByName(right.select("s", F.lit(True).alias("on_right")))
    return written(both.filter("s is not null").distinct().select("s", F.length("s").alias("n"), "on_right"), "strings")


def _cut(text: Column, q: int) -> Column:
    """The q-grams of a text, none if it is shorter."""
    at = F.sequence(F.lit(1), F.length(text) - (q - 1))
    return F.when(F.length(text) >= q, F.transform(at, lambda i: text.substr(i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def _numbered(grams: Column) -> Column:
    """The grams with nth, which numbers a gram's repeats in one string from 1."""
    grams = F.array_sort(grams)
    return F.transform(grams, lambda g, i: F.struct(g.alias("gram"), (i + 2 - F.array_position(grams, g)).cast("int").alias("nth")))


def _rarest(keys: DataFrame, often: DataFrame, share: float) -> DataFrame:
    """Of each string's keys the rarest ones: one more than the share of its length."""
    rank = F.row_number().over(Window.partitionBy("s", "on_right").orderBy(F.coalesce("often", F.lit(0)), "gram", "nth"))
    known = keys.join(often, ["gram", "nth"], "left").withColumn("at", rank)
    return known.filter(F.col("at") <= F.floor(share * F.col("n") + EPS) + 1).select("s", "n", "on_right", "gram", "nth")


def _shorter(least: float) -> float:
    """The length that a partner has at least, as a share."""
    return least / (2 - least)


def _lost(least: float, q: int = 2) -> float:
    """The q-grams that a string can lack in a partner, as a share of its length: q for a deletion, one less for an
    insertion, most if the partner is as short as it can be."""
    return (q - 0.5) * (1 - least) * (1 + _shorter(least)) + 0.5 * (1 - _shorter(least))


def near_pairs(strings: DataFrame, least: float = 0.85, q: int = 2) -> DataFrame:
    """a, b, score: pairs whose ratio reaches least (above 2/3 for bigrams, nearer to 1 for longer q-grams, which are
    rarer). The empty string is like none, and strings are q - 2 characters long at least."""
    if not 1 - 0.5 / (q - 0.5) < least <= 1:
        raise ValueError("least must be above 2/3, and the more so for longer q-grams")
    text = F.concat(F.lit("\x02"), F.col("s"), F.lit("\x03"))
    keys = strings.filter("n > 0").select("*", F.explode(_numbered(_cut(text, q))).alias("g")).select("s", "n", "on_right", "g.*")
    often = keys.groupBy("gram", "nth").agg(F.count("*").alias("often"))
    rare = _rarest(keys, often, _lost(least, q))
    band = F.floor(F.log("n") / max(-log(_shorter(least)), 0.01) + EPS).cast("int")  # partners are in one band or in neighbouring ones
    x = rare.filter("not on_right").select(F.col("s").alias("a"), F.col("n").alias("na"), "gram", "nth", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    y = rare.filter("on_right").select(F.col("s").alias("b"), F.col("n").alias("nb"), "gram", "nth", band.alias("band"))
    met = x.join(y, ["gram", "nth", "band"]).filter(F.abs(F.col("na") - F.col("nb")) <= (1 - least) * (F.col("na") + F.col("nb")) + EPS)
    return met.select("a", "b").distinct().withColumn("score", fuzzy.ratio("a", "b")).filter(F.col("score") >= least)


def _ordered(met: DataFrame) -> DataFrame:
    """Pairs of s and t, of which one is on the right, as a and b."""
    return met.select(F.when(F.col("on_right"), F.col("t")).otherwise(F.col("s")).alias("a"), F.when(F.col("on_right"), F.col("s")).otherwise(F.col("t")).alias("b")).distinct()


def partial_pairs(strings: DataFrame, least: float) -> DataFrame:
    """a, b, score: pairs whose partial ratio (the shorter string with the best window of the longer one) reaches
    least (above 1/2). Windows are no longer than the shorter string, so its keys are met by those of the whole longer
    one. Keys are bigrams if a string of two characters keeps one, else single characters."""
    if not 0.5 < least <= 1:
        raise ValueError("least must be above 1/2")
    two, one = _cut(F.col("s"), 2), _cut(F.col("s"), 1)
    bigrams = _lost(least) < 0.5
    every = F.concat(_numbered(two), _numbered(one)) if bigrams else _numbered(one)
    all_keys = strings.select("*", F.explode(every).alias("g")).select("s", "n", "on_right", "g.*")
    often = all_keys.groupBy("gram", "nth").agg(F.count("*").alias("often"))
    own = all_keys.filter((F.length("gram") == 2) | (F.col("n") == 1)) if bigrams else all_keys
    short = _rarest(own, often, _lost(least) if bigrams else 1 - _shorter(least))
    long = all_keys.select(F.col("s").alias("t"), F.col("n").alias("nt"), F.col("on_right").alias("t_right"), "gram", "nth")
    met = short.join(long, ["gram", "nth"]).filter((F.col("on_right") != F.col("t_right")) & ((F.col("n") < F.col("nt")) | (F.col("n") == F.col("nt")) & ~F.col("on_right")))
    held = F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))
    score = F.when(held, 1.0).otherwise(fuzzy.partial_ratio(F.when(~held, F.col("a")), "b"))
    return _ordered(met).withColumn("score", score).filter(F.col("score") >= least)


def contained_pairs(strings: DataFrame) -> DataFrame:
    """a, b: pairs of which one string holds the other. A string's key is its rarest piece of up to PIECE characters;
    all pieces of the other side's strings are met by it. The empty string is held by every one."""
    sizes = [_cut(F.col("s"), q) for q in range(1, PIECE + 1)]
    held = strings.select(F.col("s").alias("t"), F.col("on_right").alias("t_right"), F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *sizes))).alias("piece"))
    often = held.groupBy("piece").agg(F.count("*").alias("often"))
    own = F.when(F.col("n") == 0, F.array(F.lit("")))
    for q, cut in enumerate(sizes, 1):
        own = own.when(F.col("n") == q if q < PIECE else F.col("n") >= q, cut)
    known = strings.select("s", "on_right", F.explode(own).alias("piece")).join(often, "piece")
    keyed = known.groupBy("s", "on_right").agg(F.min(F.struct("often", "piece"))["piece"].alias("piece"))
    return _ordered(keyed.join(held, "piece").filter((F.col("on_right") != F.col("t_right")) & F.col("t").contains(F.col("s"))))
