"""Mixing sources to target weights: Efraimidis-Spirakis sampling without replacement, by words.

Each document gets the key u^(1/w): u is a uniform number made from its id, w its quality weight. Sorted by
falling key, a source's documents form a weighted random order; their sizes are prefix-summed to the source's
word budget. Whole epochs of a source come before the fractional part, which is taken from that order.

The keys lie in (0, 1), so their upper digits split a source into BUCKETS ranges in key order. Sums per
(source, bucket) give each bucket its offset, and only documents of one bucket are sorted together: a source
that holds a third of all rows is dealt to all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.llm.common import n_words

BUCKETS = 1024


def uniform(id_: Column, seed: int = 7) -> Column:
    """A number in (0, 1) from 52 bits of an md5 of the id; a null id counts as the text 'null'."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def quality_weight(text: Column) -> Column:
    """1 for texts of letters and white space alone, down to 0.25 as other characters take their place."""
    odd = F.length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", ""))
    return F.coalesce(1.0 - 0.75 * odd / F.greatest(F.length(text), F.lit(1)), F.lit(1.0))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes(src, source_size) -> src, source_size, target: weights in turn by code point order of the sources,
    null last; together the targets are `share` of all sizes; none is above `cap` times its source, what is cut
    off goes to the others by weight. In order of cap * size / weight the capped sources come first, and the
    level of the others is the largest of (budget - caps before) / (weights from here on)."""
    by_name, everything = Window.orderBy(F.col("src").asc_nulls_last()), Window.partitionBy()
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    one = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    one = one.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    w = Window.orderBy("ratio", F.col("src").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.sum("w").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    one = one.withColumn("level", (share * F.sum("source_size").over(everything) - before) / weight)
    target = F.least(F.col("most"), F.max("level").over(everything) * F.col("w"))
    return one.select("src", "source_size", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 7, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Every row of docs (of it the columns `keep`, if given: others are not shuffled) as struct `row`, with size, source_size, target, taken and copies.

    taken: the words of the document that the mix takes, repeats counted; one document of each source may be
    taken in part, so that the source's words meet its target. copies: whole copies, where a part of half a
    document or more counts as one. Null and empty texts have size 0 and are taken 0 words. Null sources form a
    source of their own. Rows that repeat an id share a key; their order among themselves has no effect beyond
    their sizes. An empty table gives an empty table. Columns of docs may have any names: they stay in `row`.
    """
    src = F.col(source)
    base = docs.select(F.struct(*(keep or "*")).alias("row"), F.col(doc_id).alias("id"), src.alias("src"), F.when(src.isNull(), "-").otherwise(F.concat(F.lit("+"), src)).alias("name"), n_words(F.col(text)).alias("size"), F.pow(uniform(F.col(doc_id), seed), 1.0 / quality_weight(F.col(text))).alias("key"))
    base = base.withColumn("bucket", F.least(F.floor((1.0 - F.col("key")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    sums = base.groupBy("name", "bucket").agg(F.sum("size").alias("words"), F.first("src").alias("src"))
    per_source = sums.groupBy("name").agg(F.sum("words").alias("source_size"), F.first("src").alias("src"))
    goal = targets(per_source, weights, share, cap).withColumn("name", F.when(F.col("src").isNull(), "-").otherwise(F.concat(F.lit("+"), "src"))).drop("src")
    above = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = sums.withColumn("offset", F.coalesce(F.sum("words").over(above), F.lit(0))).drop("words", "src").join(goal, "name")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("epochs", epochs.cast("long"))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    in_order = Window.partitionBy("name", "bucket").orderBy(F.col("key").desc(), F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    out = base.join(plan, ["name", "bucket"])
    before = F.col("offset") + F.coalesce(F.sum("size").over(in_order), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    out = out.withColumn("part", part.cast("long"))
    copies = F.col("epochs") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    return out.select("row", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), copies.cast("int").alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: each row of docs as often as it has copies, with the columns of docs."""
    out = mix(docs, **how).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
