"""Document fingerprints: closed syncmers over words.

A text's words get 32-bit hashes. A k-mer is K words, its inner substrings are S words long. The k-mer is an
anchor if the least hash among its inner substrings stands first or last in it. That depends on the k-mer alone,
so a passage keeps its anchors wherever it stands and whatever surrounds it. K - 1 fixed marks stand before the
text, so that a text of any length with a word has k-mers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.llm.common import SPACE, staged, text_key

K, S = 5, 2


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """df with column `out`: array<struct<pos int, hash int>>, the anchors of `text` by position, counted in words
    from 0; null text counts as empty and has none. Each step is a projection of its own, so that Spark evaluates
    an array once and not once for each element of a later lambda."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda x: x != "")
    df = df.withColumn(out, F.concat(F.array_repeat(F.lit(0), k - 1), F.transform(words, lambda x: F.hash(x))))
    width = k - s + 1
    inner = F.transform(F.sequence(F.lit(1), F.greatest(F.size(out) - s + 1, F.lit(1))), lambda i: F.hash(F.slice(out, i, s)))
    df = df.withColumn(out, F.struct(F.col(out).alias("w"), F.when(F.size(out) >= k, inner).alias("m")))
    m, w = F.col(out)["m"], F.col(out)["w"]
    n = F.size(w) - k + 1

    def edge(i: Column) -> Column:
        least = F.array_min(F.slice(m, i, width))
        return (F.element_at(m, i) == least) | (F.element_at(m, i + F.lit(width - 1)) == least)

    starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), edge)
    df = df.withColumn(out, F.struct(w.alias("w"), F.when(m.isNotNull(), starts).alias("i")))
    at = F.transform(F.col(out)["i"], lambda i: F.struct((i - k).cast("int").alias("pos"), F.hash(F.slice(F.col(out)["w"], i, k)).alias("hash")))
    return df.withColumn(out, F.coalesce(at, F.array().cast("array<struct<pos:int,hash:int>>")))


def as_text(anchors: Column) -> Column:
    """A fingerprint as a string: eight hex digits for each anchor, in order of position."""
    return F.array_join(F.transform(anchors, lambda a: F.lower(F.lpad(F.hex(a["hash"].cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Twice the anchors that both have, over the anchors of each, counting equal hashes once; 1 for two without any."""
    x, y = (F.array_distinct(c) for c in (a, b))
    both = F.size(x) + F.size(y)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / both)


def matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positional matching: (id, anchors) tables joined on the anchors' hashes; one row for each pair of ids and
    shift with the number of anchors on that diagonal and the range of words that they span."""
    one = lambda df, n: df.select(F.col("id").alias(f"{n}_id"), F.explode("anchors").alias("a")).select(f"{n}_id", F.col("a.hash").alias("hash"), F.col("a.pos").alias(f"{n}_pos"))
    met = one(left, "left").join(one(right, "right"), "hash")
    return met.groupBy("left_id", "right_id", (F.col("right_pos") - F.col("left_pos")).alias("shift")).agg(F.count("*").alias("anchors"), F.min("left_pos").alias("first"), F.max("left_pos").alias("last"))


def next_documents(ids: DataFrame, slices: int = 64) -> DataFrame:
    """ids(id, key, n) -> each row with next, the key of the row that follows by (id, key), null ids last; the last
    is followed by the first. Neighbours are found inside ranges of ids; only each range's ends meet in one task."""
    ids = staged(ids.repartitionByRange(slices, F.col("id").asc_nulls_last()).select("*", F.spark_partition_id().alias("part")), "ids")
    inside = ids.withColumn("next", F.lead("key").over(Window.partitionBy("part").orderBy(F.col("id").asc_nulls_last(), "key")))
    starts = ids.groupBy("part").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("s")).select("part", F.col("s.key").alias("start"))
    around = Window.orderBy("part")
    heads = starts.select("part", F.coalesce(F.lead("start").over(around), F.first("start").over(Window.partitionBy().orderBy("part"))).alias("start"))
    return inside.join(heads, "part").select("key", "n", F.coalesce("next", "start").alias("next"))


def edited_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter of code points gives way to the start
    of the next document.

    One row for each row of docs: doc_id, n_chars, edited, edited_sha256, anchors, edited_anchors, fingerprint,
    edited_fingerprint, near_edited, near_next, next_doc_id. Rows equal in id and text are one document among the neighbours
    and have equal results. Null texts count as empty, null ids come last; different texts under one id follow
    each other by their keys (md5 of id and text). A single document is its own next one. An empty table gives an
    empty result; other columns of docs are ignored.
    """
    id_, t = F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(id_.alias("id"), t.alias("t"), text_key(F.concat(F.coalesce(id_.cast("string"), F.lit("-")), F.lit(":"), t)).alias("key"))
    follow = next_documents(rows.groupBy("key").agg(F.first("id").alias("id"), F.first(F.length("t")).alias("n")))
    owned = follow.select(F.col("key").alias("owner"), F.col("next").alias("key"), F.floor(F.col("n") / 4).cast("int").alias("q"))
    heads = rows.join(owned, "key").select("owner", "q", F.col("id").alias("next_doc_id"), F.substring(F.col("t"), F.lit(1), F.col("q")).alias("head"), "t")
    heads = with_anchors(heads, "t", "next_anchors").select(F.col("owner").alias("key"), "q", "next_doc_id", "head", F.array_distinct("next_anchors.hash").alias("next_anchors"))
    out = rows.join(heads.dropDuplicates(["key"]), "key")
    out = out.withColumn("n_chars", F.length("t").cast("long")).withColumn("edited", F.concat(F.substring(F.col("t"), F.lit(1), F.col("n_chars").cast("int") - F.col("q")), F.col("head")))
    out = with_anchors(with_anchors(out, "t", "anchors"), "edited", "edited_anchors")
    return out.select(F.col("id").alias("doc_id"), "n_chars", "edited", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "anchors", "edited_anchors", as_text(F.col("anchors")).alias("fingerprint"), as_text(F.col("edited_anchors")).alias("edited_fingerprint"), likeness(F.col("anchors.hash"), F.col("edited_anchors.hash")).alias("near_edited"), likeness(F.col("anchors.hash"), F.col("next_anchors")).alias("near_next"), "next_doc_id")
