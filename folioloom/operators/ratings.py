"""Ratings: validity rules, cleaning, and the vote-weighted score of a work.

Ratings are a long table (work_id, source, rating, votes); the rules of a source are columns of a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Source, top of its scale, least votes, whether votes are counted at all.
RATING_SCALE = (("fantlab", 10.0, 10, True), ("livelib", 10.0, 5, True), ("fantasy_worlds", 10.0, 10, True), ("kubikus", 5.0, 10, True), ("bookmix", 5.0, 5, True), ("loveread", 5.0, 0, False))
UNKNOWN_SCALE, UNKNOWN_VOTES = 10.0, 10
FIVE_POINT_TRUSTED, TEN_POINT_CEILING, CEILING_VOTES = 4.94, 9.95, 100


def rating_scale(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATING_SCALE, "source string, scale double, min_votes int, counts_votes boolean")


def _of(source: Column, field: int, unknown) -> Column:
    """A rule of a source as an expression: the table has six rows, so no join is needed."""
    return F.coalesce(*(F.when(source == s[0], F.lit(s[field])) for s in RATING_SCALE), F.lit(unknown))


def scale_of(source: Column) -> Column:
    return _of(source, 1, UNKNOWN_SCALE)


def is_valid(source: Column, rating: Column, votes: Column) -> Column:
    """Whether a rating can be trusted: in scale, not at the ceiling, with enough votes. Never null."""
    top, n = scale_of(source), F.coalesce(votes, F.lit(0))
    counted, least = _of(source, 3, True), _of(source, 2, UNKNOWN_VOTES)
    ceiling = F.when(top <= 5.0, rating > FIVE_POINT_TRUSTED).otherwise((rating >= TEN_POINT_CEILING) & (n < CEILING_VOTES))
    return F.coalesce((rating > 0) & (rating <= top) & ~ceiling & (~counted | (n >= least)), F.lit(False))


def to_percent(source: Column, rating: Column) -> Column:
    return rating / scale_of(source) * 100


def normalized_score(rating: Column, rating_max: Column) -> Column:
    return rating / rating_max * 100


def vote_weight(source: Column, votes: Column) -> Column:
    """ln(1 + votes), ln 2 without votes, 1 for sources that count none."""
    n = F.when(F.coalesce(votes, F.lit(0)) <= 0, F.lit(1)).otherwise(votes)
    return F.when(_of(source, 3, True), F.log1p(n.cast("double"))).otherwise(F.lit(1.0))


def aggregate_rating(ratings: DataFrame) -> DataFrame:
    """work_id, aggregate_rating (null if no source is valid), n_valid. A work's terms, one a source, are added in the order of
    the sources, so that equal ratings give equal scores to the last digit, however the table is cut."""
    ok = is_valid(F.col("source"), F.col("rating"), F.col("votes"))
    weight = vote_weight(F.col("source"), F.col("votes"))
    term = F.struct("source", (weight * to_percent(F.col("source"), F.col("rating"))).alias("x"), weight.alias("w"))
    total = lambda field: F.aggregate("terms", F.lit(0.0), lambda s, t: s + t[field])
    out = ratings.groupBy("work_id").agg(F.array_sort(F.collect_list(F.when(ok, term))).alias("terms"))
    return out.select("work_id", F.when(F.size("terms") > 0, total("x") / total("w")).alias("aggregate_rating"), F.size("terms").cast("long").alias("n_valid"))


def clean_blocks(ratings: DataFrame) -> DataFrame:
    """Ratings that are not valid lose rating and votes, sources without counted votes lose votes; rows with nothing
    left (no id, no address, no rating) go."""
    ok = is_valid(F.col("source"), F.col("rating"), F.col("votes"))
    counted = _of(F.col("source"), 3, True)
    out = ratings.withColumn("was_valid", ok).withColumn("votes", F.when(ok & counted, F.col("votes"))).withColumn("rating", F.when(ok, F.col("rating")))
    held = [F.col(c).isNotNull() for c in ("ext_id", "url", "rating") if c in ratings.columns]
    keep = held[0]
    for h in held[1:]:
        keep = keep | h
    return out.filter(keep).drop("was_valid")


def scrub_ceiling(ratings: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Works with their score worked out anew from valid ratings, and one row of counts: ratings dropped, scores
    changed, scores of 99.5 or more."""
    new = works.drop("aggregate_rating").join(aggregate_rating(ratings), "work_id", "left")
    both = works.select("work_id", F.col("aggregate_rating").alias("old")).join(new.select("work_id", "aggregate_rating"), "work_id")
    changed = ~F.round("old", 2).eqNullSafe(F.round("aggregate_rating", 2))
    counts = both.agg(F.count_if(changed).alias("changed"), F.count_if(F.col("aggregate_rating") >= 99.5).alias("at_ceiling"))
    dropped = ratings.agg(F.count_if(F.col("rating").isNotNull() & ~is_valid(F.col("source"), F.col("rating"), F.col("votes"))).alias("dropped"))
    return new, dropped.crossJoin(counts)  # one row and one row


def source_triples(blocks: DataFrame, primary: str = "primary", link: str = "link") -> DataFrame:
    """Contributing blocks of each work and source: the primary one, else the linked one."""
    first = F.min_by(F.struct("rating", "votes"), F.when(F.col("kind") == primary, 0).when(F.col("kind") == link, 1).otherwise(2))
    return blocks.groupBy("work_id", "source").agg(first.alias("b")).select("work_id", "source", "b.rating", "b.votes")


def fill_rating(works: DataFrame, cache: DataFrame) -> DataFrame:
    """Rating and votes from a cache by id, only where the rating is missing. Cached ratings may be text."""
    c = cache.select("work_id", F.expr("try_cast(rating as double)").alias("cached"), F.col("votes").alias("cached_votes"))
    missing = F.col("rating").isNull()
    return works.join(c, "work_id", "left").withColumn("votes", F.when(missing & F.col("cached").isNotNull(), F.col("cached_votes")).otherwise(F.col("votes"))).withColumn("rating", F.coalesce("rating", "cached")).drop("cached", "cached_votes")


def link_block(source: Column, ext_id: Column, rating: Column, votes: Column) -> Column:
    """A secondary link; its rating stays only if it is valid."""
    ok = is_valid(source, rating, votes)
    return F.struct(ext_id.alias("id"), F.when(ok, rating).alias("rating"), F.when(ok, votes).alias("votes"))
