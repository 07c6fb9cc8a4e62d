"""Equal ratings give equal scores whatever the order of rows."""

import random

from folioloom.operators import ratings


def test_equal_ratings_have_equal_scores(spark):
    """Six ratings of 70 %: added up in other orders they would differ in the last digit."""
    blocks = [("fantlab", 7.0, 48), ("livelib", 7.0, 60), ("fantasy_worlds", 7.0, 42), ("kubikus", 3.5, 108), ("bookmix", 3.5, 84), ("loveread", 3.5, 0)]
    rng, rows = random.Random(3), []
    for work in range(60):
        rows += [(work, *b) for b in rng.sample(blocks, 6)]
    df = spark.createDataFrame(rows, "work_id long, source string, rating double, votes long")
    assert ratings.aggregate_rating(df.coalesce(1)).select("aggregate_rating", "n_valid").distinct().count() == 1
    bad = spark.createDataFrame([(1, "fantlab", 10.0, 3)], "work_id long, source string, rating double, votes long")
    assert tuple(ratings.aggregate_rating(bad).first()) == (1, None, 0)
