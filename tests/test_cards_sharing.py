"""Cards of all works that share a value with a base: pairs are made once, with their columns."""

from folioloom.operators import jobs


def test_pairs_carry_their_cards_and_are_joined_once(spark):
    works = spark.createDataFrame([(k, f"t{k}", None if k == 11 else f"a{k % 3}", float(k)) for k in range(40)] + [(99, "copy", "a0", None)], "work_id long, title string, authors string, aggregate_rating double")
    bases = works.filter("work_id % 10 = 0 or work_id = 11").selectExpr("work_id AS base_id", "authors")
    got = jobs.cards_sharing(bases, works, "authors")
    pairs = works.select("work_id", "authors").join(bases, "authors").filter("base_id <> work_id").select("base_id", "work_id")
    want = jobs.cards(pairs, works)
    columns = ["base_id", "work_id", "title", "authors", "aggregate_rating"]
    assert sorted(got.select(columns).collect(), key=str) == sorted(want.select(columns).collect(), key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
