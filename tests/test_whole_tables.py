"""Queries on pairs take every work of their table as a base."""

from folioloom.plans import fixtures as fx
from folioloom.plans import reports, views  # noqa: F401
from folioloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_titles_are_likened_for_every_work(spark):
    got = QUERIES["similar_basic_titles"](spark, DATA)
    bases = {r[0] for r in got.select("base_id").distinct().collect()}
    assert bases == {r[0] for r in fx.plain_works(spark, DATA).select("work_id").collect()} and len(bases) > 100


def test_cards_are_given_for_every_work(spark):
    works = [(r["work_id"], r["authors"][0]) for r in fx.plain_works(spark, DATA).collect()]
    want = {(a, b) for a, x in works for b, y in works if x == y and a != b}
    got = [tuple(r) for r in QUERIES["cards"](spark, DATA).select("base_id", "work_id").collect()]
    assert set(got) == want and len(got) == len(want) > 100
