import math
import random
import unicodedata
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioloom.functions import fuzzy, text
from folioloom.operators import ratings


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "title, normal",
    [("78", "78"), ("Книга 3", "книга 3"), ("Колесо времени Грядущая буря", "грядущая буря"), ("Ёлка: роман", "елка"), ("The Dune", "dune"), ("", "")],
)
def test_normalize_title(spark, title, normal):
    assert one(spark, title, text.normalize_title) == normal


@pytest.mark.parametrize("token, stem", [("дюна", "дюна"), ("книга", "книг"), ("рассказ", "расск"), ("мастер", "масте")])
def test_stem(spark, token, stem):
    assert one(spark, token, text.stem) == stem


def test_compatibility_forms_are_found(spark):
    for s in ("ﬁne ① Ⅷ", "ｆｕｌｌ", "plain", "é", None):
        assert one(spark, s, text.nfkc) == (None if s is None else unicodedata.normalize("NFKC", s))


def test_stable_id_is_uuid5(spark):
    for name in ("fl:1", "fw:слово", "kubikus:42"):
        assert one(spark, name, text.stable_id) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_trim_and_lead(spark):
    assert one(spark, "a " * 600, text.trim_words) == "a " * 449 + "a…"
    assert one(spark, "Title. Rest of it", lambda x: text.strip_lead(x, F.lit("Title"))) == "Rest of it"
    assert one(spark, "Head - " + "t" * 50, lambda x: text.strip_lead(x, F.lit(""))) == "t" * 50


@settings(max_examples=200, deadline=None)
@given(st.text("abcé", max_size=12), st.text("abcé", max_size=12))
def test_lcs_against_the_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    assert fuzzy.lcs(a, b) == row[-1]
    assert fuzzy.indel(a, b) == fuzzy.indel(b, a) and 0 <= fuzzy.indel(a, b) <= 1


RATED = [("fantlab", 8.5, 10, True), ("fantlab", 8.5, 9, False), ("fantlab", 9.95, 99, False), ("fantlab", 9.95, 100, True), ("fantlab", 10.01, 500, False), ("fantlab", 0.0, 50, False), ("livelib", 4.5, None, False), ("bookmix", 4.94, 5, True), ("bookmix", 4.95, 500, False), ("kubikus", 4.0, 9, False), ("loveread", 4.0, None, True), ("loveread", 5.0, 900, False), ("unknown", 7.0, 10, True), ("fantlab", None, 50, False)]


def test_valid_ratings(spark):
    df = spark.createDataFrame(RATED, "source string, rating double, votes int, good boolean")
    assert df.filter(ratings.is_valid(F.col("source"), F.col("rating"), F.col("votes")) != F.col("good")).count() == 0


def test_aggregate_does_not_depend_on_order(spark):
    rows = [(i % 5, s, r, v) for i, (s, r, v, _) in enumerate(RATED * 3)]
    schema = "work_id int, source string, rating double, votes int"
    a = {r["work_id"]: r["aggregate_rating"] for r in ratings.aggregate_rating(spark.createDataFrame(rows, schema)).collect()}
    random.Random(1).shuffle(rows)
    b = {r["work_id"]: r["aggregate_rating"] for r in ratings.aggregate_rating(spark.createDataFrame(rows, schema)).collect()}
    assert a.keys() == b.keys() and all(a[k] is b[k] is None or math.isclose(a[k], b[k]) for k in a)
