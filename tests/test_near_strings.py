"""Joins by likeness against comparing all pairs, and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from folioloom.functions import fuzzy
from folioloom.operators import link, near, search


def _strings(seed: int, n: int, alphabet: str = "abc ") -> list[str | None]:
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(n)]
    edited = []
    for s in base:  # a few letters inserted, deleted, replaced
        t = list(s)
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(t) + 1)
            t[k : k + rnd.randint(0, 1)] = rnd.choice(["", rnd.choice(alphabet), "é😀"])
        edited.append("".join(t))
    return [*base, *edited, None, "", "a", "ab", "aaaaaaaa"]


def _df(spark, strings):
    return spark.createDataFrame([(s,) for s in strings], "s string")


@pytest.mark.parametrize("seed", range(2))
def test_pairs_are_those_of_all_pairs(spark, seed):
    left, right = _strings(seed, 60), _strings(seed + 10, 60) + _strings(seed, 60)[30:]
    a, b = _df(spark, left), _df(spark, right)
    strings = near.sides(a, b)
    every = [(x, y) for x in set(left) - {None} for y in set(right) - {None}]
    for least in (0.7, 0.85, 0.98):
        got = {(r["a"], r["b"]): r["score"] for r in near.near_pairs(strings, least).collect()}
        assert got == {(x, y): s for x, y in every if (s := fuzzy.indel(x, y)) >= least}, least
    for least in (0.55, 0.7, 0.88):
        got = {(r["a"], r["b"]): r["score"] for r in near.partial_pairs(strings, least).collect()}
        assert got == {(x, y): s for x, y in every if (s := fuzzy.partial(x, y)) >= least}, least
    assert {(r["a"], r["b"]) for r in near.contained_pairs(strings).collect()} == {(x, y) for x, y in every if x in y or y in x}
    assert near.near_pairs(near.sides(a.limit(0), b)).count() == near.contained_pairs(near.sides(a, b.limit(0))).count() == 0


def test_genres_are_resolved_without_a_nested_loop(spark):
    rnd = random.Random(3)
    words = ["fantasy", "dark", "romance", "space", "opera", "crime", "noir", "sea"]
    names = sorted({" ".join(rnd.sample(words, rnd.randint(1, 3))) for _ in range(40)} | {"historical"})
    needles = [*names[:8], "fantazy", "dark ", "Space Opra", "crme noir", "x", "", "historcal", "zzzz", None]
    dim = spark.createDataFrame([(n,) for n in names], "name string")
    wanted = spark.createDataFrame([(k % 3, n) for k, n in enumerate(needles)], "query_id int, needle string")
    want, scores = set(), {}
    for k, needle in enumerate(needles):
        if needle is None:
            continue
        n = needle.strip(" ").lower()
        equal, held = [g for g in names if g == n], [g for g in names if n in g or g in n]
        like = sorted((-fuzzy.partial(n, g), g) for g in names if fuzzy.partial(n, g) >= 0.88)
        want |= {(k % 3, needle, g, t) for t, found in enumerate((equal, held, [g for _, g in like[:1]])) if found and not any((equal, held)[:t]) for g in found}
        for g in names:
            s = 1.0 if g == n else 0.88 if g in held else round(0.72 * fuzzy.partial(n, g), 3)
            if s >= 0.5:
                scores[k % 3, needle, g] = s
    got = search.resolve_genres(dim, wanted)
    assert {(r["query_id"], r["needle"], r["name"], r["tier"]) for r in got.collect()} == want and {t for *_, t in want} == {0, 1, 2}
    by_score = search.genre_scores(dim, wanted)
    assert {(r["query_id"], r["needle"], r["name"]): r["score"] for r in by_score.collect()} == pytest.approx(scores)
    for df in (got, by_score):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hints_by_id_title_and_place(spark):
    titles = ["Dune the great", "Other book of sand", "great", "Dune the great", "a quiet town by the sea"]
    records = spark.createDataFrame([(i + 10, t, i + 1) for i, t in enumerate(titles)], "id long, title string, place int")
    rows = [("f1", "12", "whatever"), ("f2", "zz", "great the Dune"), ("f3", "5", "nothing alike"), ("f4", "99", "nothing alike"), ("f5", "1", "quiet sea by a the towns"), ("f6", None, None), ("f7", "zz", "the great Dune")]  # f7: its normal form has no leading "the", so the ratio is 0.83
    files = spark.createDataFrame(rows, "name string, prefix string, hint string")
    got = {r["name"]: (r["record_id"], r["by"]) for r in link.hint_link(files, records, place="place").collect()}
    assert got == {"f1": (12, "id"), "f2": (10, "hint"), "f3": (14, "place"), "f5": (14, "hint")}
    plain = link.hint_link(files, records)
    assert {r["name"] for r in plain.collect()} == {"f1", "f2", "f5"}
    assert "NestedLoop" not in plain._jdf.queryExecution().executedPlan().toString()
    assert plain.filter(F.col("by") == "id").first()["score"] == 1.0
