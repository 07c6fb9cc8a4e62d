import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData as DataFrameGroups

from folioloom.operators import catalog, extract, genres, jobs, link, reviews, samples, search, similar, snapshot
from folioloom.functions.profile import AXIS_NAMES

CASES = [
    ("Таинственный остров", "Жюль Верн", "Остров", "Ширли Рейн", "<"), ("Таинственный остров", "Жюль Верн", "Таинственный остров", "Жюль Верн", ">="), ("78", "Макс Фрай", "78", "Макс Фрай", ">="),
    ("Профессия: ведьма", "Громыко Ольга", "Профессия: ведьма", "Ольга Громыко", ">="), ("Ведьма", "Ольга Громыко", "Хранитель", "Ольга Голотвина", "0"), ("Дюна", "Фрэнк Герберт", "Дюна", "Френк Герберт", ">="),
    ("Таинственный остров", "Жюль Верн", "Остров", "Жюль Верн", "0"), ("Возрожденное орудие", "Юн Ха Ли", "Возрожденное орудие", "Юн Ха Ли", ">="), ("Дюна", None, "Дюна", "Фрэнк Герберт", "0"),
]


def test_pair_scores(spark):
    rows = [(i, a, [b] if b else [], c, [d]) for i, (a, b, c, d, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, left_title string, left_authors array<string>, right_title string, right_authors array<string>")
    for r in link.score_pairs(df).collect():
        want = CASES[r["i"]][4]
        assert (r["score"] >= 0.98) if want == ">=" else (r["score"] < 0.98 if want == "<" else r["score"] == 0), CASES[r["i"]]


def test_candidates_find_what_scores(spark):
    left = spark.createDataFrame([(i, i, a, [b]) for i, (a, b, *_) in enumerate(CASES) if b], "id long, pos long, title string, authors array<string>")
    right = spark.createDataFrame([(i, i, c, [d]) for i, (_, b, c, d, _) in enumerate(CASES)], "id long, pos long, title string, authors array<string>")
    found = {(r["left_id"], r["right_id"]) for r in link.candidates(left, right).collect()}
    assert all(((i, i) in found) == (w == ">=") for i, (_, b, _, _, w) in enumerate(CASES) if b)
    long = "очень длинное название одной книги о дальних странах и морях"
    a = spark.createDataFrame([(1, 1, long, ["Жюль Верн"])], left.schema)
    b = spark.createDataFrame([(2, 2, long + "x", ["Жюль Верн"])], left.schema)
    assert link.candidates(a, b).count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_one_to_one_is_the_sequential_greedy(spark, seed):
    rnd = random.Random(seed)
    pairs = {(rnd.randrange(8), 100 + rnd.randrange(8)): rnd.choice([0.98, 0.99, 1.0]) for _ in range(30)}
    pairs |= {(20 + k, 120 + j): 1.0 for k in range(3) for j in range(3)}  # a tied block
    df = spark.createDataFrame([(a, a, b, b, s) for (a, b), s in pairs.items()], "left_id long, left_pos long, right_id long, right_pos long, score double")
    used, want = set(), {}
    for a in sorted({a for a, _ in pairs}):
        free = [(-s, b) for (x, b), s in pairs.items() if x == a and b not in used]
        if free:
            want[a] = min(free)[1]
            used.add(want[a])
    assert {r["left_id"]: r["right_id"] for r in link.one_to_one(df).collect()} == want
    assert {r["left_id"]: r["right_id"] for r in link.one_to_one(df, size=3).collect()} == want


def test_genre_rules(spark):
    names = {"фантастика": True, "young adult": True, "18+": False, "1984": False, "sf_space": False, "Япония": False, "Миры Стругацких": False, "Иван Петров": False, "Marvel": False, "Боевая Магия": False, "космические приключения": True, "Зима": False, "Детектив": True}
    df = spark.createDataFrame([(n, g) for n, g in names.items()], "name string, good boolean")
    assert {r["name"] for r in df.filter(genres.is_genre(F.col("name"), F.lit(10)) != F.col("good")).collect()} == set()
    assert df.filter(genres.is_genre(F.col("name"), F.lit(9))).count() == 0


def test_text_score_tiers(spark):
    work = ("Золотой ключик", ["Алексей Толстой"], ["сказка"])
    want = {"золотой ключик": 1.0, "ключик золотой": 0.98, "ключик толстой": 0.93, "ключик сказка": 0.78, "ключики": 0.92, "толстого": 0.9, "сказк": 0.85, "": 1.0, "совсем другое": 0.0}
    df = spark.createDataFrame([(1, *work)], "pos long, title string, authors array<string>, genres array<string>")
    q = spark.createDataFrame([(k,) for k in want], "query string")
    got = {r["query"]: r["text_score"] for r in search.text_score(search.prepare(df).crossJoin(q)).collect()}
    assert got == pytest.approx(want)


def test_neighbors_against_scores(spark):
    rnd = random.Random(3)
    rows = [(i, *(rnd.randint(1, 10) for _ in AXIS_NAMES), rnd.sample("abcdef", rnd.randint(0, 3)), rnd.sample("xyz", 2)) for i in range(25)]
    df = spark.createDataFrame(rows, f"work_id long, {', '.join(f'{n} int' for n in AXIS_NAMES)}, themes array<string>, tropes array<string>")
    exact = {(r["base_id"], r["work_id"], r["mode"]): r["score"] for r in similar.pair_scores(df, df).collect()}
    found = similar.neighbors(df, k=4, blocks=3).collect()
    assert all(0 <= s <= 1 and abs(s - exact[b, a, m]) < 1e-9 for (a, b, m), s in exact.items())
    for i in range(25):
        for m in similar.ALL_MODES:
            best = sorted((-s, b) for (a, b, mode), s in exact.items() if a == i and mode == m)[:4]
            got = sorted((r["rank"], r["neighbor_id"], r["score"]) for r in found if r["work_id"] == i and r["mode"] == m)
            assert [s for _, _, s in got] == pytest.approx([-s for s, _ in best])


def test_reviews_and_lists(spark):
    r = spark.createDataFrame([(1, "a", 2, "Same  text"), (1, "b", 1, "same text"), (1, "a", 3, " "), (2, "a", 1, "x")], "work_id int, source string, seq int, text string")
    assert sorted((x["work_id"], x["seq"]) for x in reviews.dedupe(r).collect()) == [(1, 1), (2, 1)]
    lists = spark.createDataFrame([(1, "b", 1, 4.0), (1, "a", 2, 4.99), (2, "a", 1, None)], "id int, list_name string, seq int, rating double")
    assert {x["id"]: (x["lists"], x["rating"]) for x in jobs.merge_lists(lists).collect()} == {1: (["a", "b"], 4.0), 2: (["a"], None)}


def test_pages(spark):
    html = '<h1>A &amp; B</h1><script type="application/ld+json">{"@type":"Book","name":"N","author":[{"name":"X"},{"name":"Y"}],"aggregateRating":{"ratingValue":"8,5","ratingCount":"1 200"}}</script><a href="/genre/1">g</a><a href="/genre/2">g</a>'
    p = spark.createDataFrame([(1, "http://x/b/12.html", html), (2, "u", "")], "page_id int, url string, html string")
    r = extract.item_pages(p, "s").first()
    assert (r["external_id"], r["title"], r["genres"]) == ("12", "A & B", ["g"])
    j = extract.embedded_json(p).first()
    assert (j["name"], j["authors"], j["rating"], j["votes"]) == ("N", ["X", "Y"], 8.5, 1200)
    texts = spark.createDataFrame([('x ```json\n{"a":1}\n``` {"b":2}',), ('so {"c": {"d":1}} end',), ("none",)], "t string")
    assert [x[0] for x in texts.select(extract.json_in_text(F.col("t"))).collect()] == ['{"a":1}', '{"c": {"d":1}}', None]


def test_catalog_tables(spark, tmp_path):
    w = spark.createDataFrame([(i, f"title {i % 3}", ["An Author"], ["one", "two"], float(i % 7) if i % 2 else None) for i in range(40)], "work_id long, title string, authors array<string>, genres array<string>, aggregate_rating double")
    root = str(tmp_path / "c")
    counts = snapshot.write_catalog(w, genres.genre_counts(w), root, buckets=3)
    assert counts == {"works": 40, "token_hits": counts["token_hits"], "genre_works": 80, "author_works": 40, "catalog_genres": 2}
    pos = [(r["pos"], r["aggregate_rating"] or 0.0, r["title"]) for r in catalog.catalog_position(w).collect()]
    assert sorted(p[0] for p in pos) == list(range(1, 41))
    assert [(-r, t) for _, r, t in sorted(pos)] == sorted((-r, t) for _, r, t in pos)


def test_snapshots_are_read_whole(spark, tmp_path):
    """A reader keeps the snapshot that it began with; one that is half written, or whose writer died, is never seen."""
    root = str(tmp_path / "c")
    works = lambda n: spark.createDataFrame([(i, f"title {i % 3}", ["An Author"], ["one"], 1.0) for i in range(n)], "work_id long, title string, authors array<string>, genres array<string>, aggregate_rating double")
    with pytest.raises(FileNotFoundError):
        snapshot.read_catalog(spark, root)
    snapshot.write_catalog(works(5), genres.genre_counts(works(5)), root, buckets=2)
    old = snapshot.read_catalog(spark, root)
    broken = {"works": works(9), "token_hits": works(9).select(F.raise_error(F.lit("killed")).alias("token"))}
    with pytest.raises(Exception, match="killed"):
        snapshot.write_tables(spark, broken, root, buckets=2)
    sizes = lambda t: {n: df.count() for n, df in t.items()}
    assert sizes(snapshot.read_catalog(spark, root)) == sizes(old)
    snapshot.write_catalog(works(7), genres.genre_counts(works(7)), root, buckets=2)
    assert sizes(old)["works"] == 5 and sizes(snapshot.read_catalog(spark, root))["works"] == 7
    snapshot.write_catalog(works(8), genres.genre_counts(works(8)), root, buckets=2)
    assert len([x for x in (tmp_path / "c").iterdir() if x.name.startswith("snapshot")]) == 3  # two, and what the killed one left
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("read_", "written_"))]


def test_a_lookup_shuffles_no_index(spark, tmp_path):
    root = str(tmp_path / "c")
    w = spark.createDataFrame([(i, f"title {i % 3}", ["An Author"], ["one"], 1.0) for i in range(50)], "work_id long, title string, authors array<string>, genres array<string>, aggregate_rating double")
    snapshot.write_catalog(w, genres.genre_counts(w), root, buckets=5)
    hits = snapshot.read_catalog(spark, root)["token_hits"]
    asked = spark.createDataFrame([(1, "title"), (2, "author")], "query_id long, token string").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = hits.join(asked, "token")
        assert joined.count() == 100
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left = plan[: plan.index("Scan parquet")]
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and "Exchange" not in left


def test_neighbors_in_blocks_of_bounded_size(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, *(rnd.randint(1, 10) for _ in AXIS_NAMES), rnd.sample("abcdef", 2), rnd.sample("xyz", 2)) for i in range(120)]
    df = spark.createDataFrame(rows, f"work_id long, {', '.join(f'{n} int' for n in AXIS_NAMES)}, themes array<string>, tropes array<string>")
    seen = spark.sparkContext.accumulator(0)
    plain = similar._neighbour_block

    def counted(k):
        run = plain(k)

        def wrapped(rows, others):
            seen.add(1)
            return run(rows, others)

        return wrapped

    key = lambda x: sorted((r["work_id"], r["mode"], r["rank"], round(r["score"], 9)) for r in x)
    want = key(similar.neighbors(df, k=3, blocks=1).collect())
    monkeypatch.setattr(similar, "BLOCK", 10)
    monkeypatch.setattr(similar, "_neighbour_block", counted)
    assert key(similar.neighbors(df, k=3).collect()) == want
    assert seen.value >= 100  # 12 blocks against 12, some of them empty


@pytest.mark.parametrize("seed", range(2))
def test_neighbors_skip_blocks_and_lose_none(spark, monkeypatch, seed):
    """Profiles in groups that are alike: most pairs of blocks are skipped, and ids, ties and ranks are those of all pairs."""
    rnd, rows = random.Random(seed), []
    for group in range(12):
        middle = [rnd.choice((1, 2, 9, 10)) for _ in AXIS_NAMES]
        themes, tropes = ([f"{kind}{group % 6}", f"{kind}{group}x"] for kind in ("theme", "trope"))
        rows += [(group * 100 + i, *(min(10, max(1, v + rnd.randint(-1, 1))) for v in middle), rnd.sample(themes, 1), tropes) for i in range(25)]
    rows += [(5000 + i, *rows[0][1:]) for i in range(6)] + [(6000, *(None for _ in AXIS_NAMES), None, None), (6001, *(0 for _ in AXIS_NAMES), [], [" "])]
    df = spark.createDataFrame(rows, f"work_id long, {', '.join(f'{n} int' for n in AXIS_NAMES)}, themes array<string>, tropes array<string>")
    tables, plain = {}, similar.written
    monkeypatch.setattr(similar, "written", lambda d, name: tables.setdefault(name, plain(d, name)) if name == "block-pairs" else plain(d, name))
    key = lambda x: sorted((r["work_id"], r["mode"], r["rank"], r["neighbor_id"], r["score"]) for r in x)
    want = key(similar.neighbors(df, k=5, blocks=1).collect())
    assert key(similar.neighbors(df, k=5, blocks=36).collect()) == want
    scored = tables["block-pairs"].agg(F.count("*"), F.sum(F.size(F.filter("live", lambda x: x)))).first()
    assert scored[0] < 0.1 * 36 * 35 and scored[1] < 0.1 * 36 * 35 * 7, scored  # of all pairs of different blocks, and of these in all modes
    assert similar.neighbors(df.limit(0), k=5).count() == 0 and similar.neighbors(df.limit(1), k=5, blocks=3).count() == 0


@pytest.mark.parametrize("size, most", [(None, 1), (2500, 9)])
def test_long_chains_take_few_rounds(spark, monkeypatch, size, most):
    """Each of 10 000 lefts is refused because the one before was: as many rounds as ranges, and no group of pairs in one task."""
    monkeypatch.setattr(DataFrameGroups, "applyInPandas", None)
    n, rounds, plain = 10_000, [], link.written
    monkeypatch.setattr(link, "written", lambda df, name: (rounds.append(name) if name == "best" else None, plain(df, name))[1])
    ids = spark.range(1, n + 1).select(F.col("id").alias("left_id"), F.explode(F.when(F.col("id") == 1, F.array("id")).otherwise(F.array(F.col("id") - 1, F.col("id")))).alias("right_pos"))
    df = ids.select("left_id", F.col("left_id").alias("left_pos"), (100_000 + F.col("right_pos")).alias("right_id"), "right_pos", F.lit(1.0).alias("score"))
    got = link.one_to_one(df, size)
    assert got.count() == n and got.filter("right_id != 100000 + left_id").count() == 0
    assert 1 <= len(rounds) <= most


@pytest.mark.parametrize("seed", range(2))
def test_one_to_one_over_ranges_is_the_sequential_greedy(spark, seed):
    """Larger random pairs with ties of score and place, text ids and one right that all want, cut into many ranges."""
    rnd = random.Random(seed)
    pairs = {(f"l{rnd.randrange(300)}", f"r{rnd.randrange(200)}"): rnd.choice([0.98, 0.99, 1.0]) for _ in range(900)} | {(f"l{k}", "hot"): 1.0 for k in range(300)}
    place = lambda x: int(x[1:]) // 3 if x != "hot" else 0
    used, want = set(), {}
    for a in sorted({a for a, _ in pairs}, key=lambda a: (place(a), a)):
        free = [(-s, place(b), b) for (x, b), s in pairs.items() if x == a and b not in used]
        if free:
            want[a] = min(free)[2]
            used.add(want[a])
    df = spark.createDataFrame([(a, place(a), b, place(b), s) for (a, b), s in pairs.items()], "left_id string, left_pos long, right_id string, right_pos long, score double")
    assert {r["left_id"]: r["right_id"] for r in link.one_to_one(df, 100).collect()} == want


def test_ranges_may_be_more_than_asked_for(spark, monkeypatch):
    """Results go by the partitions that there are, not by the number that was asked for."""
    kind, rnd = type(spark.range(1)), random.Random(1)
    plain = kind.repartitionByRange
    rows = [(i, *(rnd.randint(1, 10) for _ in AXIS_NAMES), rnd.sample("abc", 1), ["x"]) for i in range(40)]
    df = spark.createDataFrame(rows, f"work_id long, {', '.join(f'{n} int' for n in AXIS_NAMES)}, themes array<string>, tropes array<string>")
    pairs = spark.createDataFrame([(k, k, 100 + j, j, 1.0) for k in range(1, 9) for j in {1, k - 1, k} if j], "left_id long, left_pos long, right_id long, right_pos long, score double")
    key = lambda x: sorted((r["work_id"], r["mode"], r["rank"], r["neighbor_id"], r["score"]) for r in x)
    want = key(similar.neighbors(df, k=2, blocks=1).collect())
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, n, *by: plain(self, max(n, 5), *by))
    assert key(similar.neighbors(df, k=2, blocks=2).collect()) == want and key(similar.neighbors(df, k=2, blocks=1).collect()) == want
    for size in (None, 9):
        assert {r["left_id"]: r["right_id"] - 100 for r in link.one_to_one(pairs, size).collect()} == {k: k for k in range(1, 9)}


def test_samples_are_the_same_for_any_split(spark):
    rows = [(i, f"s{i % 3 if i % 7 else 0}") for i in range(500)] + [(None, "s1"), (3, "s0")]
    df = spark.createDataFrame(rows, "id long, stratum string")
    got = [sorted((r["stratum"], r["sample_rank"], r["id"]) for r in samples.bottom_k(df.repartition(n), 6, "id", ["stratum"]).collect()) for n in (1, 7, 40)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 18
    plain = sorted((r for r in rows if r[0] is not None and r[1] == "s2"), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())
    assert [x[2] for x in got[0] if x[0] == "s2"] == [r[0] for r in plain[:6]]
    plan = samples.bottom_k(df, 6, "id", ["stratum"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan[plan.index("Exchange") :]  # each task keeps its least ones before the shuffle
    assert samples.bottom_k(df.limit(0), 6, "id").count() == 0


def test_report_on_covered_records(spark):
    left, right = (spark.createDataFrame([(i, f"t{i}") for i in range(n)], "id long, title string") for n in (8, 5))
    links = spark.createDataFrame([(0, 0, 1.0), (1, 1, 0.99)], "left_id long, right_id long, score double")
    r = link.match_report(left, right, links, spark.createDataFrame([(0,), (1,), (1,), (2,)], "left_id long")).first()
    assert (r["match_rate"], r["covered"], r["coverage"], r["covered_rate"], r["ready"]) == (25.0, 3, 37.5, 66.67, False)
    none = link.match_report(left.limit(0), right, links.limit(0), links.limit(0).select("left_id")).first()
    assert (none["match_rate"], none["coverage"], none["covered_rate"], none["ready"]) == (0.0, 0.0, 0.0, False)
    kinds = [r["kind"] for r in samples.match_samples(left, right, links, 1, 3, 50).collect()]
    assert {k: kinds.count(k) for k in set(kinds)} == {"matched": 1, "left unmatched": 3, "right unmatched": 3}
