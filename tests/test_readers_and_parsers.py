"""Readers on small files, parsers on small pages, model calls and fuzzy links on small frames."""

import difflib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from folioloom.functions import text
from folioloom.operators import extract, genres, jobs, link, search
from folioloom.plans import queries
from folioloom.sources import readers

DATA = "/root/testdata/sf0.001"


def test_read_records(spark, tmp_path):
    rows = [
        {"source": "a", "external_id": "1", "title": "Книга Дюна 2", "authors": ["Г. Герберт", " "], "rating": 8.5, "vote_count": 3, "normalized_score": 99},
        {"source": "a", "external_id": "2", "title": "Ёлка", "genres": None, "rating_max": 5.0},
    ]
    (tmp_path / "dump.json").write_text(json.dumps(rows, ensure_ascii=False))
    got = readers.read_records(spark, str(tmp_path / "dump.json"), "b").orderBy("external_id").collect()
    assert [(r["source"], r["rating_max"], r["normalized_title"], r["normalized_authors"], r["genres"]) for r in got] == [("b", 10.0, "дюна", ["герберт"], []), ("b", 5.0, "елка", [], [])]
    assert "normalized_score" not in got[0].asDict()


def test_read_keyed(spark, tmp_path):
    (tmp_path / "cache.json").write_text(json.dumps({"7": {"rating": "8.65", "votes": 20, "title": "x"}, "9": {"rating": None}}))
    got = readers.read_keyed(spark, str(tmp_path / "cache.json"), "rating: string, votes: int").orderBy("key").collect()
    assert [tuple(r) for r in got] == [("7", "8.65", 20), ("9", None, None)]


def test_read_pages_and_profiles(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "12.html").write_bytes("<p>Привет</p>".encode() + b"\xff")
    got = readers.read_pages(spark, str(tmp_path / "pages")).first()
    assert got["page_id"] == "12" and got["html"].startswith("<p>Привет</p>") and got["bytes"] == 20
    (tmp_path / "profiles.json").write_text('{"work_id": 1, "pace": 7}\nbroken {\n{"pace": 3}\n{"work_id": 2, "pace": null}\n')
    got = readers.read_profiles(spark, str(tmp_path / "profiles.json"), "work_id long, pace int").orderBy("work_id").collect()
    assert [tuple(r) for r in got] == [(1, 7), (2, None)]


def test_write_report(spark, tmp_path):
    jobs.write_report(spark.createDataFrame([(1, "x")], "n int, s string"), str(tmp_path / "report"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "report")).select("n", "s").collect()] == [(1, "x")]


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id int, html string")


def test_rank_table_and_variants(spark):
    row = '<tr><td>{}.</td><td><a href="/work{}">{}</a></td></tr>'
    table = row.format(2, 20, "B &amp; b") + row.format(1, 10, "A") + row.format(101, 30, "C") + "<!--stop-->" + row.format(3, 40, "D")
    pattern = r'<tr><td>(\d+)\.</td><td><a href="/work(\d+)">(.*?)</a>'
    got = extract.rank_table(pages(spark, table, "<p>none</p>"), pattern, stop="<!--stop-->").orderBy("rank")
    assert [tuple(r) for r in got.collect()] == [(0, 1, "10", "A"), (0, 2, "20", "B & b")]
    other = spark.createDataFrame([(0, 9, "x", "old"), (1, 1, "y", "new")], "page_id int, rank int, external_id string, label string")
    both = extract.first_variant(got, other).orderBy("page_id", "rank").collect()
    assert [(r["page_id"], r["external_id"]) for r in both] == [(0, "10"), (0, "20"), (1, "y")]


def test_search_json(spark):
    body = {"books": [{"id": "1", "title": " A ", "authors": [{"name": "X", "surname": "Y"}]}, {"id": "1", "title": "again"}, {"title": "no id"}, {"id": "2", "title": "B"}]}
    got = extract.search_json(spark.createDataFrame([(0, json.dumps(body)), (1, "{}")], "page_id int, body string")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, "1", "A", ["X Y"]), (0, 2, "2", "B", [])]


def test_genres_and_descriptions_of_pages(spark):
    row = '<tr>Жанр: <a href="/a">Фэнтези</a>, <a href="/b">Фэнтези</a></tr>'
    any_ = '<a href="/genre/1">Ужасы</a><a href="/x">no</a>'
    long = "A first paragraph that is long enough to be taken for the description of a work, of some length indeed."
    html = pages(spark, row, any_, f'<meta name="description" content="{long}"><p>x</p>', f"<p>short</p><p>{long}</p>", "<p>short</p>")
    got = html.select(F.array_join(extract.page_genres(F.col("html")), "|").alias("g"), extract.description(F.col("html")).alias("d")).collect()
    assert [r["g"] for r in got] == ["Фэнтези", "Ужасы", "", "", ""] and [r["d"] for r in got] == [None, None, long, long, None]


def test_reviews_of_pages_and_payloads(spark):
    block = '<div class="review">{}</div>'
    texts = ["A review of thirty characters or so", "short", "A review of thirty characters or so", "Another review, also long enough"]
    got = extract.page_reviews(pages(spark, "".join(map(block.format, texts))), r'(?s)<div class="review">(.*?)</div>').orderBy("seq").collect()
    assert [r["text"] for r in got] == [texts[0], texts[3]]
    body = json.dumps([{"text": texts[0], "author": "a"}, {"message": texts[3]}, {"body": "short"}])
    got = extract.api_reviews(spark.createDataFrame([(0, body)], "page_id int, body string")).orderBy("seq").collect()
    assert [(r["text"], r["author"]) for r in got] == [(texts[0], "a"), (texts[3], None)]


def test_descriptions_of_the_given_pages(spark):
    """The first paragraph from 80 characters, in plain Python, where a page has no meta description."""
    import html as h
    import re

    for r in queries.QUERIES["page_descriptions"](spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet"), "page_id").collect():
        texts = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.findall(r"(?s)<p[^>]*>(.*?)(?=</?p\b|</article|</div)", r["html"])]
        want = next((t for t in texts if len(t) >= 80 and not re.match(r"[A-ZА-ЯЁ]\w{2,20}:", t)), None)
        assert " ".join((r["description"] or "").split()) == (want or "")


def test_stable_ids(spark):
    for r in queries.QUERIES["stable_ids"](spark, DATA).collect():
        assert r["uuid"] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"fl:{r['work_id']}"))


def test_hint_link(spark):
    files = spark.createDataFrame([("f1", "r2", "whatever"), ("f2", "zz", "great the Dune"), ("f3", "zz", "nothing alike")], "name string, prefix string, hint string")
    records = spark.createDataFrame([("r1", "Dune the great"), ("r2", "Other book"), ("r3", "great")], "id string, title string")
    got = {r["name"]: (r["record_id"], round(r["score"], 3)) for r in link.hint_link(files, records).collect()}
    assert got == {"f1": ("r2", 1.0), "f2": ("r1", 1.0)}


def test_long_titles_are_linked_by_ratio(spark):
    a = "the long history of a very small town by the sea and of its people"
    rows = [(0, a), (1, a.replace("small", "smail")), (2, a.replace("small town", "large city")), (3, "short")]
    df = spark.createDataFrame([(i, i, t, ["Some Author"]) for i, t in rows], "id int, pos int, title string, authors array<string>")
    got = link.candidates(df.filter("id = 0"), df.filter("id > 0")).collect()
    want = difflib.SequenceMatcher(None, rows[0][1], rows[1][1]).ratio()
    assert [(r["left_id"], r["right_id"]) for r in got] == [(0, 1)] and got[0]["score"] == pytest.approx(want, abs=0.01)


def test_genre_search_orders_by_relevance(spark):
    """Items of a genre query are those of the genre, by relevance, rating and position, in plain Python."""
    items = queries.QUERIES["search_genre_items"](spark, DATA)
    by_query: dict = {}
    for r in items.collect():
        by_query.setdefault(r["query_id"], []).append(r)
    assert by_query
    for found in by_query.values():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1)) and found[0]["total"] >= len(found)
        assert all(a["relevance"] >= b["relevance"] for a, b in zip(found, found[1:]))


def test_genre_scores(spark):
    dim = spark.createDataFrame([("fantasy",), ("dark fantasy",), ("romance",)], "name string")
    wanted = spark.createDataFrame([(1, "Fantasy"), (2, "dark"), (3, "fantazy")], "query_id int, needle string")
    got = {(r["query_id"], r["name"]): r["score"] for r in search.genre_scores(dim, wanted).collect()}
    assert got[1, "fantasy"] == 1.0 and got[1, "dark fantasy"] == 0.88 and got[2, "dark fantasy"] == 0.88
    assert 0.5 <= got[3, "fantasy"] < 0.72 and (2, "romance") not in got


def test_enrich_and_its_failures(spark):
    def answer(prompts):
        if any("fail" in p for p in prompts):
            raise RuntimeError("no model")
        return ['So: ```json\n{"axes": {"pace": 14}, "tropes": ["quest", "Война", "x"], "summary": "s"}\n```' if "good" in p else "no idea" for p in prompts]

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "work_id int, prompt string").coalesce(1)
    got = {r["work_id"]: r for r in jobs.enrich(df, answer).collect()}
    assert (got[1]["status"], got[1]["tropes"], got[1]["axes"]["pace"], got[1]["axes"]["magic"]) == ("ok", ["quest", "war"], 10, 5)
    assert (got[2]["status"], got[2]["detail"], got[2]["axes"]) == ("fail", "no profile in the answer", None)
    one = jobs.enrich(spark.createDataFrame([(3, "fail")], "work_id int, prompt string"), answer).first()
    assert (one["status"], one["detail"]) == ("fail", "no model")


def test_strip_lead(spark):
    tail = "the story goes on for long enough to stand by itself as a text"
    rows = [(f"Dune. {tail}", "Dune"), (f"A head - {tail}", "x"), (f"Short. {tail}", "x"), ("plain", "x")]
    df = spark.createDataFrame(rows, "t string, title string").select(text.strip_lead(F.col("t"), F.col("title")).alias("s"))
    assert [r["s"] for r in df.collect()] == [tail, tail, tail, "plain"]
    assert genres.genre_counts(spark.createDataFrame([(1, ["a"])], "work_id int, genres array<string>")).count() == 0
