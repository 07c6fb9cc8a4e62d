"""Search: a table of queries against the token index, tiers of text scores, genre filters and relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions import fuzzy
from folioloom.functions.text import search_normalize, stem, tokenize
from folioloom.operators import near
from folioloom.operators.catalog import places
from folioloom.operators.staging import written

LEAST_TEXT, LEAST_GENRE = 0.55, 0.5


def query_words(query: Column) -> Column:
    return tokenize(search_normalize(query))


def token_lookup(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, pos of works that hold every word of a query or its stem. queries(query_id, query)."""
    words = queries.select("query_id", F.posexplode(query_words(F.col("query"))).alias("at", "word"))
    keys = words.select("query_id", "at", F.explode(F.array_distinct(F.array("word", stem(F.col("word"))))).alias("token"))
    n = words.groupBy("query_id").agg(F.count_distinct("at").alias("n"))
    found = hits.join(keys, "token").groupBy("query_id", "pos").agg(F.count_distinct("at").alias("hit"))
    return found.join(n, "query_id").filter("hit = n").select("query_id", "pos")


def resolve_genres(genres: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(query_id, needle) to genres(name): equal names, else names where one holds the other, else the single
    closest by partial ratio from .88, the first by name among equals. Pairs come from joins on rare q-grams."""
    g = written(genres.select("name", F.lower("name").alias("low")), "genres")
    w = written(wanted.select("query_id", "needle", F.lower(F.trim("needle")).alias("n")).distinct(), "wanted")
    strings = near.sides(w.select(F.col("n").alias("s")), g.select(F.col("low").alias("s")))
    both = lambda open_, pairs: open_.join(pairs, open_["n"] == pairs["a"]).join(g, F.col("b") == F.col("low"))
    equal = w.join(g, w["n"] == g["low"]).select("query_id", "needle", "name", F.lit(0).alias("tier"))
    rest = w.join(equal.select("query_id", "needle"), ["query_id", "needle"], "left_anti")
    held = written(both(rest, near.contained_pairs(strings)).select("query_id", "needle", "name", F.lit(1).alias("tier")), "held")
    rest = rest.join(held.select("query_id", "needle"), ["query_id", "needle"], "left_anti")
    like = both(rest, near.partial_pairs(strings, 0.88))
    best = like.groupBy("query_id", "needle").agg(F.min(F.struct((-F.col("score")).alias("less"), "name"))["name"].alias("name"))
    return equal.unionByName(held).unionByName(best.select("query_id", "needle", "name", F.lit(2).alias("tier")))


def prepare(works: DataFrame) -> DataFrame:
    """Works with the texts and tokens that scores read."""
    text = {"title_text": F.col("title"), "author_text": F.array_join("authors", " "), "genre_text": F.array_join("genres", " ")}
    blurb = search_normalize(F.col("search_blurb")) if "search_blurb" in works.columns else F.lit("")
    out = works.select("*", *(search_normalize(c).alias(n) for n, c in text.items()))
    out = out.withColumn("full_text", F.concat_ws(" ", "title_text", "author_text", "genre_text", F.coalesce(blurb, F.lit(""))))
    return out.select("*", *(tokenize(F.col(f"{n}_text")).alias(f"{n}_tokens") for n in ("title", "author", "full")))


def _in(word: Column, tokens: Column) -> Column:
    """Whether a word is among tokens: equal, or beyond 3 characters by stem."""
    s = stem(word)
    return F.exists(tokens, lambda t: (t == word) | ((F.length(word) > 3) & ((stem(t) == s) | ((F.length(s) >= 4) & t.startswith(s)))))


def text_score(rows: DataFrame, fuzzy_tail: bool = True) -> DataFrame:
    """rows of `prepare` with a column query -> with text_score. Ratios run only where no tier above them holds."""
    q = search_normalize(F.col("query"))
    rows = rows.withColumn("q", q).withColumn("words", tokenize(F.col("q")))
    words, first = F.col("words"), F.coalesce(F.try_element_at("words", F.lit(1)), F.col("q"))
    all_in = lambda tokens: F.forall(words, lambda w: _in(w, tokens))
    hit = F.size(F.filter(words, lambda w: _in(w, F.col("full_tokens"))))
    many = F.when(F.col("title_text").contains(F.col("q")), 1.0).when(all_in(F.col("title_tokens")), 0.98).when(all_in(F.concat("title_tokens", "author_tokens")), 0.93).when(all_in(F.col("full_tokens")), 0.78).when((hit >= F.size(words) - 1) & (hit >= 2), 0.65 + 0.08 * hit)
    one = F.when(F.col("title_text").contains(F.col("q")), 1.0).when(_in(first, F.col("title_tokens")), 0.92).when(F.col("author_text").contains(F.col("q")) | _in(first, F.col("author_tokens")), 0.9).when(F.col("genre_text").contains(F.col("q")), 0.85).when(F.col("full_text").contains(F.col("q")) | _in(first, F.col("full_tokens")), 0.82)
    rows = rows.withColumn("native", F.when(F.coalesce(F.col("q"), F.lit("")) == "", 1.0).otherwise(F.when(F.size(words) >= 2, many).otherwise(one)))
    if not fuzzy_tail:
        return rows.withColumn("text_score", F.coalesce("native", F.lit(0.0))).drop("native", "q", "words")
    single = F.size(words) < 2
    open_ = lambda c: F.when(F.col("native").isNull(), F.col(c))
    rows = rows.withColumn("t", F.when(single, fuzzy.ratio("q", open_("title_text"))).otherwise(fuzzy.token_sort_ratio("q", open_("title_text")))).withColumn("a", fuzzy.ratio("q", open_("author_text")))
    tail = F.when(single, F.when(F.col("t") >= 0.72, F.col("t") * 0.9).when(F.col("a") >= 0.78, F.col("a") * 0.85).otherwise(0.0)).otherwise(F.when(F.col("t") >= 0.72, F.col("t") * 0.88).otherwise(0.0))
    return rows.withColumn("text_score", F.coalesce("native", tail)).drop("native", "q", "words", "t", "a")


def genre_scores(genres: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, needle, name, score: 1 for equal names, .88 if one holds the other, else .72 of the partial ratio, from
    LEAST_GENRE. Worked out once for each wanted text and each distinct genre, for pairs that share rare q-grams."""
    w = written(wanted.select("query_id", "needle", F.lower(F.trim("needle")).alias("n")).distinct(), "wanted")
    g = written(genres.select("name", F.lower("name").alias("low")), "genres")
    strings = near.sides(w.select(F.col("n").alias("s")), g.select(F.col("low").alias("s")))
    held = near.contained_pairs(strings).select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.88).alias("held"))
    least = (LEAST_GENRE - 0.0005) / 0.72  # scores are rounded to 3 digits before they are compared
    pairs = held.join(near.partial_pairs(strings, least), ["a", "b"], "full")
    score = F.round(F.coalesce("held", 0.72 * F.col("score")), 3)
    pairs = pairs.select("a", "b", score.alias("score")).filter(F.col("score") >= LEAST_GENRE)
    return w.join(pairs, w["n"] == pairs["a"]).join(g, F.col("b") == F.col("low")).select("query_id", "needle", "name", "score")


def relevance(text: Column, genre: Column, rating: Column, has_query: Column) -> Column:
    """0 to 100, one digit."""
    r = F.coalesce(rating, F.lit(0.0)) / 100
    return F.round(100 * F.when(has_query, 0.78 * text + 0.12 * genre + 0.10 * r).otherwise(0.55 * genre + 0.30 * text + 0.15 * r), 1)


def search(works: DataFrame, hits: DataFrame, genre_works: DataFrame, genres: DataFrame, queries: DataFrame, match: str = "any", limit: int = 200, fuzzy_tail: bool = True) -> tuple[DataFrame, DataFrame]:
    """All queries(query_id, query, genres) at once: items (query_id, rank, pos, text_score, relevance, total) and
    filter stats (query_id, needle, name, catalog_count, count, share).

    Works have pos, title, authors, genres, aggregate_rating. A query's candidates hold all of its words and any (or
    all) of its genres; a query with neither takes the top of the catalog. A word or genre without match gives no items.
    """
    q = queries.select("query_id", F.trim(F.coalesce("query", F.lit(""))).alias("query"), F.coalesce("genres", F.array().cast("array<string>")).alias("genres"))
    wanted = q.select("query_id", F.explode("genres").alias("needle"))
    resolved = written(resolve_genres(genres, wanted), "resolved")  # read by four parts below
    by_needle = genre_works.select(F.col("genre").alias("name"), "pos").join(resolved, "name").select("query_id", "needle", "pos").distinct()
    need = q.select("query_id", F.size(F.array_distinct("genres")).alias("needs"))
    with_genre = by_needle.groupBy("query_id", "pos").agg(F.count("*").alias("has")).join(need, "query_id")
    with_genre = with_genre.filter("has >= 1" if match == "any" else "has = needs").select("query_id", "pos")
    has_text, has_genre = F.col("query") != "", F.size("genres") > 0
    texts = token_lookup(hits, q.filter(has_text).select("query_id", "query"))
    only_text = texts.join(q.filter(has_text & ~has_genre).select("query_id"), "query_id")
    both = texts.join(with_genre, ["query_id", "pos"], "left_semi").join(q.filter(has_text & has_genre).select("query_id"), "query_id")
    only_genre = with_genre.join(q.filter(~has_text & has_genre).select("query_id"), "query_id")
    bare = q.filter(~has_text & ~has_genre).select("query_id").join(works.select("pos").orderBy("pos").limit(limit), F.lit(True))
    chosen = only_text.unionByName(both).unionByName(only_genre).unionByName(bare).join(q, "query_id").withColumnRenamed("genres", "filters")
    rows = prepare(works).join(chosen, "pos")
    rows = text_score(rows, fuzzy_tail).filter((F.col("query") == "") | (F.col("text_score") >= LEAST_TEXT))
    per = genre_works.select(F.col("genre").alias("name"), "pos").join(written(genre_scores(genres, wanted), "genre-scores"), "name").groupBy("query_id", "pos", "needle").agg(F.max("score").alias("s")).groupBy("query_id", "pos").agg(F.sum("s").alias("genre_sum"))
    rows = rows.join(per, ["query_id", "pos"], "left")
    part = F.when(F.size("filters") == 0, 1.0).otherwise(F.coalesce("genre_sum", F.lit(0.0)) / F.size("filters"))
    bare_rel = F.round(F.coalesce("aggregate_rating", F.lit(0.0)), 1)
    rel = F.when((F.col("query") == "") & (F.size("filters") == 0), bare_rel).otherwise(relevance(F.col("text_score"), part, F.col("aggregate_rating"), F.col("query") != ""))
    rows = rows.withColumn("relevance", rel).withColumn("text_score", F.round("text_score", 3))
    rating = F.coalesce("aggregate_rating", F.lit(0.0)).desc()
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("query") != "", F.col("text_score")).desc_nulls_last(), F.col("relevance").desc(), rating, "pos")
    ranked = rows.withColumn("rank", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy("query_id")))
    items = ranked.filter(F.col("rank") <= limit).select("query_id", "rank", "pos", "text_score", "relevance", "total")
    in_result = by_needle.join(rows.select("query_id", "pos"), ["query_id", "pos"]).groupBy("query_id", "needle").agg(F.count("*").alias("count"))
    dim = resolved.join(genres.select("name", F.col("count").alias("c")), "name").groupBy("query_id", "needle").agg(F.max("c").alias("catalog_count"))
    totals = rows.groupBy("query_id").agg(F.count("*").alias("total"))
    stats = wanted.distinct().join(dim, ["query_id", "needle"], "left").join(in_result, ["query_id", "needle"], "left").join(totals, "query_id", "left")
    n = F.coalesce("count", F.lit(0))
    return items, stats.select("query_id", "needle", F.coalesce("catalog_count", F.lit(0)).alias("catalog_count"), n.alias("count"), F.coalesce(F.round(F.try_divide(n, F.col("total")), 4), F.lit(0.0)).alias("share"))


def top_works(works: DataFrame, limit: int = 100) -> DataFrame:
    return works.orderBy(F.col("aggregate_rating").desc_nulls_last(), F.lower("title"), "work_id").limit(limit)


def prefer_sources(works: DataFrame, limit: int | None = None) -> DataFrame:
    """Works with a description of 120 characters first, then those with a local text, then the rest; each by score."""
    rank = F.when(F.length(F.coalesce("description", F.lit(""))) >= 120, 0).when(F.col("local_text"), 1).otherwise(2)
    out = works.withColumn("preference", rank).orderBy("preference", F.col("aggregate_rating").desc_nulls_last(), F.lower("title"), "work_id")
    return out.limit(limit) if limit else out


def list_ids(works: DataFrame, limit: int | None = None) -> DataFrame:
    """Ids by falling rating, null last, then title and id."""
    out = works.orderBy(F.col("aggregate_rating").desc_nulls_last(), F.lower("title"), "work_id").select("work_id")
    return out.limit(limit) if limit else out


def expanded_order(works: DataFrame) -> DataFrame:
    """Works with their place in the expanded catalog: rated ones first, of these those with a description of 120
    characters first, then by falling rating, title and id. Places come from ranges that are sorted each by itself."""
    short = F.length(F.coalesce("description", F.lit(""))) < 120
    order = [F.col("aggregate_rating").isNull(), short, F.col("aggregate_rating").desc_nulls_last(), F.lower("title"), F.col("work_id")]
    return places(works, order).withColumnRenamed("pos", "place")


def top_of_genre(works: DataFrame, genre_works: DataFrame, asked: DataFrame, limit: int = 50) -> DataFrame:
    """asked(genre, q) -> genre, q, rank, work_id: the first works in catalog order of a genre whose title holds q."""
    hits = genre_works.join(asked.withColumn("genre_lower", F.lower("genre")).drop("genre"), "genre_lower").select(F.col("genre_lower").alias("genre"), "q", "pos").distinct()
    rows = hits.join(works.select("pos", "work_id", "title"), "pos").filter(F.lower("title").contains(F.lower("q")))
    rank = F.row_number().over(Window.partitionBy("genre", "q").orderBy("pos"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit).select("genre", "q", "rank", "work_id")
