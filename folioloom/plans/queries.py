"""One query for each group of operators, over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import profile, text
from folioloom.functions.profile import AXIS_NAMES, TROPES
from folioloom.operators import catalog, extract, genres, jobs, link, ratings, reviews, search, similar
from folioloom.plans import fixtures as fx
from folioloom.plans.fixtures import table
from folioloom.streaming import user_ratings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _joined(c: str, sep: str = "|") -> F.Column:
    return F.array_join(c, sep).alias(c)


# Shared parts of the SQL
SCALE = "CASE WHEN source IN ('kubikus', 'bookmix', 'loveread') THEN 5.0 ELSE 10.0 END"
LEAST_VOTES = "CASE source WHEN 'livelib' THEN 5 WHEN 'bookmix' THEN 5 ELSE 10 END"
VALID = f"(rating > 0 AND rating <= {SCALE} AND NOT CASE WHEN {SCALE} <= 5 THEN rating > 4.94 ELSE rating >= 9.95 AND votes < 100 END AND (source = 'loveread' OR votes >= {LEAST_VOTES}))"
WEIGHT = "CASE WHEN source = 'loveread' THEN 1.0 ELSE ln(1 + greatest(votes, 1)) END"
SR = f"""sr AS (SELECT work_id, source, ({SCALE}) * (1 - 6 * l_discount) AS rating, votes FROM (SELECT l_partkey AS work_id, ['fantlab', 'livelib', 'fantasy_worlds', 'kubikus', 'bookmix', 'loveread'][l_linenumber % 6 + 1] AS source, l_discount, CAST(3 * l_quantity AS BIGINT) AS votes,
 row_number() OVER (PARTITION BY l_partkey, l_linenumber % 6 ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_discount) AS n FROM lineitem) WHERE n = 1)"""
AGG = f"{SR}, agg AS (SELECT work_id, sum(CASE WHEN {VALID} THEN ({WEIGHT}) * (rating / ({SCALE}) * 100) END) / sum(CASE WHEN {VALID} THEN {WEIGHT} END) AS aggregate_rating, count(*) FILTER ({VALID}) AS n_valid FROM sr GROUP BY work_id)"
PLAIN = "plain AS (SELECT p_partkey AS work_id, p_name || ' ' || p_type AS title, replace(p_brand, '#', '') AS author, list_distinct(list_concat(string_split(p_name, ' '), [lower(p_type)])) AS genres FROM part)"
WORKS = f"{AGG}, {PLAIN}, works AS (SELECT plain.*, aggregate_rating, row_number() OVER (ORDER BY coalesce(aggregate_rating, 0) DESC, lower(title), work_id) AS pos FROM plain LEFT JOIN agg USING (work_id))"
BY_GENRE = f"{WORKS}, gw AS (SELECT pos, unnest(genres) AS genre FROM works), gc AS (SELECT genre AS name, count(*) AS count FROM gw GROUP BY genre)"
FOLD = "trim(regexp_replace(replace(lower({0}), 'ё', 'е'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
PAIRS = f"""WITH {PLAIN}, n AS (SELECT work_id, author, list_sort(string_split({FOLD.format('title')}, ' ')) AS ts FROM plain), pairs AS (SELECT l.work_id AS left_id, r.work_id AS right_id FROM n l JOIN n r ON l.author = r.author AND l.ts = r.ts WHERE l.work_id % 2 = 0 AND r.work_id % 2 = 1)"""
ONE = f"{PAIRS}, o AS (SELECT work_id, author, ts, row_number() OVER (PARTITION BY author, ts, work_id % 2 ORDER BY work_id) AS k FROM n), links AS (SELECT l.work_id AS left_id, r.work_id AS right_id FROM o l JOIN o r USING (author, ts, k) WHERE l.work_id % 2 = 0 AND r.work_id % 2 = 1)"
KEY = "substring(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 160)"
REVIEWS = f"""r AS (SELECT doc_id % 50 AS work_id, lang AS source, doc_id AS seq, {KEY} AS key FROM documents WHERE length(text) >= 25), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY work_id, key ORDER BY seq) AS n FROM r WHERE key <> '') WHERE n = 1)"""
EVENTS = "ev AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS work_id, CASE WHEN event_type <> 'error' THEN 1 + CAST(floor(value) AS INT) % 10 END AS rating, ts FROM events), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, work_id ORDER BY ts DESC, event_id DESC) AS n, max(rating IS NOT NULL) OVER (PARTITION BY user_id, work_id) AS existed FROM ev) WHERE n = 1)"
_KEYS = "[" + ", ".join(f"'{t}'" for t in TROPES) + "]"
PROFILES = "pr AS (SELECT vec_id AS work_id, label % 5 AS author, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e, label, " + ", ".join(f"CAST(least(10, 1 + floor(abs(CAST(embedding[{k + 1}] AS DOUBLE)) * 40)) AS INT) AS {n}" for k, n in enumerate(AXIS_NAMES)) + f" FROM embeddings), profiles AS (SELECT *, list_filter([{', '.join(f'CASE WHEN {n} >= 8 THEN {chr(39)}{n}{chr(39)} END' for n in AXIS_NAMES)}], lambda x: x IS NOT NULL) AS themes, [{_KEYS}[label + 1], {_KEYS}[label + 2]] AS tropes FROM pr)"


def _axes_sql(mode: str, a: str = "a", b: str = "b") -> str:
    w = similar.weights_of(mode)
    return f"(1.0 - ({' + '.join(f'{x} * abs({a}.{n} - {b}.{n})' for n, x in w.items())}) / 9.0 / {sum(w.values())})"


def _jaccard_sql(c: str) -> str:
    return f"(CASE WHEN len(a.{c}) > 0 AND len(b.{c}) > 0 THEN len(list_intersect(a.{c}, b.{c})) / len(list_distinct(list_concat(a.{c}, b.{c}))) ELSE 0 END)"


def _fast_sql(mode: str) -> str:
    x, y, z = similar.FAST[mode]
    return f"({x} * {_axes_sql(mode)} + {y} * {_jaccard_sql('themes')} + {z} * {_jaccard_sql('tropes')})"


# Ratings
@query(f"WITH {AGG} SELECT work_id, round(aggregate_rating, 4) AS aggregate_rating, n_valid FROM agg")
def aggregate_rating(spark, d):
    out = ratings.aggregate_rating(fx.source_ratings(spark, d))
    return out.withColumn("aggregate_rating", F.round("aggregate_rating", 4))


@query(f"WITH {SR} SELECT work_id, source, round(rating, 4) AS rating, CASE WHEN source <> 'loveread' THEN votes END AS votes FROM sr WHERE {VALID}")
def clean_blocks(spark, d):
    return ratings.clean_blocks(fx.source_ratings(spark, d)).select("work_id", "source", F.round("rating", 4).alias("rating"), "votes")


@query(f"WITH {AGG}, old AS (SELECT work_id, avg(rating / ({SCALE}) * 100) AS o FROM sr GROUP BY work_id) SELECT (SELECT count(*) FROM sr WHERE NOT {VALID}) AS dropped, count(*) FILTER (round(o, 2) IS DISTINCT FROM round(aggregate_rating, 2)) AS changed, count(*) FILTER (aggregate_rating >= 99.5) AS at_ceiling FROM old JOIN agg USING (work_id)")
def scrub_report(spark, d):
    sr = fx.source_ratings(spark, d)
    old = sr.groupBy("work_id").agg(F.avg(ratings.to_percent(F.col("source"), F.col("rating"))).alias("aggregate_rating"))
    return ratings.scrub_ceiling(sr, old)[1]


@query(f"WITH {AGG}, w AS (SELECT p_partkey AS work_id, aggregate_rating AS r, l FROM part LEFT JOIN agg ON work_id = p_partkey LEFT JOIN (SELECT o_custkey AS c, max(o_totalprice) / 10000 AS l FROM orders GROUP BY 1) ON c = p_partkey WHERE true) SELECT work_id, round(coalesce(CASE WHEN work_id % 3 > 0 THEN r END, l), 4) AS rating FROM w")
def fill_rating(spark, d):
    cache = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("work_id")).agg((F.max("o_totalprice") / 10000).cast("string").alias("rating"), F.count("*").alias("votes"))
    w = fx.works(spark, d).select("work_id", F.when(F.col("work_id") % 3 > 0, F.col("aggregate_rating")).alias("rating"), F.lit(None).cast("long").alias("votes"))
    return ratings.fill_rating(w, cache).select("work_id", F.round("rating", 4).alias("rating"))


# Order
@query(f"WITH {WORKS} SELECT work_id, title, round(aggregate_rating, 4) AS aggregate_rating FROM works ORDER BY works.aggregate_rating DESC NULLS LAST, lower(title), work_id LIMIT 100")
def top_works(spark, d):
    return search.top_works(fx.works(spark, d)).select("work_id", "title", F.round("aggregate_rating", 4).alias("aggregate_rating"))


@query("SELECT p_partkey AS work_id, CASE WHEN length(coalesce(text, '')) >= 120 THEN 0 WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS preference FROM part LEFT JOIN documents ON doc_id = p_partkey")
def prefer_sources(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("work_id"), F.col("text").alias("description"))
    w = fx.works(spark, d).join(docs, "work_id", "left").withColumn("local_text", F.col("work_id") % 3 == 0)
    return search.prefer_sources(w).select("work_id", "preference")


@query(f"WITH {WORKS} SELECT work_id, pos FROM works")
def catalog_position(spark, d):
    return catalog.catalog_position(fx.works(spark, d)).select("work_id", F.col("pos").cast("long").alias("pos"))


# Text
_STOPS = ", ".join(f"'{w}'" for w in text.TITLE_STOP_WORDS)


@query(f"WITH f AS (SELECT doc_id, {FOLD.format('text')} AS folded FROM documents), t AS (SELECT *, array_to_string(list_filter(string_split(regexp_replace(folded, '^(?:{'|'.join(text.SERIES_PREFIXES)}) +', ''), ' '), lambda x: x <> '' AND x NOT IN ({_STOPS}) AND NOT regexp_full_match(x, '\\p{{Nd}}+')), ' ') AS kept FROM f) SELECT doc_id, folded, CASE WHEN kept = '' THEN folded ELSE kept END AS normal FROM t")
def normalize_title(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.fold(t).alias("folded"), text.normalize_title(t).alias("normal"))


@query("SELECT p_partkey AS work_id, lower(replace(p_brand, '#', '')) || '|' || lower(p_name || ' ' || p_type) AS match_key FROM part")
def match_key(spark, d):
    return fx.plain_works(spark, d).select("work_id", text.match_key(F.col("title"), F.col("authors")).alias("match_key"))


_TOKENS = "list_filter(string_split_regex(trim(regexp_replace(replace(lower(text), '+', ' '), '\\s+', ' ', 'g')), '[\\s+.,;:!?\\-\"«»()\\[\\]/]+'), lambda x: length(x) >= 2)"
_STEM = "CASE WHEN length({0}) <= 4 THEN {0} WHEN length({0}) <= 6 THEN substring({0}, 1, length({0}) - 1) ELSE substring({0}, 1, length({0}) - 2) END"


@query(f"WITH t AS (SELECT doc_id, {_TOKENS} AS toks FROM documents) SELECT doc_id, len(toks) AS n_tokens, len(list_distinct(list_concat(toks, list_filter(list_transform(toks, lambda x: {_STEM.format('x')}), lambda s: length(s) >= 4)))) AS n_index FROM t")
def tokens_stems(spark, d):
    x = text.search_normalize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(text.tokenize(x)).cast("long").alias("n_tokens"), F.size(text.index_tokens(x)).cast("long").alias("n_index"))


@query("WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents) SELECT doc_id, length(CASE WHEN length(x) <= 10000 THEN x ELSE substring(x, 1, 3333) || chr(10) || '...' || chr(10) || substring(x, length(x) // 2 - 1666 + 1, 3333) || chr(10) || '...' || chr(10) || substring(x, length(x) - 3333 + 1, 3333) END) AS n, md5(CASE WHEN length(x) <= 10000 THEN x ELSE substring(x, 1, 3333) || chr(10) || '...' || chr(10) || substring(x, length(x) // 2 - 1666 + 1, 3333) || chr(10) || '...' || chr(10) || substring(x, length(x) - 3333 + 1, 3333) END) AS digest FROM t")
def text_sample(spark, d):
    x = text.sample_thirds(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(x).cast("long").alias("n"), F.md5(x.cast("binary")).alias("digest"))


@query("WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents), h AS (SELECT *, regexp_extract(substring(x, 1, 900), '(?s)^(.*) ', 1) AS cut FROM t) SELECT doc_id, CASE WHEN length(x) <= 900 THEN x ELSE CASE WHEN cut = '' THEN substring(x, 1, 900) ELSE cut END || '…' END AS short FROM h")
def trim_words(spark, d):
    return table(spark, d, "documents").select("doc_id", text.trim_words(F.col("text")).alias("short"))


@query()
def stable_ids(spark, d):
    return fx.plain_works(spark, d).select("work_id", text.stable_id(F.concat(F.lit("fl:"), F.col("work_id").cast("string"))).alias("uuid"))


# Catalog tables
@query(f"WITH {WORKS}, t AS (SELECT pos, unnest(list_distinct(list_concat(toks, list_filter(list_transform(toks, lambda x: {_STEM.format('x')}), lambda s: length(s) >= 4)))) AS token FROM (SELECT pos, list_filter(string_split(lower(title || ' ' || author || ' ' || array_to_string(genres, ' ')), ' '), lambda x: length(x) >= 2) AS toks FROM works)) SELECT token, count(*) AS works, sum(pos)::BIGINT AS positions FROM t GROUP BY token")
def token_index(spark, d):
    return catalog.token_hits(catalog.catalog_position(fx.works(spark, d))).groupBy("token").agg(F.count("*").alias("works"), F.sum("pos").cast("long").alias("positions"))


@query(f"WITH {BY_GENRE} SELECT name, count, round(count / (SELECT count(*) FROM works), 4) AS weight FROM gc WHERE count >= 10")
def genre_counts(spark, d):
    return genres.genre_counts(fx.plain_works(spark, d))


@query(f"WITH {WORKS}, sizes AS (SELECT 1) SELECT count(*) AS total, count(aggregate_rating) AS rated, 0::BIGINT AS with_download, (SELECT count(*) FROM part JOIN documents ON doc_id = p_partkey WHERE text IS NOT NULL) AS with_description FROM works")
def catalog_report(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("work_id"), F.col("text").alias("description"))
    return catalog.catalog_report(fx.works(spark, d).join(docs, "work_id", "left"))


@query("SELECT p_partkey AS work_id, CASE WHEN lower(p_type) = split_part(p_name, ' ', 1) THEN split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) WHEN split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) THEN lower(p_type) || '|' || split_part(p_name, ' ', 1) ELSE lower(p_type) || '|' || replace(p_name, ' ', '|') END AS genres FROM part WHERE lower(p_type) NOT IN (split_part(p_name, ' ', 2))")
def ordered_union(spark, d):
    p = table(spark, d, "part")
    words = F.split("p_name", " ")
    return p.filter(F.lower("p_type") != words[1]).select(F.col("p_partkey").alias("work_id"), catalog.ordered_union(F.array(F.lower("p_type")), words).alias("genres")).select("work_id", _joined("genres"))


# Search
def _search_tables(spark, d):
    w = catalog.catalog_position(fx.works(spark, d))
    return w, catalog.token_hits(w), catalog.bridge(w, "genres", "genre"), genres.genre_counts(w)


def _name_queries(spark, d, with_genre: bool) -> DataFrame:
    """A query for each distinct name of a part, numbered in order; its genre filter is its second word."""
    names = table(spark, d, "part").select("p_name").distinct()
    number = F.conv(F.substring(F.md5("p_name"), 1, 12), 16, 10).cast("long")
    return names.select(number.alias("query_id"), F.col("p_name").alias("query"), F.when(F.lit(with_genre), F.array(F.split("p_name", " ")[1])).alias("genres"))


_NAMES = "q AS (SELECT DISTINCT p_name, CAST('0x' || substring(md5(p_name), 1, 12) AS BIGINT) AS query_id, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part)"


@query(f"WITH {WORKS}, {_NAMES}, hit AS (SELECT query_id, work_id, aggregate_rating, pos, CASE WHEN contains(lower(title), p_name) THEN 1.0 ELSE 0.98 END AS text_score, round(100 * (0.78 * CASE WHEN contains(lower(title), p_name) THEN 1.0 ELSE 0.98 END + 0.12 + 0.10 * (coalesce(aggregate_rating, 0) / 100)), 1) AS relevance FROM works JOIN q ON list_contains(genres, w1) AND list_contains(genres, w2)) SELECT query_id, rank, pos, text_score, relevance, total FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text_score DESC, relevance DESC, coalesce(aggregate_rating, 0) DESC, pos) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM hit) WHERE rank <= 200")
def search_names(spark, d):
    w, hits, by_genre, dim = _search_tables(spark, d)
    out = search.search(w, hits, by_genre, dim, _name_queries(spark, d, False))[0]
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("pos").cast("long").alias("pos"), "text_score", "relevance", "total")


@query()
def search_genre_items(spark, d):
    w, hits, by_genre, dim = _search_tables(spark, d)
    q = _name_queries(spark, d, True).withColumn("query", F.lit(""))
    return search.search(w, hits, by_genre, dim, q)[0]


@query(f"WITH {BY_GENRE}, {_NAMES}, n AS (SELECT query_id, w2, count(*) AS count FROM q JOIN works ON list_contains(genres, w1) AND list_contains(genres, w2) GROUP BY ALL) SELECT query_id, w2 AS needle, gc.count AS catalog_count, n.count AS count, CASE WHEN n.count > 0 THEN 1.0 END AS share FROM n JOIN gc ON gc.name = w2")
def filter_stats(spark, d):
    w, hits, by_genre, dim = _search_tables(spark, d)
    return search.search(w, hits, by_genre, dim, _name_queries(spark, d, True))[1]


@query(f"WITH {WORKS}, {_NAMES} SELECT query_id, pos FROM q JOIN works ON list_contains(genres, w1) AND list_contains(genres, w2)")
def token_lookup(spark, d):
    w, hits, _, _ = _search_tables(spark, d)
    return search.token_lookup(hits, _name_queries(spark, d, False)).select("query_id", F.col("pos").cast("long").alias("pos"))


def _any_all(spark, d, match):
    w, _, by_genre, _ = _search_tables(spark, d)
    wanted = _name_queries(spark, d, False).select("query_id", F.explode(F.split("query", " ")).alias("genre_lower"))
    return catalog.any_all(by_genre, wanted, match).select("query_id", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {WORKS}, {_NAMES} SELECT query_id, pos FROM q JOIN works ON list_contains(genres, w1) OR list_contains(genres, w2)")
def genres_any(spark, d):
    return _any_all(spark, d, "any")


@query(f"WITH {WORKS}, {_NAMES} SELECT query_id, pos FROM q JOIN works ON list_contains(genres, w1) AND list_contains(genres, w2)")
def genres_all(spark, d):
    return _any_all(spark, d, "all")


@query(f"WITH {BY_GENRE}, g AS (SELECT name FROM gc WHERE count >= 10), w AS (SELECT DISTINCT substring(name, 1, 3) AS needle FROM g UNION SELECT name FROM g), e AS (SELECT needle, name, 0 AS tier FROM w JOIN g ON name = needle), c AS (SELECT needle, name, 1 AS tier FROM w JOIN g ON contains(name, needle) OR contains(needle, name) WHERE needle NOT IN (SELECT needle FROM e)) SELECT * FROM e UNION ALL SELECT * FROM c")
def resolve_genres(spark, d):
    dim = genres.genre_counts(fx.plain_works(spark, d))
    needles = dim.select(F.substring("name", 1, 3).alias("needle")).union(dim.select("name")).distinct().select(F.lit(0).alias("query_id"), "needle")
    return search.resolve_genres(dim, needles).select("needle", "name", "tier")


# Linkage
def _sides(spark, d):
    return fx.records(spark, d, False), fx.records(spark, d, True)


@query(f"{PAIRS} SELECT left_id, right_id, 1.0 AS score FROM pairs")
def link_candidates(spark, d):
    return link.candidates(*_sides(spark, d)).select("left_id", "right_id", "score")


@query(f"{PAIRS} SELECT left_id, min(right_id) AS right_id, 'exact' AS method FROM pairs GROUP BY left_id")
def best_match(spark, d):
    return link.best_match(link.classes(*_sides(spark, d))).select("left_id", "right_id", "method")


@query(f"{ONE} SELECT left_id, right_id FROM links")
def match_one_to_one(spark, d):
    return link.one_to_one(link.classes(*_sides(spark, d))).select("left_id", "right_id")


@query(f"{ONE} SELECT count(*) FILTER (work_id % 2 = 0) AS left_total, count(*) FILTER (work_id % 2 = 1) AS right_total, (SELECT count(*) FROM links) AS matched, round(100.0 * (SELECT count(*) FROM links) / count(*) FILTER (work_id % 2 = 0), 2) AS match_rate FROM plain")
def match_report(spark, d):
    left, right = _sides(spark, d)
    return link.match_report(left, right, link.one_to_one(link.classes(left, right))).select("left_total", "right_total", "matched", "match_rate")


@query(f"{ONE} SELECT work_id AS id, title FROM plain WHERE work_id % 2 = 1 AND work_id NOT IN (SELECT right_id FROM links)")
def leftovers(spark, d):
    left, right = _sides(spark, d)
    return catalog.leftovers(right, link.one_to_one(link.classes(left, right)), "kubikus").select("id", "title")


@query(f"{ONE} SELECT 'merged' AS origin, count(*) AS works FROM plain WHERE work_id % 2 = 0 UNION ALL SELECT 'kubikus', count(*) FROM plain WHERE work_id % 2 = 1 AND work_id NOT IN (SELECT right_id FROM links)")
def union_catalog(spark, d):
    left, right = _sides(spark, d)
    rest = catalog.leftovers(right, link.one_to_one(link.classes(left, right)), "kubikus")
    both = catalog.union_catalogs(left.withColumn("source_origin", F.lit("merged")), rest)
    return both.groupBy(F.col("source_origin").alias("origin")).agg(F.count("*").alias("works"))


_LINKS = f"{PAIRS}, l AS (SELECT work_id, work_id + 1 AS target_id FROM plain WHERE work_id % 2 = 0), audit AS (SELECT l.work_id, target_id, CASE WHEN t.work_id IS NULL THEN 'missing' WHEN NOT (a.author = t.author AND a.ts = t.ts) THEN 'mismatch' END AS reason FROM l JOIN n a ON a.work_id = l.work_id LEFT JOIN n t ON t.work_id = target_id)"


def _bad_links(spark, d):
    w, t = fx.plain_works(spark, d), fx.records(spark, d, True)
    links = w.filter(F.col("work_id") % 2 == 0).select("work_id", (F.col("work_id") + 1).alias("target_id"))
    return w, link.audit_links(w, t, links)


@query(f"{_LINKS} SELECT work_id, target_id, reason FROM audit WHERE reason IS NOT NULL")
def audit_links(spark, d):
    return _bad_links(spark, d)[1].select("work_id", "target_id", "reason")


@query(f"{_LINKS} SELECT p.work_id, CASE WHEN reason IS NULL AND p.work_id % 2 = 0 THEN p.work_id + 1 END AS link_id FROM plain p LEFT JOIN audit USING (work_id)")
def repair_links(spark, d):
    w, bad = _bad_links(spark, d)
    linked = w.withColumn("link_id", F.when(F.col("work_id") % 2 == 0, F.col("work_id") + 1))
    return link.repair_links(linked, bad, "x").select("work_id", "link_id")


@query()
def link_long_titles(spark, d):
    """Titles of pages, where near-equal ones are linked by ratio; the author is the host."""
    title = extract.text_of(F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1))
    host = F.regexp_extract("url", r"://([^/]+)", 1)
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("page_id").alias("pos"), title.alias("title"), F.array(host).alias("authors"))
    return link.candidates(pages.filter("id % 2 = 0"), pages.filter("id % 2 = 1")).select("left_id", "right_id", F.round("score", 4).alias("score"))


# Reviews
@query(f"WITH {REVIEWS} SELECT work_id, seq FROM one")
def dedupe_reviews(spark, d):
    return reviews.dedupe(fx.reviews(spark, d)).select("work_id", "seq")


@query(f"WITH {REVIEWS} SELECT work_id, rank, seq FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY source <> 'en', seq) AS rank FROM (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY work_id, key ORDER BY source <> 'en', seq) AS n FROM r WHERE key <> '') WHERE n = 1)) WHERE rank <= 15")
def reviews_top15(spark, d):
    r = fx.reviews(spark, d)
    return reviews.attach(r.filter("source = 'en'"), r.filter("source != 'en'")).select("work_id", F.col("rank").cast("long").alias("rank"), "seq")


@query(f"WITH {REVIEWS} SELECT work_id, count(*) AS count, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources_tried, least(15, count(*)) AS kept FROM one GROUP BY work_id")
def review_bundles(spark, d):
    return reviews.bundles(fx.reviews(spark, d)).select("work_id", "count", _joined("sources_tried"), F.size("reviews").cast("long").alias("kept"))


# User ratings
@query(f"WITH {EVENTS} SELECT user_id, work_id, rating, event_id FROM last WHERE rating IS NOT NULL")
def latest_rating(spark, d):
    return user_ratings.current(fx.rating_events(spark, d)).select("user_id", "work_id", "rating", "event_id")


@query(f"WITH {EVENTS} SELECT user_id, work_id, existed FROM last WHERE rating IS NULL")
def deleted_ratings(spark, d):
    return user_ratings.deleted(fx.rating_events(spark, d))


@query(f"WITH {EVENTS} SELECT work_id, count(*) AS count, round(avg(rating), 2) AS average FROM last WHERE rating IS NOT NULL GROUP BY work_id")
def community_stats(spark, d):
    return user_ratings.community_stats(user_ratings.current(fx.rating_events(spark, d)))


# Likeness: every work whose id is divisible by 100 against all, unless a query says more
@query(f"WITH {PLAIN}, s AS (SELECT a.work_id AS base_id, b.work_id, 0.45 * (len(list_intersect(a.genres, b.genres)) / len(list_distinct(list_concat(a.genres, b.genres)))) + 0.35 * CASE WHEN a.author = b.author THEN 1 ELSE 0 END AS score FROM plain a JOIN plain b ON a.work_id <> b.work_id WHERE a.work_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY round(score, 9) DESC, work_id) AS rank FROM s WHERE score >= 0.25) SELECT base_id, rank, work_id, round(score, 4) AS score FROM r WHERE rank <= 12")
def similar_basic(spark, d):
    w = fx.plain_works(spark, d)
    out = similar.similar_basic(w, w.filter("work_id % 100 = 0"), title_part=False)
    return out.select("base_id", F.col("rank").cast("long").alias("rank"), "work_id", F.round("score", 4).alias("score"))


@query()
def similar_basic_titles(spark, d):
    """Every work against all."""
    w = fx.plain_works(spark, d)
    return similar.similar_basic(w, w)


@query("WITH " + PROFILES + ", b AS (SELECT * FROM profiles WHERE work_id % 100 = 0) SELECT b.work_id AS base_id, a.work_id, unnest([" + ", ".join(f"{{'mode': '{m}', 'score': round({_fast_sql(m)}, 4)}}" for m in similar.ALL_MODES) + "], recursive := true) FROM profiles a JOIN b ON a.work_id <> b.work_id")
def profile_scores(spark, d):
    p = fx.profiles(spark, d)
    return similar.pair_scores(p, p.filter("work_id % 100 = 0")).withColumn("score", similar.rounded(F.col("score"), 4))


@query(f"WITH {PROFILES}, b AS (SELECT * FROM profiles WHERE work_id % 100 = 0) SELECT b.work_id AS base_id, a.work_id, round(list_cosine_similarity(a.e, b.e), 4) + 0.0::DOUBLE AS cosine, round(0.45 * list_cosine_similarity(a.e, b.e) + 0.30 * {_jaccard_sql('themes')} + 0.25 * {_axes_sql('ideas')}, 4) AS ideas FROM profiles a JOIN b ON a.work_id <> b.work_id")
def cosine_combined(spark, d):
    p = fx.profiles(spark, d)
    wide = similar.combined_pair_scores(p, p.filter("work_id % 100 = 0"), ("ideas",))
    return wide.select("base_id", "work_id", (F.round("cosine", 4) + F.lit(0.0)).alias("cosine"), F.round("ideas", 4).alias("ideas"))


@query(f"WITH {PROFILES}, b AS (SELECT * FROM profiles WHERE work_id % 100 = 0), s AS (SELECT b.work_id AS base_id, a.work_id, round({_fast_sql('ideas')}, 12) AS score, a.author = b.author AS same FROM profiles a JOIN b ON a.work_id <> b.work_id), l AS (SELECT base_id, work_id, same, CASE WHEN same THEN 0.2 * score ELSE score END AS score, row_number() OVER (PARTITION BY base_id, same ORDER BY score DESC, work_id) AS n FROM s WHERE score > 0.05), r AS (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY same, score DESC, work_id) AS rank FROM l WHERE n <= 36) SELECT base_id, rank, work_id, round(score, 4) AS score FROM r WHERE rank <= 12")
def similar_profiles(spark, d):
    p = fx.profiles(spark, d)
    out = similar.similar_profiles(p, p.filter("work_id % 100 = 0"), "ideas", 12)
    return out.select("base_id", F.col("rank").cast("long").alias("rank"), "work_id", F.round("score", 4).alias("score"))


@query(f"WITH {PROFILES} SELECT work_id, mode, score FROM (SELECT b.work_id, 'ideas' AS mode, round({_fast_sql('ideas')}, 4) AS score, row_number() OVER (PARTITION BY b.work_id ORDER BY {_fast_sql('ideas')} DESC, a.work_id) AS n FROM profiles a JOIN profiles b ON a.work_id <> b.work_id WHERE {_fast_sql('ideas')} > 0.05) WHERE n <= 20")
def neighbors_ideas(spark, d):
    out = similar.neighbors(fx.profiles(spark, d), modes=("ideas",))
    return out.select("work_id", "mode", F.round("score", 4).alias("score"))


_EVERY_MODE = ", ".join(f"{{'mode': '{m}', 'score': round({_fast_sql(m)}, {similar.DIGITS})}}" for m in similar.ALL_MODES)


@query(f"""WITH {PROFILES}, s AS (SELECT b.work_id, a.work_id AS neighbor_id, unnest([{_EVERY_MODE}], recursive := true) FROM profiles a JOIN profiles b ON a.work_id <> b.work_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY work_id, mode ORDER BY score DESC, neighbor_id) AS rank FROM s WHERE score > 0.05)
 SELECT work_id, mode, rank, neighbor_id, round(score, 4) AS score FROM r WHERE rank <= 20""")
def neighbors_top20(spark, d):
    out = similar.neighbors(fx.profiles(spark, d))
    return out.select("work_id", "mode", F.col("rank").cast("long").alias("rank"), "neighbor_id", F.round("score", 4).alias("score"))


# Profiles
_BADGE = "CASE WHEN romance >= 8 AND pace >= 7 THEN 'Горячая романтика' WHEN romance >= 8 THEN 'Романтическая история' WHEN humor >= 8 THEN 'Лёгкое чтение' WHEN action >= 8 AND pace >= 7 THEN 'Динамичный экшен' WHEN thinking >= 8 OR philosophy >= 8 THEN 'Заставляет думать' WHEN darkness >= 8 THEN 'Мрачная атмосфера' WHEN worldbuilding >= 8 OR magic >= 8 THEN 'Богатый мир' WHEN pace <= 4 AND difficulty >= 7 THEN 'Вдумчивое чтение' " + "".join(f"WHEN {n} >= 7 AND {n} = greatest({', '.join(AXIS_NAMES)}) THEN 'Сильная {label.lower()}' " for n, label, _ in profile.AXES) + "ELSE 'Для спокойного вечера' END"


@query(f"WITH {PROFILES} SELECT work_id, {_BADGE} AS badge FROM profiles")
def reader_badge(spark, d):
    return fx.profiles(spark, d).select("work_id", profile.reader_badge(F.lit("")).alias("badge"))


@query(f"WITH {PROFILES} SELECT work_id, array_to_string(list_filter([CASE WHEN survival >= 8 AND world_exploration >= 7 THEN 'robinsonade' END, CASE WHEN (survival >= 8 AND world_exploration >= 7) THEN 'survival_island' END, CASE WHEN world_exploration >= 8 THEN 'exploration' END, CASE WHEN (construction >= 8 OR survival >= 8) AND NOT (survival >= 8 AND world_exploration >= 7) THEN 'survival_island' END, CASE WHEN romance >= 8 AND darkness >= 7 THEN 'tragic_love' END, CASE WHEN romance >= 8 AND humor >= 7 THEN 'enemies_to_lovers' END, CASE WHEN thinking >= 8 AND science >= 7 THEN 'quest' END, CASE WHEN politics >= 8 THEN 'court_intrigue' END, CASE WHEN action >= 8 AND pace >= 8 AND NOT (thinking >= 8 AND science >= 7) THEN 'quest' END], lambda x: x IS NOT NULL)[1:6], '|') AS tropes FROM profiles")
def derive_tropes(spark, d):
    return fx.profiles(spark, d).select("work_id", F.array_join(profile.derive_tropes(F.lit("")), "|").alias("tropes"))


@query("WITH n AS (SELECT doc_id % 50 AS w, count(*) AS n FROM documents WHERE length(text) >= 25 GROUP BY 1) SELECT doc_id, coalesce(length(trim(text)) >= 400 OR length(trim(lang || source || text)) >= 120 AND n >= 1 OR length(trim(lang || source || text)) >= 220 OR n >= 3, false) AS usable FROM documents LEFT JOIN n ON w = doc_id % 1000")
def usable_source(spark, d):
    n = fx.reviews(spark, d).groupBy(F.col("work_id").alias("w")).agg(F.count("*").alias("n"))
    docs = table(spark, d, "documents").join(n, F.col("w") == F.col("doc_id") % 1000, "left")
    return docs.select("doc_id", profile.usable_source(F.concat("lang", "source", "text"), F.coalesce("n", F.lit(0)), F.col("text")).alias("usable"))


@query(f"WITH {PROFILES} SELECT theme, count(*) AS count FROM (SELECT unnest(themes) AS theme FROM profiles) GROUP BY theme ORDER BY count DESC, theme LIMIT 20")
def top_themes(spark, d):
    return jobs.top_themes(fx.profiles(spark, d))


@query(f"WITH {PROFILES} SELECT count(*) AS profiles, count(*) FILTER (len(themes) > 0) AS with_summary, count(*) AS with_tropes, count(*) AS with_embedding FROM profiles")
def profile_stats(spark, d):
    return jobs.profile_stats(fx.profiles(spark, d).withColumn("summary", F.array_join("themes", " ")))


# Pages
@query("SELECT page_id, length(html) >= 3000 AND NOT regexp_matches(lower(html), 'captcha|access denied|ddos-guard|checking your browser') AS valid FROM pages")
def valid_page(spark, d):
    return table(spark, d, "pages").select("page_id", extract.valid_page(F.col("html")).alias("valid"))


_TEXT = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, nullif(regexp_extract(url, '/([0-9]+)(?:\\.html)?(?:\\?|$)', 1), '') AS external_id, {_TEXT.format(chr(34) + 'h' + chr(34))} AS title FROM (SELECT *, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h FROM pages) WHERE {_TEXT.format('h')} <> ''")
def item_pages(spark, d):
    return extract.item_pages(table(spark, d, "pages"), "pages").select("page_id", "external_id", "title")


_LINK = r'<li><a href="([^"]*)">([^<]*)</a>'


@query(f"WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS i, unnest(regexp_extract_all(html, '{_LINK}', 2)) AS l, generate_subscripts(regexp_extract_all(html, '{_LINK}', 1), 1) AS pos FROM pages), f AS (SELECT page_id, i, {_TEXT.format('l')} AS label, pos, row_number() OVER (PARTITION BY page_id, i ORDER BY pos) AS n FROM l WHERE {_TEXT.format('l')} <> '') SELECT page_id, rank, i AS external_id, label FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM f WHERE n = 1) WHERE rank <= 100")
def page_links(spark, d):
    return extract.list_pages(table(spark, d, "pages"), _LINK).select("page_id", F.col("rank").cast("long").alias("rank"), "external_id", "label")


@query()
def page_descriptions(spark, d):
    return table(spark, d, "pages").select("page_id", extract.description(F.col("html")).alias("description"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_in_text(spark, d):
    answer = F.concat(F.lit("Here you are:\n"), "props", F.lit("\nas asked."))
    return table(spark, d, "events").select("event_id", F.get_json_object(extract.json_in_text(answer), "$.k").cast("long").alias("k"))


# Work lists
_PROGRESS = "CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'fail: open' ELSE 'skip: short' END"


def _progress(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "fail: open").otherwise("skip: short")
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderkey").alias("seq"), "o_custkey")


@query("SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def pending(spark, d):
    done = _progress(spark, d).select(F.col("o_custkey").alias("id"), "status")
    return jobs.pending(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), done, failed_too=True)


@query("SELECT c_custkey AS id FROM customer UNION SELECT o_custkey FROM orders UNION SELECT s_suppkey FROM supplier")
def collect_ids(spark, d):
    t = lambda n, c: table(spark, d, n).select(F.col(c).alias("id"))
    return jobs.collect_ids(t("customer", "c_custkey"), t("orders", "o_custkey"), t("supplier", "s_suppkey"))


@query("WITH m AS (SELECT c_custkey AS id, c_mktsegment AS l FROM customer UNION ALL SELECT o_custkey, o_orderpriority FROM orders) SELECT id, array_to_string(list_sort(list(DISTINCT l)), '|') AS lists FROM m GROUP BY id")
def merge_lists(spark, d):
    none = F.lit(None).cast("double").alias("rating")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("list_name"), F.lit(0).alias("seq"), none)
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("list_name"), F.lit(1).alias("seq"), none)
    return jobs.merge_lists(c.unionByName(o)).select("id", _joined("lists"))


@query("SELECT o_custkey AS id, o_orderkey AS seq FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderkey) AS n FROM orders) WHERE n = 1")
def first_seen(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), "o_orderstatus")
    return jobs.first_seen(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus != 'F'")).select("id", "seq")


@query(f"WITH s AS (SELECT {_PROGRESS} AS s FROM orders) SELECT count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s LIKE 'fail%') AS failed, count(*) FILTER (s LIKE 'skip%') AS skipped, 0::BIGINT AS remaining, 100.0 AS percent FROM s")
def progress_status(spark, d):
    p = _progress(spark, d)
    return jobs.progress_status(p, p.select("id"))
