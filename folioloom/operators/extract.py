"""From pages to records: one job over a table of pages (page_id, url, html), with rules as patterns.

Fields come from native regular expressions; nothing here parses a page outside of Spark's expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_PAGE, MIN_STRICT = 3000, 1500
BLOCK_MARKERS = ("captcha", "access denied", "ddos-guard", "checking your browser")


def valid_page(html: Column, least: int = MIN_PAGE, markers: tuple[str, ...] = BLOCK_MARKERS, wanted: str | None = None) -> Column:
    """Long enough, without a marker of a blocked page, with the content marker where one is asked for."""
    low = F.lower(html)
    ok = F.length(html) >= least
    for m in markers:
        ok = ok & ~low.contains(m)
    return F.coalesce(ok & low.rlike(wanted) if wanted else ok, F.lit(False))


def valid_download(head: Column, size: Column) -> Column:
    return (size >= 500) & ~F.lower(F.ltrim(head)).rlike(r"^(?:<!doctype html|<html)")


def valid_json(payload: Column, keys: tuple[str, ...], lists: bool = False) -> Column:
    """A JSON object with one of the keys; lists pass where they are asked for."""
    tree = F.from_json(payload, "map<string,string>")
    has = F.exists(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key(tree, k))
    return F.coalesce(has, F.lit(False)) | (F.ltrim(payload).startswith("[") if lists else F.lit(False))


def text_of(html: Column) -> Column:
    """Tags to spaces, the common character references decoded, white space collapsed."""
    x = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for ref, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = F.replace(x, F.lit(ref), F.lit(c))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def number(text: Column) -> Column:
    """A decimal with comma or point; null where it is none."""
    return F.regexp_replace(F.translate(text, ",", "."), r"\s", "").try_cast("double")


def whole_number(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\x{00A0}]", "").try_cast("long")


def year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d\d)\b", 1), F.lit("")).try_cast("int")


def split_label(label: Column) -> tuple[Column, Column]:
    """authors, title of "Author - Title" with any dash; a label without one is the title."""
    parts = F.split(label, " [-–—] ", 2)
    two = F.size(parts) == 2
    return F.when(two, F.array(F.trim(parts[0]))).otherwise(F.array().cast("array<string>")), F.trim(F.when(two, F.get(parts, F.lit(1))).otherwise(label))


@dataclass(frozen=True)
class ItemRules:
    """Patterns with one group each; of several the first that is not empty counts."""

    ext_id: tuple[str, ...] = (r"/([0-9]+)(?:\.html)?(?:\?|$)",)
    title: tuple[str, ...] = (r'(?s)itemprop="name"[^>]*>(.*?)<', r"(?s)<h1[^>]*>(.*?)</h1>", r"(?s)<title>(.*?)</title>")
    authors: str = r'(?s)itemprop="author"[^>]*>(.*?)<'
    rating: tuple[str, ...] = (r'itemprop="ratingValue"[^>]*?(?:content="|>)([0-9.,]+)',)
    votes: tuple[str, ...] = (r'itemprop="ratingCount"[^>]*?(?:content="|>)([0-9 ]+)',)
    genres: str = r'(?s)<a[^>]+href="[^"]*genre[^"]*"[^>]*>(.*?)</a>'
    year: tuple[str, ...] = (r"(?is)(?:год|year)[^0-9]{0,40}((?:19|20)\d\d)",)
    scale: float = 10.0
    of_url: frozenset[str] = field(default_factory=lambda: frozenset({"ext_id"}))


def _first(column: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(column, p, 1), F.lit("")) for p in patterns))


def item_pages(pages: DataFrame, source: str, rules: ItemRules = ItemRules()) -> DataFrame:
    """One record for each detail page: source, external_id, title, authors, rating, rating_max, vote_count, year,
    genres (distinct, at most 15), url. Pages without a title go."""
    h = F.col("html")
    listed = lambda p, n: F.slice(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(h, F.lit(p), F.lit(1)), text_of), lambda x: x != "")), 1, n)
    out = pages.select(
        "page_id", F.lit(source).alias("source"), F.coalesce(*(_first(F.col("url" if "ext_id" in rules.of_url else "html"), rules.ext_id),)).alias("external_id"), text_of(_first(h, rules.title)).alias("title"),
        listed(rules.authors, 20).alias("authors"), number(_first(h, rules.rating)).alias("rating"), F.lit(rules.scale).alias("rating_max"), whole_number(_first(h, rules.votes)).alias("vote_count"),
        year(_first(h, rules.year)).alias("year"), listed(rules.genres, 15).alias("genres"), "url",
    )
    return out.filter(F.coalesce(F.col("title"), F.lit("")) != "")


def list_pages(pages: DataFrame, pattern: str, cap: int = 100) -> DataFrame:
    """page_id, rank, external_id, label of the items of ranking pages. The pattern has an id and a label group;
    an id counts once a page, ranks are places among the items kept, at most cap of them."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("external_id"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("label"))
    items = pages.select("page_id", F.posexplode(found).alias("pos", "item")).select("page_id", "pos", "item.external_id", text_of(F.col("item.label")).alias("label")).filter("label != ''")
    first = Window.partitionBy("page_id", "external_id").orderBy("pos")
    kept = items.withColumn("n", F.row_number().over(first)).filter("n = 1")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= cap).select("page_id", "rank", "external_id", "label")


def rank_table(pages: DataFrame, pattern: str, stop: str | None = None, cap: int = 100) -> DataFrame:
    """page_id, rank, external_id, label of tables whose rows give their rank. The pattern has groups for rank, id
    and label; the page ends at the stop marker; ranks up to cap, sorted by rank and id."""
    html = F.split_part("html", F.lit(stop), F.lit(1)) if stop else F.col("html")
    col = lambda k: F.regexp_extract_all(html, F.lit(pattern), F.lit(k))
    zipped = F.arrays_zip(col(1).alias("r"), col(2).alias("i"), col(3).alias("l"))
    rows = pages.select("page_id", F.explode(zipped).alias("x")).select("page_id", F.col("x.r").try_cast("int").alias("rank"), F.col("x.i").alias("external_id"), text_of(F.col("x.l")).alias("label"))
    w = Window.partitionBy("page_id").orderBy("rank", "external_id")
    return rows.filter(F.col("rank") <= cap).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap).drop("n")


def first_variant(*variants: DataFrame) -> DataFrame:
    """Rows (page_id, ...) of the first layout that yields any for a page."""
    every = None
    for k, df in enumerate(variants):
        one = df.withColumn("variant", F.lit(k))
        every = one if every is None else every.unionByName(one)
    return every.withColumn("least", F.min("variant").over(Window.partitionBy("page_id"))).filter("variant = least").drop("least")


def embedded_json(pages: DataFrame, kinds: tuple[str, ...] = ("Book", "Product")) -> DataFrame:
    """page_id, name, authors, rating, votes of the first JSON-LD object of a kind; authors as object or list."""
    blocks = F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    one = pages.select("page_id", F.posexplode(blocks).alias("pos", "j")).withColumn("kind", F.get_json_object("j", "$.@type")).filter(F.col("kind").isin(*kinds))
    first = Window.partitionBy("page_id").orderBy("pos")
    one = one.withColumn("n", F.row_number().over(first)).filter("n = 1")
    many = F.from_json(F.get_json_object("j", "$.author"), "array<struct<name:string>>")["name"]
    single = F.array(F.get_json_object("j", "$.author.name"))
    authors = F.filter(F.coalesce(F.when(F.get_json_object("j", "$.author").startswith("["), many), single), lambda a: a.isNotNull())
    return one.select("page_id", F.get_json_object("j", "$.name").alias("name"), authors.alias("authors"), number(F.get_json_object("j", "$.aggregateRating.ratingValue")).alias("rating"), whole_number(F.get_json_object("j", "$.aggregateRating.ratingCount")).alias("votes"))


def search_json(payloads: DataFrame) -> DataFrame:
    """payloads(page_id, body) with books[] -> page_id, rank, external_id, title, authors; id and title are needed,
    an id counts once."""
    books = F.from_json("body", "struct<books:array<struct<id:string,title:string,authors:array<struct<name:string,surname:string>>>>>")["books"]
    one = payloads.select("page_id", F.posexplode(books).alias("pos", "b")).filter("b.id is not null and trim(b.title) != ''")
    first = Window.partitionBy("page_id", F.col("b.id")).orderBy("pos")
    one = one.withColumn("n", F.row_number().over(first)).filter("n = 1")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    names = F.transform("b.authors", lambda a: F.trim(F.concat_ws(" ", a["name"], a["surname"])))
    return one.select("page_id", rank.alias("rank"), F.col("b.id").alias("external_id"), F.trim("b.title").alias("title"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"))


def cross_ids(html: Column, pattern: str) -> Column:
    """All distinct ids of a pattern's group, as sorted numbers."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda x: x.cast("long"))))


def page_genres(html: Column, row: str = r"(?s)(?:Жанр|Genre)[^<]*(.*?)</(?:tr|p|div|li)>") -> Column:
    """Links of the genre row, else any genre link; distinct, at most 15."""
    links = lambda h, p: F.array_distinct(F.filter(F.transform(F.regexp_extract_all(h, F.lit(p), F.lit(1)), text_of), lambda x: x != ""))
    own = links(F.regexp_extract(html, row, 1), r"(?s)<a[^>]*>(.*?)</a>")
    return F.slice(F.when(F.size(own) > 0, own).otherwise(links(html, r'(?s)<a[^>]+href="[^"]*genre[^"]*"[^>]*>(.*?)</a>')), 1, 15)


def description(html: Column) -> Column:
    """The meta description from 40 characters, else the first paragraph from 80 that is no label line."""
    meta = text_of(F.regexp_extract(html, r'(?is)<meta[^>]+name="description"[^>]+content="([^"]*)"', 1))
    texts = F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<p[^>]*>(.*?)(?=</?p\b|</article|</div)"), F.lit(1)), text_of)
    good = F.filter(texts, lambda t: (F.length(t) >= 80) & ~t.rlike(r"^\p{Lu}\p{L}{2,20}:"))
    return F.when(F.length(meta) >= 40, meta).otherwise(F.try_element_at(good, F.lit(1)))


def page_reviews(pages: DataFrame, pattern: str, least: int = 25) -> DataFrame:
    """page_id, seq, text of review blocks from a number of characters, each text once (by its first 120)."""
    one = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("seq", "block")).withColumn("text", text_of(F.col("block"))).filter(F.length("text") >= least)
    first = Window.partitionBy("page_id", F.substring("text", 1, 120)).orderBy("seq")
    return one.withColumn("n", F.row_number().over(first)).filter("n = 1").select("page_id", "seq", "text")


def api_reviews(payloads: DataFrame, least: int = 25) -> DataFrame:
    """Reviews of JSON lists: the text is in text, message or body."""
    items = F.from_json("body", "array<struct<text:string,message:string,body:string,author:string>>")
    one = payloads.select("page_id", F.posexplode(items).alias("seq", "r")).withColumn("text", F.trim(F.regexp_replace(F.coalesce("r.text", "r.message", "r.body"), r"\s+", " ")))
    first = Window.partitionBy("page_id", F.substring("text", 1, 120)).orderBy("seq")
    return one.filter(F.length("text") >= least).withColumn("n", F.row_number().over(first)).filter("n = 1").select("page_id", "seq", "text", F.col("r.author").alias("author"))


def refresh(catalog: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A catalog with what its pages say now: new values that are not empty win, new ids come in; and one row of
    counts added, updated, rated. Both have id, title, rating, votes."""
    new = parsed.select(F.col("id"), F.nullif(F.trim("title"), F.lit("")).alias("nt"), F.col("rating").alias("nr"), F.col("votes").alias("nv"), F.lit(True).alias("parsed"))
    both = catalog.withColumn("old", F.lit(True)).join(new, "id", "full")
    out = both.select("id", F.coalesce("nt", "title").alias("title"), F.coalesce("nr", "rating").alias("rating"), F.when(F.col("nr").isNotNull(), F.coalesce("nv", "votes")).otherwise(F.col("votes")).alias("votes"))
    counts = both.agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("old").isNotNull() & F.col("parsed")).alias("updated"), F.count_if(F.col("nr").isNotNull()).alias("rated"))
    return out, counts


def json_in_text(text: Column) -> Column:
    """The first { to the last } of a text, of its fenced block if it has one; null if there is none."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    return F.nullif(F.regexp_extract(F.coalesce(fenced, text), r"(?s)(\{.*\})", 1), F.lit(""))
