"""Text scalars as column expressions: folding, normal forms of titles and names, tokens, stems, ids, trimming."""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that a title's normal form drops, and series names that it drops at the beginning.
TITLE_STOP_WORDS = ("сборник", "книга", "том", "часть", "комплект", "издание", "роман", "повесть", "рассказ", "иллюстрации", "полное", "собрание", "сочинений", "иллюстр")
SERIES_PREFIXES = ("колесо времени", "властелин колец", "звездные войны", "гарри поттер", "песнь льда и пламени", "марс", "основание", "дюна", "дискордия", "expanse", "the")
#: The class of characters that split search tokens.
TOKEN_SPLIT = r'[\s+.,;:!?\-"«»()\[\]/]+'
#: Characters whose compatibility form differs from themselves stand in these ranges.
_COMPAT = r"[ªº²³¹¼-¾ĲĳĿŀŉſǄ-ǌǱ-ǳʰ-ʸˠ-ˤͺ΄΅ϐ-ϖᴬ-ᵪ  -   ⁰-₟℀-⅏⅐-ↈ①-⓿　ﬀ-ﬆ！-￮]"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """The compatibility composed form; Python sees only texts with a character that has one, or a combining mark."""
    return F.when(text.rlike(_COMPAT) | text.rlike(r"\p{M}"), _nfkc(text)).otherwise(text)


def fold(text: Column, compat: bool = False) -> Column:
    """Lower case, ё as е, anything but letters, digits and _ as one space, trimmed. compat adds the NFKC step."""
    x = F.lower(nfkc(text) if compat else text)
    return F.trim(F.regexp_replace(F.translate(x, "ё", "е"), r"[^\p{L}\p{N}_]+", " "))


def normalize_title(title: Column, compat: bool = False) -> Column:
    """The fold without one leading series name, digit runs and stop words; the fold itself if nothing is left."""
    folded = fold(title, compat)
    body = F.regexp_replace(folded, f"^(?:{'|'.join(SERIES_PREFIXES)}) +", "")
    kept = F.filter(F.split(body, " "), lambda t: ~t.isin(*TITLE_STOP_WORDS) & ~t.rlike(r"^\p{Nd}+$") & (t != ""))
    text = F.array_join(kept, " ")
    return F.when(text == "", folded).otherwise(text)


def normalize_author(author: Column, compat: bool = False) -> Column:
    """The fold without single letters."""
    return F.array_join(F.filter(F.split(fold(author, compat), " "), lambda t: ~t.rlike("^[а-яa-z]$") & (t != "")), " ")


def normalize_authors(authors: Column, compat: bool = False) -> Column:
    """Normal forms of the names that are not blank, distinct and sorted."""
    named = F.filter(authors, lambda a: a.isNotNull() & (F.trim(a) != ""))
    return F.array_sort(F.array_distinct(F.transform(named, lambda a: normalize_author(a, compat))))


def surname(author: Column) -> Column:
    """The last token of more than two characters of a normal form, else all of it."""
    return F.coalesce(F.try_element_at(F.filter(F.split(author, " "), lambda t: F.length(t) > 2), F.lit(-1)), author)


def match_key(title: Column, authors: Column) -> Column:
    """Surname of the first author in sorted order | normal form of the title: equal for likely copies of an item."""
    first = F.try_element_at(normalize_authors(authors), F.lit(1))
    return F.concat_ws("|", F.coalesce(surname(first), F.lit("")), normalize_title(title))


def search_normalize(text: Column, compat: bool = False) -> Column:
    """+ as a space, white space collapsed and trimmed, lower case."""
    x = nfkc(text) if compat else text
    return F.lower(F.trim(F.regexp_replace(F.translate(x, "+", " "), r"\s+", " ")))


def tokenize(text: Column) -> Column:
    """Tokens of two characters or more."""
    return F.filter(F.split(text, TOKEN_SPLIT), lambda t: F.length(t) >= 2)


def stem(token: Column) -> Column:
    """Tokens of 5 or 6 characters lose one at the end, longer ones two."""
    n = F.length(token)
    return F.when(n <= 4, token).when(n <= 6, F.substring(token, F.lit(1), n - 1)).otherwise(F.substring(token, F.lit(1), n - 2))


def index_tokens(text: Column) -> Column:
    """Distinct tokens, each with its stem if that has four characters or more."""
    both = F.flatten(F.transform(tokenize(text), lambda t: F.when(F.length(stem(t)) >= 4, F.array(t, stem(t))).otherwise(F.array(t))))
    return F.array_distinct(both)


def search_blob(title: Column, authors: Column, genres: Column) -> Column:
    """What the token index is built from; descriptions are left out on purpose."""
    return F.concat_ws(" ", title, F.array_join(authors, " "), F.array_join(genres, " "))


def blurb(description: Column) -> Column:
    return F.substring(description, 1, 300)


def stable_id(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The version 5 UUID of a name, in native expressions."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def item_url(base: str, pattern: str, **columns: Column) -> Column:
    """An address from a base and a pattern with {names}; values are percent-encoded."""
    out, rest = [F.lit(base.rstrip("/") + "/")], pattern.lstrip("/")
    for name, value in columns.items():
        before, _, rest = rest.partition("{" + name + "}")
        out += [F.lit(before), F.url_encode(value.cast("string"))]
    return F.concat(*out, F.lit(rest))


def trim_words(text: Column, limit: int = 900) -> Column:
    """White space collapsed; longer texts end at the last space before the limit, with an ellipsis."""
    x = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(x, 1, limit)
    cut = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.when(cut == "", head).otherwise(cut), F.lit("…")))


def strip_lead(text: Column, title: Column) -> Column:
    """A description without the title before it, without a short head before a dash, without a short first sentence."""
    has_title = F.lower(text).startswith(F.lower(title)) & (F.length(title) > 0)
    x = F.when(has_title, F.regexp_replace(F.substring(text, F.length(title) + 1, F.length(text)), r"^[\s.,:;—–-]+", "")).otherwise(text)
    at = F.locate(" - ", F.translate(x, "—–", "--"))
    head, tail = F.trim(F.substring(x, F.lit(1), at - 1)), F.trim(F.substring(x, at + 3, F.length(x)))
    y = F.when((at > 0) & (at < 100) & (F.length(head) < 80) & (F.length(tail) > 40), tail).otherwise(x)
    stop = F.locate(". ", y)
    rest = F.trim(F.substring(y, stop + 2, F.length(y)))
    return F.when((stop > 0) & (stop < 50) & (F.length(rest) > 40), rest).otherwise(y)


def snippets(reviews: Column, n: int = 8, length: int = 280) -> Column:
    """The first n reviews that are not blank, cut to a length."""
    return F.slice(F.transform(F.filter(reviews, lambda r: F.trim(r) != ""), lambda r: F.substring(F.trim(r), 1, length)), 1, n)


def sample_thirds(text: Column, limit: int = 10_000) -> Column:
    """White space collapsed; of longer texts the first, middle and last third of the limit, with marks between."""
    x = F.trim(F.regexp_replace(text, r"\s+", " "))
    third, n = limit // 3, F.length(x)
    middle = F.floor(n / 2).cast("int") - third // 2
    parts = F.concat_ws("\n...\n", F.substring(x, 1, third), F.substring(x, middle + 1, F.lit(third)), F.substring(x, n - third + 1, F.lit(third)))
    return F.when(n <= limit, x).otherwise(parts)
