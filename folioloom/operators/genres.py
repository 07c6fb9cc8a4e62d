"""Tags: counts, and rules that tell genres from noise. The rules run on distinct names, never on each work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_COUNT = 10
# Fixed values of the rules: words of genre names, names that always pass, names that never do, Latin words that pass.
GENRE_WORDS = "фантастика фэнтези детектив детективы приключения роман повесть рассказ ужасы мистика юмор сатира боевик триллер эротика драма сказка поэзия биография мемуары история легенды предания мифы мифология эпос философия политика публицистика религиозное религия фанфик фанфики экранизации кинороманы современность ироническое мистическая городское космоопера антиутопия утопия космос магия эльфы вампиры оборотни зомби абсурд абсурдизм авторский сборник антология переводы мелодрама мелодрамы новелла новеллы проза litrpg realrpg adult fiction fantasy horror sci-fi sf".split()
ALLOWED = ["young adult", "young-adult", "young-adult fiction", "new adult", "dark fantasy", "science fiction", "space opera", "мистика. готика. ужасы", "русская фантастика", "русское фэнтези", "русская фэнтези", "русской/славянской", "легенды и предания", "мифы. легенды. эпос", "биографии и мемуары", "книга-игра", "книги-игры", "литrpg / литрпg", "litrpg / литрпг", "realrpg / реалрпг", "азиатское фэнтези", "азиатское фэнтези / ориентальное фэнтези"]
BLOCKED = ["япония", "китай", "корея", "индия", "ирландия", "скандинавия", "скандинавской", "америка", "европа", "азия", "москва", "лондон", "марс", "дания", "атлантида", "донбасс", "крым", "санкт-петербург", "star trek", "star wars", "warhammer", "warcraft", "warhammer 40000", "гарри поттер", "ведьмак", "шерлок холмс", "minecraft", "minecraft / майнкрафт", "fortnite", "dishonored", "avengers", "disney", "netflix", "mortal kombat", "s.t.a.l.k.e.r.", "stalker", "k-pop", "fanzon", "red violet", "букток", "booktok", "миры стругацких", "миры будущего", "миры ника перумова", "«зона посещения»", "зона посещения", "лабиринты ехо", "сага о конане", "редакция елены шубиной", "вторая мировая война", "древний китай", "древний египет", "древняя греция", "южная корея", "северная америка", "дальний восток", "ближний восток", "дикий запад", "красная армия", "средневековая европа", "средневековая англия", "викторианская англия", "дореволюционная россия", "россия xix века", "россия начала xx века", "царская россия", "китай, япония", "the new york times", "new york times", "бестселлеры the new york times", "бестселлеры amazon", "miф проза", "миф проза", "серия «академия магии»", "петр первый", "николай второй", "александр первый", "наполеон бонапарт", "эраст фандорin"]
LATIN_WORDS = "sf litrpg realrpg rpg adult young new fiction fantasy horror dark science space opera hard soft love modern middle grade non true crime book game fan fic fanfic lit ya mg na ff sci fi real".split()
PERSON_MARKERS = ["редакция ", " миры ", "имени ", "серия «", "бестселлеры "]
TECHNICAL = r"(?i)^(?:tn_|child_|sf_|det_|inoag|ugryumova|darknet|golem|necro)"


def _any(text: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.instr(text, p) > 0) if parts else F.lit(False)


def is_genre(name: Column, count: Column) -> Column:
    """Whether a tag of so many works is a genre: not an age rating, year, place, franchise, imprint or person."""
    text = F.trim(name)
    folded = F.lower(F.regexp_replace(text, r"\s+", " "))
    allowed = folded.isin(ALLOWED)
    blocked = folded.isin(BLOCKED) | _any(folded, [b for b in BLOCKED if len(b) >= 8])
    pairs = F.regexp_extract_all(text, F.lit(r"[А-ЯЁ][а-яё]{2,}\s+[А-ЯЁ][а-яё]{2,}"), F.lit(0))
    odd_pair = F.exists(pairs, lambda p: ~F.lower(p).isin(ALLOWED) & ~F.forall(F.split(F.lower(p), r"\s+"), lambda w: w.isin(GENRE_WORDS)))
    person = _any(folded, PERSON_MARKERS) | odd_pair | text.rlike(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b")
    latin = F.regexp_extract_all(text, F.lit(r"\b[A-Za-z][A-Za-z.+-]{2,}\b"), F.lit(0))
    proper = F.exists(latin, lambda t: t.rlike("^[A-Z]") & ~F.lower(F.regexp_replace(t, r"^\.+|\.+$", "")).isin(LATIN_WORDS) & ~((F.upper(t) == t) & (F.length(t) <= 4)))
    words = F.filter(F.split(text, r"[\s/|]+"), lambda w: (w != "") & ~w.rlike(r"^\p{Nd}+$"))
    caps = F.size(F.filter(words, lambda w: w.rlike("^[А-ЯЁA-Z]")))
    titled = (F.size(words) >= 2) & (caps >= 2) & (caps >= F.size(words) * 0.55) & ~F.exists(words, lambda w: F.lower(w).isin(GENRE_WORDS))
    parts = F.filter(F.split(folded, r"[\s/,.-]+"), lambda w: w != "")
    single = (F.size(parts) == 1) & text.rlike("^[А-ЯЁA-Z]") & ~F.coalesce(F.try_element_at(parts, F.lit(1)).isin(GENRE_WORDS), F.lit(False))
    noise = text.rlike(r"^\d+\+$") | text.rlike(r"(?iu)^(?:\d{1,4}|x{1,2}\s*век)$") | text.rlike(TECHNICAL) | blocked | person | proper | titled | single
    return F.coalesce((text != "") & (count >= MIN_COUNT) & (allowed | ~noise), F.lit(False))


def genre_counts(works: DataFrame, keep_noise: bool = False) -> DataFrame:
    """name, count (works), weight (share of all works, 4 digits) of the tags that pass the rules."""
    counts = works.select("work_id", F.explode(F.array_distinct("genres")).alias("name")).groupBy("name").agg(F.count("*").alias("count"))
    total = works.agg(F.count("*").alias("total"))  # one row
    out = counts.crossJoin(F.broadcast(total)).select("name", "count", F.round(F.col("count") / F.col("total"), 4).alias("weight"))
    return out if keep_noise else out.filter(is_genre(F.col("name"), F.col("count")))


def keep_genres(works: DataFrame, genres: DataFrame) -> DataFrame:
    """Works with only the tags that are genres, in their order."""
    one = works.select("work_id", F.posexplode("genres").alias("at", "name")).join(genres.select("name"), "name", "left_semi")
    kept = one.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("g"))
    return works.join(kept, "work_id", "left").withColumn("genres", F.coalesce(F.col("g.name"), F.array().cast("array<string>"))).drop("g")
