"""Feature profiles: 22 axes from 1 to 10 in columns of their own, tropes, badges and the texts made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Axes in their order with label and mode of likeness, and the vocabulary of tropes with labels.
AXES = (
    ("character_growth", "Развитие героя", "gameplay"), ("world_exploration", "Исследование мира", "gameplay"), ("politics", "Политика", "ideas"), ("romance", "Романтика", "emotions"),
    ("humor", "Юмор", "style"), ("action", "Экшен", "dynamics"), ("brutality", "Жестокость", "atmosphere"), ("science", "Наука", "ideas"), ("magic", "Магия", "gameplay"),
    ("survival", "Выживание", "dynamics"), ("construction", "Строительство", "gameplay"), ("thinking", "Заставляет думать", "ideas"), ("philosophy", "Философия", "ideas"),
    ("darkness", "Мрачность", "atmosphere"), ("hope", "Надежда", "emotions"), ("psychology", "Психология", "emotions"), ("worldbuilding", "Проработка мира", "atmosphere"),
    ("realism", "Реализм", "style"), ("pace", "Темп", "dynamics"), ("difficulty", "Сложность языка", "style"), ("dialogues", "Диалоги", "style"), ("plot_twists", "Неожиданные повороты", "dynamics"),
)
AXIS_NAMES = tuple(a[0] for a in AXES)
TROPES = {
    "robinsonade": "Робинзонада", "exploration": "Исследование", "survival_island": "Выживание / изоляция", "academy": "Академия", "revenge": "Месть", "betrayal": "Предательство",
    "second_chance": "Второй шанс", "enemies_to_lovers": "Враги → любовь", "forced_proximity": "Вынужденная близость", "found_family": "Найденная семья", "chosen_one": "Избранный",
    "quest": "Квест / путь", "war": "Война", "court_intrigue": "Придворные интриги", "heist": "Ограбление / афера", "detective": "Расследование", "time_travel": "Путешествие во времени",
    "portal_fantasy": "Попаданец / портал", "litrpg": "ЛитРПГ", "dystopia": "Антиутопия", "postapo": "Постапокалипсис", "space_opera": "Космоопера", "coming_of_age": "Взросление",
    "tragic_love": "Трагическая любовь", "comedy_of_manners": "Комедия положений",
}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def axis_label(key: Column) -> Column:
    return F.coalesce(_lookup(key, {a: label for a, label, _ in AXES}), key)


def axis_mode(key: Column) -> Column:
    return F.coalesce(_lookup(key, {a: mode for a, _, mode in AXES}), F.lit("ideas"))


def trope_labels(tropes: Column) -> Column:
    return F.transform(tropes, lambda t: F.coalesce(_lookup(t, TROPES), t))


def clamp_axis(value: Column) -> Column:
    """An int from 1 to 10; 5 where there is none."""
    return F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(value.try_cast("int"), F.lit(5))))


def axis(name: str) -> Column:
    """The axis with 5 for null and 0, as comparisons take it."""
    return F.coalesce(F.nullif(F.col(name), F.lit(0)), F.lit(5))


def canonical_tropes(tropes: Column) -> Column:
    """Keys of the vocabulary, by key or by label, distinct in order, at most 8."""
    keys = F.transform(tropes, lambda t: F.coalesce(_lookup(F.translate(F.lower(F.trim(t)), " -", "__"), {k: k for k in TROPES}), _lookup(F.lower(F.trim(t)), {v.lower(): k for k, v in TROPES.items()})))
    return F.slice(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())), 1, 8)


def split_tropes(text: Column) -> Column:
    """A list from text with commas or semicolons."""
    return clean_list(F.split(text, "[;,]"))


def clean_list(items: Column) -> Column:
    return F.coalesce(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def overview(text: Column) -> Column:
    """Paragraphs of a text, at most 5."""
    return F.slice(clean_list(F.split(text, r"\n\n")), 1, 5)


def reader_badge(genre_text: Column) -> Column:
    """The first rule that holds of the axes and the lower-cased genres; else the highest axis from 7."""
    a = {n: F.coalesce(F.col(n), F.lit(0)) for n in AXIS_NAMES}
    top = F.array_max(F.array(*(F.struct(a[n].cast("int").alias("v"), F.lit(-k).alias("k"), F.lit(label.lower()).alias("label")) for k, (n, label, _) in enumerate(AXES))))
    rules = (
        ((a["romance"] >= 8) & (a["pace"] >= 7), "Горячая романтика"), (a["romance"] >= 8, "Романтическая история"), (a["humor"] >= 8, "Лёгкое чтение"),
        ((a["action"] >= 8) & (a["pace"] >= 7), "Динамичный экшен"), ((a["thinking"] >= 8) | (a["philosophy"] >= 8), "Заставляет думать"), (a["darkness"] >= 8, "Мрачная атмосфера"),
        ((a["worldbuilding"] >= 8) | (a["magic"] >= 8), "Богатый мир"), (genre_text.contains("любов") | genre_text.contains("роман"), "Для любителей романтики"),
        ((a["pace"] <= 4) & (a["difficulty"] >= 7), "Вдумчивое чтение"),
    )
    out = F.when(rules[0][0], rules[0][1])
    for rule, badge in rules[1:]:
        out = out.when(rule, badge)
    return out.when(top["v"] >= 7, F.concat(F.lit("Сильная "), top["label"])).otherwise("Для спокойного вечера")


def derive_tropes(genre_text: Column) -> Column:
    """Tropes that high axes and the lower-cased genres speak for, distinct in order, at most 6."""
    a = {n: F.coalesce(F.col(n), F.lit(0)) for n in AXIS_NAMES}
    has = lambda *parts: F.greatest(*(genre_text.contains(p).cast("int") for p in (*parts, parts[0]))) == 1
    rules = (
        ((a["survival"] >= 8) & (a["world_exploration"] >= 7), ("robinsonade", "survival_island")), (a["world_exploration"] >= 8, ("exploration",)),
        ((a["construction"] >= 8) | (a["survival"] >= 8), ("survival_island",)), ((a["romance"] >= 8) & (a["darkness"] >= 7), ("tragic_love",)),
        ((a["romance"] >= 8) & (a["humor"] >= 7), ("enemies_to_lovers",)), ((a["thinking"] >= 8) & (a["science"] >= 7), ("quest",)), (a["politics"] >= 8, ("court_intrigue",)),
        ((a["action"] >= 8) & (a["pace"] >= 8), ("quest",)), (has("академи"), ("academy",)), (has("попадан", "литрпг", "rpg"), ("portal_fantasy", "litrpg")),
        (has("детектив"), ("detective",)), (has("антиутоп"), ("dystopia",)), (has("апокалип"), ("postapo",)), (has("космич", "космос"), ("space_opera",)),
    )
    found = F.array(*(F.when(rule, F.lit(t)) for rule, tropes in rules for t in tropes))
    return F.slice(F.array_distinct(F.filter(found, lambda t: t.isNotNull())), 1, 6)


def source_confidence(has_annotation: Column, n_reviews: Column, has_text: Column) -> Column:
    return F.struct(F.when(has_annotation, 0.85).otherwise(0.0).alias("annotation"), F.when(n_reviews > 0, F.least(F.lit(0.9), 0.35 + 0.08 * n_reviews)).otherwise(0.0).alias("reviews"), F.when(has_text, 0.9).otherwise(0.0).alias("text"))


def usable_source(description: Column, n_reviews: Column, sample: Column) -> Column:
    """Whether there is enough to profile a work."""
    d, t = F.length(F.trim(F.coalesce(description, F.lit("")))), F.length(F.trim(F.coalesce(sample, F.lit(""))))
    return (t >= 400) | ((d >= 120) & (n_reviews >= 1)) | (d >= 220) | (n_reviews >= 3)


def author_keys(authors: Column) -> Column:
    """Surnames of normal forms and every token of 5 characters or more."""
    from folioloom.functions.text import surname

    return F.array_distinct(F.concat(F.transform(authors, surname), F.filter(F.flatten(F.transform(authors, lambda a: F.split(a, " "))), lambda t: F.length(t) >= 5)))


def embedding_text(parts: list[Column]) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), "\n")


def profile_prompt(title: Column, authors: Column, genres: Column, description: Column, reviews: Column, sample: Column) -> Column:
    """The text that a profile is asked for with: at most 12 genres, 8 snippets and 8000 characters of sample."""
    none = F.lit("нет")
    listed = lambda c, n, sep: F.coalesce(F.nullif(F.array_join(F.slice(c, 1, n), sep), F.lit("")), none)
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    return F.concat_ws("\n", line("Title", title), line("Authors", listed(authors, 100, ", ")), line("Genres", listed(genres, 12, ", ")), line("Description", F.coalesce(F.nullif(description, F.lit("")), none)), line("Reviews", listed(reviews, 8, " | ")), line("Sample", F.coalesce(F.nullif(F.substring(sample, 1, 8000), F.lit("")), none)))
