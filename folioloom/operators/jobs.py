"""Job steps around the catalog: work lists, list membership, progress, reports, profiles and views of a work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions import profile
from folioloom.operators.extract import json_in_text


def pending(ids: DataFrame, done: DataFrame, failed_too: bool = False, limit: int | None = None) -> DataFrame:
    """Ids without a finished row in done(id, status), in order; failed and skipped ones count as finished or not."""
    finished = done.filter((F.col("status") == "ok") | (F.lit(not failed_too) & F.col("status").rlike("^(?:fail|skip)")))
    out = ids.select("id").distinct().join(finished.select("id"), "id", "left_anti").orderBy("id")
    return out.limit(limit) if limit else out


def collect_ids(*inputs: DataFrame) -> DataFrame:
    """The distinct ids of several inputs in numeric order."""
    out = inputs[0].select("id")
    for df in inputs[1:]:
        out = out.unionByName(df.select("id"))
    return out.filter("id is not null").distinct().orderBy(F.col("id").cast("long"))


def reparse_lists(*lists: DataFrame) -> DataFrame:
    """Several ranking lists, one after the other; the first occurrence of an id counts."""
    every = None
    for k, df in enumerate(lists):
        one = df.withColumn("list_order", F.lit(k))
        every = one if every is None else every.unionByName(one)
    w = Window.partitionBy("id").orderBy("list_order", "rank")
    return every.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def overlay(index: DataFrame, details: DataFrame, key: str = "id") -> DataFrame:
    """Index rows with the fields of detail rows where these are not null."""
    d = details.select(key, *(F.col(c).alias(f"_{c}") for c in details.columns if c != key))
    both = index.join(d, key, "left")
    new = [c for c in details.columns if c != key and c not in index.columns]
    return both.select(key, *(F.coalesce(f"_{c}", c).alias(c) if c in details.columns else F.col(c) for c in index.columns if c != key), *(F.col(f"_{c}").alias(c) for c in new))


def merge_lists(rows: DataFrame, ceiling: float = 4.95) -> DataFrame:
    """rows(id, list_name, seq, rating) -> id, lists (sorted names), rating: the last one that is not null and below
    the ceiling."""
    rating = F.when(F.col("rating") < ceiling, F.col("rating"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_set("list_name")).alias("lists"), F.max_by("rating", F.when(rating.isNotNull(), F.col("seq"))).alias("rating"))


def first_seen(*crawls: DataFrame) -> DataFrame:
    """Rows appended only while their id is new: first by input, then by seq."""
    every = None
    for k, df in enumerate(crawls):
        one = df.withColumn("_k", F.lit(k))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    w = Window.partitionBy("id").orderBy("_k", "seq")
    return every.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_k")


def without_hidden(items: DataFrame, lists: DataFrame) -> DataFrame:
    """items(user_id, work_id, ...) less what the user has hidden. lists(user_id, work_id, kind)."""
    return items.join(lists.filter("kind = 'hidden'"), ["user_id", "work_id"], "left_anti")


def favourites(items: DataFrame, lists: DataFrame) -> DataFrame:
    return items.join(lists.filter("kind = 'favourite'"), ["user_id", "work_id"], "left_semi")


def facet_filter(genres: DataFrame, needle: str) -> DataFrame:
    """Genres whose name holds a text, in either case."""
    return genres.filter(F.lower("name").contains(needle.lower())).orderBy(F.lower("name"), "name")


def list_genres(genres: DataFrame) -> DataFrame:
    return genres.orderBy(F.lower("name"), "name")


def progress_status(progress: DataFrame, total: DataFrame) -> DataFrame:
    """One row: ok, failed, skipped, remaining, percent. progress(id, status), total(id)."""
    of = lambda s: F.count_if(F.split_part("status", F.lit(":"), F.lit(1)) == s)
    one = progress.agg(of("ok").alias("ok"), of("fail").alias("failed"), of("skip").alias("skipped")).crossJoin(total.agg(F.count("*").alias("total")))
    done = F.col("ok") + F.col("failed") + F.col("skipped")
    return one.select("ok", "failed", "skipped", (F.col("total") - done).alias("remaining"), F.round(F.coalesce(F.try_divide(done * 100.0, F.col("total")), F.lit(0.0)), 2).alias("percent"))


def last_failures(progress: DataFrame, n: int = 5) -> DataFrame:
    return progress.filter(F.col("status").startswith("fail")).orderBy(F.col("seq").desc()).limit(n)


def profile_stats(profiles: DataFrame) -> DataFrame:
    """One row of counts: profiles, with summary, with tropes, with embedding."""
    return profiles.agg(F.count("*").alias("profiles"), F.count_if(F.coalesce("summary", F.lit("")) != "").alias("with_summary"), F.count_if(F.size("tropes") > 0).alias("with_tropes"), F.count_if(F.col("embedding").isNotNull()).alias("with_embedding"))


def top_themes(profiles: DataFrame, n: int = 20) -> DataFrame:
    return profiles.select(F.explode(F.array_distinct(F.transform("themes", lambda t: F.lower(F.trim(t))))).alias("theme")).groupBy("theme").agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "theme").limit(n)


def top_axes(n: int = 7) -> Column:
    """The names of a profile's highest axes with their values, in order."""
    ranked = F.array_sort(F.array(*(F.struct((-F.col(a)).alias("v"), F.lit(k).alias("k"), F.lit(a).alias("a")) for k, a in enumerate(profile.AXIS_NAMES))))
    return F.transform(F.slice(ranked, 1, n), lambda s: F.concat_ws(" ", s["a"], (-s["v"]).cast("string")))


def axis_filter(profiles: DataFrame, axis: str, least: int = 8) -> DataFrame:
    return profiles.filter((F.col(axis) >= least) & (F.coalesce("summary", F.lit("")) != ""))


def build_queue(works: DataFrame, with_reviews: DataFrame | None = None, local_only: bool = False) -> DataFrame:
    """Works to profile: all, those with reviews, those with a local text, or both."""
    out = works.join(with_reviews, "work_id", "left_semi") if with_reviews is not None else works
    return out.filter("local_text") if local_only else out


def work_detail(works: DataFrame, ids: DataFrame) -> DataFrame:
    return works.join(ids.select("work_id").distinct(), "work_id", "left_semi")


#: Columns of works that a card shows, and the parts into which the works of one value are dealt.
LIGHT, PARTS = ("work_id", "title", "authors", "genres", "year", "aggregate_rating"), 32


def cards(results: DataFrame, works: DataFrame) -> DataFrame:
    """Result rows (base_id, rank, work_id, score) with the light columns of their works."""
    return results.join(works.select(*(c for c in LIGHT if c in works.columns)), "work_id")


def cards_sharing(bases: DataFrame, works: DataFrame, by: str) -> DataFrame:
    """bases(base_id, `by`) with the light columns of all other works that have the same `by`.

    The columns go with the works into the one join that makes the pairs, so pairs are neither shuffled nor joined again. As a
    few values may hold all works, those of one value are dealt to PARTS tasks; each keeps only the value's bases at once.
    """
    slices = max(200, int(works.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = works.select(*(c for c in LIGHT if c in works.columns)).withColumn("part", F.pmod(F.xxhash64("work_id"), F.lit(PARTS)))
    own = bases.select("base_id", by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
    dealt = [df.repartition(slices, by, "part") for df in (rows, own)]  # by a number, so that small tables keep all tasks
    return dealt[0].join(dealt[1].hint("merge"), [by, "part"]).filter("base_id <> work_id").drop("part")


def profile_view(profiles: DataFrame, works: DataFrame) -> DataFrame:
    """Profiles with empty tropes and badges filled by rule from axes and the work's genres, and labels."""
    g = works.select("work_id", F.lower(F.array_join("genres", " ")).alias("genre_text"))
    out = profiles.join(g, "work_id", "left").withColumn("genre_text", F.coalesce("genre_text", F.lit("")))
    out = out.withColumn("tropes", F.when(F.size("tropes") > 0, F.col("tropes")).otherwise(profile.derive_tropes(F.col("genre_text"))))
    badge = F.col("badge") if "badge" in profiles.columns else F.lit(None).cast("string")
    out = out.withColumn("badge", F.coalesce(F.nullif(badge, F.lit("")), profile.reader_badge(F.col("genre_text"))))
    return out.withColumn("trope_labels", profile.trope_labels(F.col("tropes"))).drop("genre_text")


def rating_fallback(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """Catalog rows without a rating take it, and the votes, from their parsed page."""
    p = parsed.select("id", F.col("rating").alias("pr"), F.col("votes").alias("pv"))
    missing = F.col("rating").isNull()
    return rows.join(p, "id", "left").withColumn("votes", F.when(missing, F.coalesce("pv", "votes")).otherwise(F.col("votes"))).withColumn("rating", F.coalesce("rating", "pr")).drop("pr", "pv")


def catalog_summary(works: DataFrame, genres: DataFrame) -> DataFrame:
    return works.agg(F.count("*").alias("works")).crossJoin(genres.agg(F.count("*").alias("genres")))


def usable_links(works: DataFrame, bad: DataFrame) -> DataFrame:
    """Works with a flag whether their linked text may be used."""
    return works.join(bad.select("work_id", F.lit(False).alias("ok")).distinct(), "work_id", "left").withColumn("link_ok", F.coalesce("ok", F.lit(True))).drop("ok")


def needs_backfill() -> Column:
    return F.size(F.coalesce("tropes", F.array().cast("array<string>"))) <= 0


def enrich(prompts: DataFrame, answer: Callable[[list[str]], list[str]]) -> DataFrame:
    """prompts(work_id, prompt) -> work_id, status, detail, axes, tropes, summary. `answer` takes a batch of prompts
    and returns as many texts, each with a JSON object in it; a batch that fails gives rows with status fail."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                texts, error = answer(pdf["prompt"].tolist()), None
            except Exception as e:  # a model's failure is a row, not a lost job
                texts, error = [None] * len(pdf), str(e)[:200]
            yield pd.DataFrame({"work_id": pdf["work_id"], "answer": texts, "error": error})

    raw = prompts.select("work_id", "prompt").mapInPandas(run, f"work_id {prompts.schema['work_id'].dataType.simpleString()}, answer string, error string")
    tree = F.from_json(json_in_text(F.col("answer")), "struct<axes:map<string,string>,tropes:array<string>,summary:string>")
    out = raw.withColumn("p", tree)
    ok = F.col("p").isNotNull() & F.col("p.axes").isNotNull()
    detail = F.coalesce("error", F.when(~ok, F.lit("no profile in the answer")))
    axes = F.map_from_arrays(F.array(*map(F.lit, profile.AXIS_NAMES)), F.array(*(profile.clamp_axis(F.try_element_at("p.axes", F.lit(a))) for a in profile.AXIS_NAMES)))
    return out.select("work_id", F.when(ok, "ok").otherwise("fail").alias("status"), detail.alias("detail"), F.when(ok, axes).alias("axes"), F.when(ok, profile.canonical_tropes(F.coalesce("p.tropes", F.array().cast("array<string>")))).alias("tropes"), F.when(ok, F.col("p.summary")).alias("summary"))


def backfill(profiles: DataFrame, works: DataFrame) -> DataFrame:
    """Profiles without tropes get them by rule; the others stay as they are."""
    return profile_view(profiles.filter(needs_backfill()), works).select(*profiles.columns).unionByName(profiles.filter(~needs_backfill()))


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)
