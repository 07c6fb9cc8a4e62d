"""Queries on reports and their samples, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioloom.functions.profile import AXIS_NAMES
from folioloom.operators import link, samples, staging
from folioloom.plans import fixtures as fx
from folioloom.plans.queries import ONE, PAIRS, PROFILES, _sides, query
from folioloom.plans.views import _DERIVED, _VALUES, _VIEW, _bare_profiles
from folioloom.sources.profile_index import ProfileIndex


@query(f"""{ONE}, c AS (SELECT DISTINCT left_id FROM pairs), t AS (SELECT count(*) FILTER (work_id % 2 = 0) AS left_total, count(*) FILTER (work_id % 2 = 1) AS right_total,
 (SELECT count(*) FROM links) AS matched, (SELECT count(*) FROM c) AS covered, (SELECT count(*) FROM c WHERE left_id IN (SELECT left_id FROM links)) AS covered_matched FROM plain)
 SELECT *, left_total - matched AS left_unmatched, right_total - matched AS right_unmatched, coalesce(round(100.0 * matched / nullif(left_total, 0), 2), 0) AS match_rate,
 coalesce(round(100.0 * covered / nullif(left_total, 0), 2), 0) AS coverage, coalesce(round(100.0 * covered_matched / nullif(covered, 0), 2), 0) AS covered_rate,
 coalesce(100.0 * covered_matched / nullif(covered, 0), 0) >= 70 AS ready FROM t""")
def match_report_covered(spark, d):
    left, right = _sides(spark, d)
    pairs = link.classes(left, right)
    return link.match_report(left, right, link.one_to_one(pairs), pairs.covered())


def _sampled(kind: str, rows: str, by: str, k: int) -> str:
    return f"SELECT '{kind}' AS kind, row_number() OVER (ORDER BY md5(CAST({by} AS VARCHAR)), {by}) AS sample_rank, * FROM ({rows}) QUALIFY sample_rank <= {k}"


_TITLE = "(SELECT title FROM plain WHERE work_id = {}) AS {}"
_MATCHED = _sampled("matched", f"SELECT left_id, {_TITLE.format('left_id', 'left_title')}, right_id, {_TITLE.format('right_id', 'right_title')}, 1.0 AS score FROM links", "left_id", 20)
_LEFT = _sampled("left unmatched", "SELECT work_id AS left_id, title AS left_title, NULL AS right_id, NULL AS right_title, NULL AS score FROM plain WHERE work_id % 2 = 0 AND work_id NOT IN (SELECT left_id FROM links)", "left_id", 10)
_RIGHT = _sampled("right unmatched", "SELECT NULL AS left_id, NULL AS left_title, work_id AS right_id, title AS right_title, NULL AS score FROM plain WHERE work_id % 2 = 1 AND work_id NOT IN (SELECT right_id FROM links)", "right_id", 50)


@query(f"""{ONE}, s AS (SELECT * FROM ({_MATCHED}) UNION ALL SELECT * FROM ({_LEFT}) UNION ALL SELECT * FROM ({_RIGHT}))
 SELECT kind, sample_rank, CAST(left_id AS VARCHAR) AS left_id, left_title, CAST(right_id AS VARCHAR) AS right_id, right_title, CAST(score AS DOUBLE) AS score FROM s""")
def match_samples(spark, d):
    left, right = _sides(spark, d)
    out = samples.match_samples(left, right, link.one_to_one(link.classes(left, right)))
    return out.withColumns({"sample_rank": F.col("sample_rank").cast("long"), "left_id": F.col("left_id").cast("string"), "right_id": F.col("right_id").cast("string")})


_HIGH = " UNION ALL ".join(f"SELECT '{a}' AS axis, work_id, {a} AS value, top FROM p WHERE {a} >= 8" for a in AXIS_NAMES)


@query(f"""WITH {PROFILES}, p AS (SELECT *, array_to_string(list_transform(list_sort({_VALUES})[1:7], lambda s: s.a || ' ' || (-s.v)), '|') AS top FROM profiles), h AS ({_HIGH})
 SELECT axis, sample_rank, work_id, value, top FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY md5(CAST(work_id AS VARCHAR)), work_id) AS sample_rank FROM h) WHERE sample_rank <= 5""")
def axis_samples(spark, d):
    # written, as a profile index is: 22 computed axes in each of 22 strata make too large an expression
    profiles = staging.written(fx.profiles(spark, d).drop("embedding").withColumn("summary", F.array_join("themes", " ")), "profiles")
    return samples.axis_samples(profiles).withColumn("top", F.array_join("top", "|")).withColumn("sample_rank", F.col("sample_rank").cast("long"))


# Saved files named after works: each part gives one. Its prefix is the id of a record (odd parts, every third), else its
# part number as a place; the hint is the title with its words turned round and a letter that no title has behind them (of
# odd parts but every fifth, whose titles are records'). A title that lacks only that letter is the best that such a hint can have.
@query(f"""{PAIRS}, r AS (SELECT work_id, ts FROM n WHERE work_id % 2 = 1), t AS (SELECT ts, length(array_to_string(ts, ' ')) AS len, min(work_id) AS record_id FROM r GROUP BY ts),
 f AS (SELECT work_id AS name, work_id % 2 = 1 AND work_id % 3 = 0 AS known, work_id % 2 = 1 AND work_id % 5 <> 0 AS hinted, ts FROM n)
 SELECT name, CASE WHEN known THEN name WHEN hinted THEN t.record_id ELSE 2 * name + 1 END AS record_id,
 CASE WHEN known THEN 1.0 WHEN hinted THEN round(2.0 * len / (2 * len + 1), 6) END AS score,
 CASE WHEN known THEN 'id' WHEN hinted THEN 'hint' ELSE 'place' END AS "by" FROM f LEFT JOIN t USING (ts)
 WHERE known OR hinted OR 2 * name + 1 IN (SELECT work_id FROM r)""")
def hint_links(spark, d):
    works = fx.plain_works(spark, d)
    _, right = _sides(spark, d)
    known = (F.col("work_id") % 2 == 1) & (F.col("work_id") % 3 == 0)
    turned = F.concat(F.array_join(F.reverse(F.split("title", " ")), " "), F.lit("q"))
    files = works.select(
        F.col("work_id").alias("name"), F.when(known, F.col("work_id").cast("string")).otherwise(F.concat(F.col("work_id").cast("string"), F.lit(" "))).alias("prefix"),
        F.when((F.col("work_id") % 2 == 1) & (F.col("work_id") % 5 != 0), turned).alias("hint"),
    )
    records = right.withColumn("place", (F.col("id") - 1) / 2)
    return link.hint_link(files, records, place="place").withColumn("score", F.round("score", 6))


# Profiles as files in four folders. Of every fiftieth the line breaks off; then the files of the last folder are replaced by
# whole lines with another summary, and the index is built again.
@query(f"""{_VIEW} SELECT work_id, CASE WHEN work_id % 4 = 3 THEN 'new' ELSE 'old' END AS summary, CASE WHEN work_id % 2 = 1 THEN array_to_string(tropes, '|') ELSE {_DERIVED} END AS tropes, CAST(NULL AS VARCHAR) AS reason
 FROM p WHERE work_id % 4 = 3 OR work_id % 50 <> 7 UNION ALL SELECT NULL, NULL, NULL, 'malformed' FROM p WHERE work_id % 4 <> 3 AND work_id % 50 = 7""")
def profile_index(spark, d):
    profiles, works = _bare_profiles(spark, d)
    folder, part = staging.fresh(spark, "profile-files"), F.col("work_id") % 4

    def save(rows, summary, broken, part):
        line = F.to_json(F.struct(*rows.drop("embedding").columns, F.lit(summary).alias("summary")))
        half = F.left(line, F.floor(F.length(line) / 2).cast("int"))
        rows.select(part.alias("part"), F.when(broken, half).otherwise(line).alias("value")).write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(folder)

    index = ProfileIndex(spark, folder, staging.fresh(spark, "profile-index"))
    save(profiles, "old", F.col("work_id") % 50 == 7, part)
    index.build(works)
    save(profiles.filter(part == 3), "new", F.lit(False), part)
    index.build(works)
    rows = index.read().select("work_id", "summary", F.array_join("tropes", "|").alias("tropes"), F.lit(None).cast("string").alias("reason"))
    return rows.unionByName(index.bad().select("reason"), allowMissingColumns=True)
