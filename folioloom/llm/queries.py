"""The queries op1 to op13: each operator over its whole table, reduced to the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm import ann, html_text, line_dedup, lm, mixing, ngram_join, periodic, quality, spelling, suffix_dedup
from folioloom.llm import syncmers, toxicity, transducer
from folioloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=("doc_id", "source"))
    return out.select("row.doc_id", "size", "source_size", "target", "taken", "row.source", "copies")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "clean", "n_lines", "n_removed").withColumnRenamed("clean", "text")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transducer.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check=True)
    return out.select("row.doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("row.doc_id", toxicity.held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("row.doc_id", quality.held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = syncmers.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_doc_id")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run, and digests of all runs and of the collapsed text, of every document."""
    return periodic.collapsed(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of five letters or more with its near words, form and root."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes under strings of 200 bytes that also stand elsewhere."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_ann_forest, op2_mix_sources, op3_line_dedup, op4_lm_scores, op5_sentencepiece, op6_toxicity, op7_html_main_text, op8_quality, op9_ngram_jaccard, op10_syncmer_fingerprints, op11_periodic_runs, op12_spelling_variants, op13_suffix_dedup)}
#: The mixture in SQL; the other results rest on hashes, models or searches that SQL does not have.
ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, coalesce(1.0::DOUBLE - 0.75::DOUBLE * length(regexp_replace(text, '[\p{L}\x20\x09-\x0D]+', '', 'g')) / greatest(length(text), 1), 1.0) AS w,
 (CAST('0x' || substring(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':7'), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight FROM d GROUP BY source),
 l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
 t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, (max(level) OVER ()) * weight) AS target FROM l),
 e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
 o AS (SELECT d.*, source_size, target, epochs, round(target - epochs * source_size)::BIGINT - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY pow(u, 1.0::DOUBLE / w) DESC, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
 p AS (SELECT *, greatest(0, least(size, room)) AS part FROM o)
 SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + part)::BIGINT AS taken, source, (epochs + CASE WHEN part > 0 AND 2 * part >= size THEN 1 ELSE 0 END)::INTEGER AS copies FROM p""",
}
