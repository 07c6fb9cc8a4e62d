"""The stages one by one, against brute force over their own input, and as a whole."""

from pyspark.sql import functions as F

import corpus_pipeline as c
from folioloom.llm import queries
from folioloom.llm.common import staged

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in c.STAGES:
        before, docs = docs, staged(stage(spark, docs, DATA), "test")
        kept.append((name, before, docs))
        if name != c.STAGES[-1][0]:
            assert docs.columns == columns
    toxic = {r[0] for r in kept[0][1].join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("toxic = 0").select("doc_id").collect()}
    assert len(toxic - {r[0] for r in kept[0][2].select("doc_id").collect()}) <= 3  # clean documents stay
    near = kept[2]
    sets = {}
    for r in near[1].collect():
        w = r["text"].encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    stays = {r["doc_id"] for r in near[2].collect()}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(alike(a, b) for a in stays for b in stays if a < b)
    assert all(any(alike(x, y) for y in sets if y != x) for x in sets.keys() - stays)
    mixed = kept[3][2].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert mixed <= 2 and kept[4][2].filter(F.size("ids") > 0).count() > 0


def test_odd_rows(spark):
    rows = [(1, "same text of six words here", "s", 5, "x"), (1, "same text of six words here", "s", 5, "x"), (2, None, None, None, None), (None, "", "s", 0, ""), (3, "you idiot moron scum", "t", 20, "y"), (None, "no id but some words in it", None, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, row string")
    docs = docs.withColumns({"my col": F.lit(1), "a.b": F.lit("x"), "k": F.lit(None).cast("string"), "sig": F.lit(2), "ids": F.lit("i")})
    for frame in (docs, docs.limit(0)):
        out = frame
        for _, stage in c.STAGES[:-1]:
            out = staged(stage(spark, out, DATA), "odd")
            assert out.columns == docs.columns
        last = staged(c.encode(spark, out, DATA), "odd")
        assert sorted(last.columns) == sorted(docs.columns) and last.count() == out.count()
    kept = c.drop_near_copies(spark, docs, DATA)
    assert kept.filter("doc_id = 1").count() == 1 and kept.count() == len(rows) - 1


def test_run_and_queries(spark):
    assert c.run(spark, DATA).filter("ids is null").count() == 0
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
