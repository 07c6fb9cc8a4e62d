"""op2, op3, op10 on small tables, against plain Python."""

import collections
import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from folioloom.llm import line_dedup, mixing, syncmers

DOCS = "doc_id long, text string, source string, size long, row string, key string, k string, h long"
ODD = [(1, "a b c d e f\nx", "s", 1, "r", "k", "k", 1), (1, "a b c d e f\nx", "s", 1, "r", "k", "k", 1), (2, None, None, 1, None, None, None, None), (None, "", "t", 0, "", "", "", 0), (3, "  \n\n", "t", 0, "", "", "", 0), (4, "w " * 30_000, "s", 0, "", "", "", 0), (None, "a b c d e f\nx", None, 0, "", "", "", 0)]


def test_mix_meets_targets(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rnd.randrange(40))), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").toPandas()
    size = {s: g["size"].sum() for s, g in got.groupby("source", dropna=False)}
    names = sorted((s for s in size if isinstance(s, str))) + [s for s in size if not isinstance(s, str)]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, open_, target = 1.5 * sum(size.values()), set(names), {}
    while True:  # share out, cut at twice the size, again until nothing is cut
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        cut = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not cut:
            break
        target |= {s: 2.0 * size[s] for s in cut}
        open_ -= cut
    target |= {s: weight[s] * level for s in open_}
    for s, g in got.groupby("source", dropna=False):
        t = target[s] if isinstance(s, str) else target[names[-1]]
        assert abs(g["target"].iloc[0] - t) < 1e-6 and abs(g["taken"].sum() - t) <= 1
    assert (got["taken"] <= 2 * got["size"]).all()
    again = mixing.mix(df.repartition(7)).select("row.doc_id", "taken").toPandas()
    assert dict(zip(again["doc_id"], again["taken"])) == dict(zip(got["doc_id"], got["taken"]))


def test_mix_prefers_quality(spark):
    rows = [(i, ("word " if i % 2 else "%%%% ") * 10, "a" if i < 1000 else "b") for i in range(2000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.5).select("row.doc_id", "taken").toPandas()
    assert got[got["doc_id"] % 2 == 1]["taken"].sum() > 1.5 * got[got["doc_id"] % 2 == 0]["taken"].sum()


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, DOCS)
    for f in (mixing.mix, line_dedup.dedup_lines):
        out = f(df)
        assert out.count() == len(ODD) and out.select("row.*").columns == df.columns
        assert f(df.limit(0)).count() == 0
    assert mixing.mixed(df).columns == df.columns
    out = syncmers.edited_fingerprints(df)
    assert out.count() == len(ODD) and syncmers.edited_fingerprints(df.limit(0)).count() == 0
    clean = [(r["doc_id"], r["clean"]) for r in line_dedup.dedup_lines(df).select("row.doc_id", "clean").collect()]
    assert clean.count((1, "a b c d e f\nx")) == 2 and (2, None) in clean and (None, "") in clean


def _runs(texts, least):
    """Plain line dedup: the lines with words of each text, and those of them that lie in a run of equal lines of
    `least` words or more that stands in an earlier text, or earlier in the same one."""
    docs = [[ln for ln in t.split("\n") if ln.split()] for t in texts]
    out = []
    for d, lines in enumerate(docs):
        gone = set()
        for other in docs[: d + 1]:
            for shift in range(1 - len(lines), 0 if other is lines else len(other)):
                run = []
                for i in range(len(lines) + 1):
                    if i < len(lines) and 0 <= i + shift < len(other) and lines[i] == other[i + shift]:
                        run.append(i)
                    else:
                        if sum(len(lines[x].split()) for x in run) >= least:
                            gone.update(run)
                        run = []
        out.append(gone)
    return docs, out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_against_plain_python(spark, seed):
    rnd = random.Random(seed)
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([1, 1, 2, 3, 4, 5, 9, 14]))) for _ in range(25)]
    texts = list(dict.fromkeys("\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 14))) for _ in range(60)))
    copies = [i for i in range(5) if len(texts[i].split()) >= 5]
    df = spark.createDataFrame(list(enumerate(texts)) + [(1000 + i, texts[i]) for i in copies], "doc_id long, text string").repartition(4)
    (docs, may), (_, must) = _runs(texts, 5), _runs(texts, 8)
    left = lambda **how: {r["doc_id"]: [x for x in r["clean"].split("\n") if x] for r in line_dedup.dedup_lines(df, **how).select("row.doc_id", "clean").collect()}
    # a window of one gram, where winnowing keeps all of them: the results are equal
    got = left(min_words=5, guarantee=5)
    assert all(got[i] == [x for j, x in enumerate(docs[i]) if j not in may[i]] for i in range(len(texts)))
    # as shipped: all runs of 8 words go, and nothing that lies in no run of 5
    got = left()
    count = collections.Counter
    for i in range(len(texts)):
        assert not count(got[i]) - count(x for j, x in enumerate(docs[i]) if j not in must[i])
        assert not count(x for j, x in enumerate(docs[i]) if j not in may[i]) - count(got[i])
    assert all(got[1000 + i] == [] for i in copies)


def test_line_dedup_takes_every_earlier_text(spark):
    for s in range(5):
        p = [f"w{s}x{i}" for i in range(8)]
        rows = list(enumerate(["\n".join(p[1:6]), "\n".join(p), "\n".join(p) + "\nown"]))
        got = {r["doc_id"]: r["clean"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "clean").collect()}
        assert got[2] == "own"


def test_line_dedup_of_equal_lines(spark):
    rows = [(0, "some equal line of words\n" * 8000 + "end"), (1, "\n".join(["w"] * 8000)), (2, "a b c d e\n\nf\n\n"), (3, "a b c d e\n\nf\n\ng")]
    began = time.time()
    got = {r["doc_id"]: r["clean"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "clean").collect()}
    assert got == {0: "some equal line of words\nend", 1: "w", 2: rows[2][1], 3: "g"} and time.time() - began < 30


def test_winnowing_guarantee(spark):
    passage = "\n".join(["one two three", "four five six seven", "eight nine ten eleven"])
    rows = [(i, f"start {i} of an own text here\n{passage}\nend {i} of an own text here") for i in range(20)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "clean").collect()
    assert sum("four five" in r["clean"] for r in out) == 1 and all(f"start {r['doc_id']} " in r["clean"] for r in out)


def test_fingerprints(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("aeioußкд") for _ in range(rnd.randrange(1, 7))) for _ in range(300)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 200))) for _ in range(40)]
    texts[7] = texts[3]
    ids = rnd.sample(range(1000), len(texts))
    out = {r["doc_id"]: r for r in syncmers.edited_fingerprints(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    order = sorted(zip(ids, texts))
    for n, (i, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = out[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if len(t) > 300:
            assert 0.6 < r["near_edited"] < 0.9 and r["near_next"] < 0.1 or t == after
    assert out[ids[7]]["fingerprint"] == out[ids[3]]["fingerprint"]


def test_anchors_do_not_depend_on_context(spark):
    inner = " ".join(f"w{i * 7 % 101}" for i in range(60))
    df = spark.createDataFrame([(1, inner), (2, "x y z " + inner + " more"), (3, "other words " * 20)], "id long, t string")
    a = syncmers.with_anchors(df, "t", "anchors").select("id", "anchors")
    m = syncmers.matches(a.filter("id = 1"), a.filter("id > 1")).orderBy(F.col("anchors").desc()).first()
    n = a.filter("id = 1").select(F.size("anchors")).first()[0]
    assert (m["right_id"], m["shift"]) == (2, 3) and m["anchors"] >= n - 5
