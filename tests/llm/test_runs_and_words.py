"""op11 and op12 against plain Python."""

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from folioloom.llm import periodic, spelling

ODD_SCHEMA = "doc_id long, text string, k string, word string, n long, period long, runs string"
ODD = [(1, "a b " * 10, "k", "w", 1, 1, "r"), (1, "a b " * 10, "k", "w", 1, 1, "r"), (2, None, None, None, None, None, None), (None, "", "", "", 0, 0, ""), (None, "same same " * 9, "", "", 0, 0, ""), (3, " \n\x0b ", "", "", 0, 0, ""), (4, "w " * 70_000, "", "", 0, 0, "")]


def _runs(w, least=12):
    """All runs (start, length, period) by comparing words at every distance."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        x = 0
        while x < len(w) - q:
            s = x
            while x < len(w) - q and w[x] == w[x + q]:
                x += 1
            n = x - s + q
            if x > s and n >= max(least, 2 * q) and not any(w[s : s + n - d] == w[s + d : s + n] for d in range(1, q)):
                out.append((s, n, q))
            x += x == s
    return sorted(out)


def _text(rnd, most=150):
    n, kinds = rnd.randrange(most), rnd.choice([1, 2, 3, 40])
    w = [str(rnd.randrange(kinds)) for _ in range(n)]
    for _ in range(rnd.randrange(3)):
        if n > 8:
            p, s = rnd.randrange(1, n // 3 + 1), rnd.randrange(n)
            for i in range(s + p, rnd.randrange(s, n)):
                w[i] = w[i - p]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_fragments_are_all_runs(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        texts = [_text(rnd) for _ in range(rnd.randrange(1, 5))]
        ids = [periodic._ids([x.encode() for x in w]) for w in texts]
        for w, found in zip(texts, periodic._fragments(ids), strict=True):
            assert sorted((a, b - a + q, q) for q, a, b in found if b - a + q >= max(12, 2 * q)) == _runs(w)


def _row(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
    runs = _runs(w) if len(w) < 1000 else [(0, len(w), 1)]
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return i, len(runs), s, n, q, n and 1000 * n // q, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for j, x in enumerate(w) if j not in gone))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize("long", [periodic.LONG, 32])
def test_collapsed_documents(spark, long):
    """With long=32 nearly every text is cut into tiles that are solved elsewhere."""
    rnd = random.Random(long)
    rows = [(i, " ".join(_text(rnd))) for i in range(150)] + [(7, "one\x0btwo\tthree x\r\n" * 9), (7, "one\x0btwo\tthree x\r\n" * 9)]
    got = periodic.collapsed(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), long=long).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(_row(*x) for x in rows)


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, ODD_SCHEMA)
    got = periodic.collapsed(df).select(*COLUMNS).collect()
    key = lambda r: [(x is not None, x) for x in r]
    assert sorted(map(tuple, got), key=key) == sorted((_row(r[0], r[1]) for r in ODD), key=key)
    assert periodic.collapsed(df.limit(0)).count() == 0 and spelling.variants(df.limit(0)).count() == 0
    assert {(r["word"], r["n"]) for r in spelling.variants(df.withColumnRenamed("runs", "word2")).collect()} == set()
    docs = spark.createDataFrame([(None, "words words"), (None, "Words words"), (1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r) for r in spelling.variants(docs).collect()] == [("words", 4, 0, None, None, "words")]


def _variants(rows, typo):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % typo == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        out[w] = (n, len(others), form[w], words.get(form[w]))
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


@pytest.mark.parametrize(("seed", "typo"), [(1, 97), (2, 5), (3, 11)])
def test_variants_against_plain_python(spark, seed, typo):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("aabßÀé") for _ in range(rnd.randrange(4, 8))) for _ in range(90)] + ["aaaaaa", "aaaaa", "aaaaaaa", "aaaab", "baaaa"]
    weights = [1 / (1 + k % 30) for k in range(len(base))]
    rows = [(i, "".join(w.upper() if rnd.random() < 0.1 else w + rnd.choice([" ", "-", "1", "\n", "Ω"]) for w in rnd.choices(base, weights, k=40))) for i in range(60)]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), typo=typo).collect()
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == _variants(rows, typo)
    assert len(got) > 40


def test_chains_of_forms(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(100)] + [("x", None)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{i:03d}": "w100" for i in range(100)} and np.all([k != "x" for k in got])
