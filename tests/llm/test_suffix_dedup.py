"""op13 against plain Python: its sort, its anchors and the bytes that go."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.llm import suffix_dedup


def _plain(texts, length):
    """(n_bytes, n_removed, n_spans, digest of the rest) of each text, by counting all strings of `length` bytes."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def _corpus(rnd, n, alphabet, most):
    texts = []
    for _ in range(n):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(most)))
        for _ in range(rnd.randrange(4)):
            if texts and rnd.random() < 0.7:  # a passage of another text, or of this one, perhaps with an edit
                other = rnd.choice([*texts, t])
                a = rnd.randrange(len(other) + 1)
                piece = other[a : a + rnd.randrange(most)]
                if piece and rnd.random() < 0.4:
                    x = rnd.randrange(len(piece))
                    piece = piece[:x] + rnd.choice(alphabet) + piece[x + 1 :]
                at = rnd.randrange(len(t) + 1)
                t = t[:at] + piece + t[at:]
        texts.append(t)
    return texts


@pytest.mark.parametrize("shallow", [8, 16, 40])
def test_deep_shallow_order(shallow):
    rnd = random.Random(shallow)
    for _ in range(60):
        base = [bytes(rnd.choice(b"ab") for _ in range(48)) for _ in range(4)]
        rows = []
        for _ in range(rnd.randrange(1, 150)):
            row = bytearray(rnd.choice(base))
            for _ in range(rnd.randrange(3)):
                row[rnd.randrange(48)] = rnd.choice(b"abc")
            rows.append(bytes(row))
        order = suffix_dedup.deep_shallow_order(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 48), shallow)
        assert sorted(order.tolist()) == list(range(len(rows))) and [rows[i] for i in order] == sorted(rows)


def test_equal_strings_have_equal_anchors(monkeypatch):
    """Every string of `length` bytes has an anchor, at the same place wherever it stands, also in long texts cut in parts."""
    rnd = random.Random(4)
    texts = [x.encode() for x in _corpus(rnd, 30, "abcß ", 300)] + [b"a" * 500]
    for chunk in (1 << 18, 64):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        at = [set() for _ in texts]
        for i, places, _ in suffix_dedup._anchored(texts, 40, 16):
            at[i] |= set(places.tolist())
        first = {}
        for b, own in zip(texts, at, strict=True):
            for i in range(len(b) - 39):
                inside = {p - i for p in own if i <= p <= i + 24}
                assert inside and first.setdefault(b[i : i + 40], inside) & inside


@pytest.mark.parametrize(("seed", "alphabet", "part"), [(1, "ab", 1 << 17), (2, "abcdefgh ", 40), (3, "xyß漢 ", 25), (4, "a", 30), (5, "ab", 300)])
def test_removed_bytes_against_plain_python(spark, seed, alphabet, part):
    """Small alphabets make anchors whose neighbours ahead and back are different texts; small parts cut groups of equal
    grams into many ranges, larger ones leave some whole."""
    rnd = random.Random(seed)
    texts = _corpus(rnd, 120, alphabet, 110)
    texts += [texts[5], texts[6], None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df, length=24, gram=8, part=part).collect()}
    assert [got[i] for i in range(len(texts))] == _plain(texts, 24)


def test_as_shipped(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("etaoin") for _ in range(rnd.randrange(2, 9)))
    words = [word() for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [prose(60) for _ in range(3)] + [prose(20)]
    texts = []
    for i in range(60):
        t = prose(rnd.randrange(250))
        texts.append(t + " " + rnd.choice(passages) + " " + prose(30) if i % 3 else t)
    texts += [texts[1], texts[2].replace("e", "x", 1), texts[4] + "é", "z" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == _plain(texts, 200)


def test_odd_rows(spark):
    long = "some words that go on " * 20
    rows = [(1, long, "k", 1), (1, long, "k", 1), (2, None, None, None), (None, None, "", 0), (None, "short", "", 0), (None, "short", "", 0), (3, "", "", 0), (-(2**63), "other text " * 30, "", 0), (None, "other text " * 30, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string, id long").withColumn("pos", F.lit(1)).withColumn("cuts", F.lit(2))
    got = sorted(((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df).collect()))
    assert got == sorted(_plain([r[1] for r in rows], 200))
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
    assert suffix_dedup.remove_repeats(df.filter("text = 'short'")).filter("n_removed = 0").count() == 2
