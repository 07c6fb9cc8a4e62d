"""The attention weights of op4 learn from every word of the training texts."""

import numpy as np
import pyarrow as pa

from folioloom.llm import lm


def test_all_stretches_are_learned_from():
    words, codes, n_words = lm._tokens(pa.array([" ".join(f"w{k % 97}" for k in range(n)) for n in (0, 5, 31, 32, 400)]))
    kept, length, begins, rounds = lm._stretches(words, codes, n_words)
    assert kept.tolist() == codes.tolist() and length.sum() == len(codes)
    assert begins.sum() == 5 and len(rounds) == len(length) and np.all((rounds >= 0) & (rounds < lm.ROUNDS))


def test_windows_are_made_of_some_texts_at_once(monkeypatch):
    monkeypatch.setattr(lm, "SLICE", 40)
    texts = pa.array(["a" * 30, "b" * 30, None, "", "c" * 300, "d", "e" * 39])
    parts = [p.to_pylist() for p in lm._slices(texts)]
    assert sum(parts, []) == texts.to_pylist()
    assert parts == [["a" * 30], ["b" * 30, None, ""], ["c" * 300], ["d", "e" * 39]]
    assert list(lm._slices(texts.slice(7))) == [] and [p.to_pylist() for p in lm._slices(texts.slice(4, 2))] == [["c" * 300], ["d"]]


def test_discard_takes_every_folder_of_a_table(spark):
    from pathlib import Path

    from folioloom.llm.common import discard, staged

    table = staged(spark.range(40).selectExpr("id", "id % 3 AS k"), "cut", by="k")
    files = [Path(f.removeprefix("file://")) for f in table.inputFiles()]
    assert len({f.parent for f in files}) == 3
    discard(table)
    assert not any(f.exists() for f in files)
