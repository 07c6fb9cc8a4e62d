import json
import os

from pyspark.sql import functions as F

from folioloom.sources.profile_index import ProfileIndex


def put(folder, name, at, *lines):
    """A file with a time of its own, in seconds."""
    path = folder / name
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    os.utime(path, (at, at))


def works_of(spark):
    return spark.createDataFrame([(1, ["академия"]), (2, ["роман"])], "work_id long, genres array<string>")


def test_later_builds_parse_changed_files_alone(spark, tmp_path, monkeypatch):
    folder, works, seen = tmp_path / "profiles", works_of(spark), []
    folder.mkdir()
    plain = ProfileIndex._parsed

    def parsed(self, since, files):
        out = plain(self, since, files)
        read = {os.path.basename(f) for f in spark.read.text(self.folder, recursiveFileLookup=True, modifiedAfter=since).inputFiles()}
        seen.append((sorted(os.path.basename(r["file"]) for r in files.collect()), sorted(read)))
        return out

    monkeypatch.setattr(ProfileIndex, "_parsed", parsed)
    index = ProfileIndex(spark, str(folder), str(tmp_path / "index"), keep=2)
    rows = lambda: {r["work_id"]: (r["summary"], r["tropes"], r["badge"]) for r in index.read().collect()}
    assert index.build(works) == 0 and rows() == {}  # an empty folder
    put(folder, "a.json", 1_000, {"work_id": 1, "summary": "a", "tropes": None, "extra": [1]}, "", "{\"work_id\": 5, ", {"summary": "nobody"})
    put(folder, "sub/b.json", 1_100, {"work_id": 2, "summary": "b", "tropes": ["quest"], "badge": "own"}, {"work_id": 3, "pace": "fast"})
    assert index.build(works) == 2
    first = rows()
    assert first[1] == ("a", ["academy"], "Для спокойного вечера") and first[2] == ("b", ["quest"], "own") and set(first) == {1, 2}
    assert sorted((os.path.basename(r["file"]), r["reason"]) for r in index.bad().collect()) == [("a.json", "malformed"), ("a.json", "no id"), ("b.json", "malformed")]
    assert index.build(works) == 0 and len(seen) == 1  # nothing has changed, nothing is parsed
    put(folder, "c.json", 1_200, {"work_id": 2, "summary": "newer", "tropes": []}, {"work_id": 9, "summary": "c"})
    assert index.build(works) == 1 and seen[-1] == (["c.json"], ["c.json"])
    assert rows()[2][0] == "newer" and set(rows()) == {1, 2, 9}
    put(folder, "a.json", 1_300, {"work_id": 1, "summary": "again"})  # replaced: its bad lines no longer count
    assert index.build(works) == 1 and seen[-1] == (["a.json"], ["a.json"])
    assert rows()[1][0] == "again" and [r["reason"] for r in index.bad().collect()] == ["malformed"]
    assert len(index.pointer.read()["rows"]) == 1  # three builds were folded
    os.remove(folder / "c.json")
    assert index.build(works) == 0 and {k: v[0] for k, v in rows().items()} == {1: "again", 2: "b"}
    put(folder, "old.json", 500, {"work_id": 4, "summary": "put there with an old time"})
    assert index.build(works) == 1 and seen[-1][0] == ["old.json"] and rows()[4][0].startswith("put") and len(rows()) == 3


def test_a_killed_build_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    folder, works = tmp_path / "profiles", works_of(spark)
    folder.mkdir()
    put(folder, "a.json", 1_000, {"work_id": 1, "summary": "a"}, {"work_id": 1, "summary": "b"})
    index = ProfileIndex(spark, str(folder), str(tmp_path / "index"))
    index.build(works)
    put(folder, "a.json", 2_000, {"work_id": 1, "summary": "z"})
    with monkeypatch.context() as m:
        m.setattr(index.pointer, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        try:
            index.build(works)
        except RuntimeError:
            pass
    assert [r["summary"] for r in index.read().collect()] == ["a"]  # of two lines the one with the least text
    assert index.build(works) == 1 and [r["summary"] for r in index.read().select(F.col("summary")).collect()] == ["z"]
