import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioloom.operators import progress
from folioloom.operators.staging import Pointer
from folioloom.streaming import user_ratings as u
from folioloom.streaming.folded import FoldedTable

SCHEMA = "event_id long, user_id long, work_id long, rating int, ts timestamp"


@pytest.mark.parametrize(("keep", "forget"), [(16, None), (1, "1 hour")])
def test_stream_gives_the_batch_state(spark, tmp_path, keep, forget):
    """Late events come in later files; with keep=1 every batch is folded into one table."""
    rnd = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [(i, rnd.randrange(4), rnd.randrange(5), rnd.choice([None, *range(1, 11)]), start + timedelta(seconds=rnd.randrange(500))) for i in range(300)]
    events = spark.createDataFrame(rows, SCHEMA)
    for k in range(4):
        spark.createDataFrame(rows[k::4], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "f*"))
    table = u.ratings_table(spark, str(tmp_path / "out"), keep, forget)
    for _ in range(2):  # started again it goes on where it ended, with nothing to do
        u.live_community(stream, table, str(tmp_path / "cp")).awaitTermination(180)
    got = {r["work_id"]: (r["count"], r["average"]) for r in u.community_of(table).collect()}
    want = {r["work_id"]: (r["count"], r["average"]) for r in u.community_stats(u.current(events)).collect()}
    assert got == want and want
    assert table.read().count() == events.select("user_id", "work_id").distinct().count()
    assert len(Pointer(spark, str(tmp_path / "out")).read()["tables"]) <= max(keep, 1)


def test_old_deletions_are_forgotten(spark, tmp_path):
    table = u.ratings_table(spark, str(tmp_path / "t"), keep=1, forget="1 day")
    day = lambda n: datetime(2024, 1, n)
    u.add_events(table, spark.createDataFrame([(1, 1, 1, None, day(1)), (2, 1, 2, None, day(5)), (3, 1, 3, 7, day(1))], SCHEMA), 0)
    u.add_events(table, spark.createDataFrame([(4, 1, 2, 3, day(4))], SCHEMA), 1)
    assert {(r["work_id"], r["rating"]) for r in table.read().collect()} == {(2, None), (3, 7)}


def test_deletes(spark):
    t = datetime(2024, 1, 1)
    e = spark.createDataFrame([(1, 1, 1, 5, t), (2, 1, 1, None, t), (3, 2, 1, None, t)], SCHEMA)
    assert u.current(e).count() == 0
    assert {(r["user_id"], r["existed"]) for r in u.deleted(e).collect()} == {(1, True), (2, False)}
    assert u.rating_of(u.current(e), e.select("user_id", "work_id").distinct()).filter(F.col("count") == 0).count() == 2


def test_a_batch_counts_once(spark, tmp_path):
    sums = lambda df: df.groupBy("work_id").agg(F.sum("d_count").alias("d_count"), F.sum("d_sum").alias("d_sum"))
    table = FoldedTable(spark, str(tmp_path / "t"), "work_id long, d_count long, d_sum long", sums, keep=2)
    one = spark.createDataFrame([(1, 1, 5), (1, 1, 7), (2, 1, 3)], "work_id long, d_count long, d_sum long")
    assert table.read().count() == 0 and table.last == -1
    assert [table.add(one, n) for n in (0, 0, 1, 1, 0, 5, 4)] == [True, False, True, False, False, True, False]
    assert {tuple(r) for r in table.read().collect()} == {(1, 6, 36), (2, 3, 9)} and table.last == 5
    # what a killed job has written but not published counts nowhere; two writers can't publish the same state
    one.write.parquet(str(tmp_path / "t" / "batch-6-left"))
    assert {tuple(r) for r in table.read().collect()} == {(1, 6, 36), (2, 3, 9)}
    with pytest.raises(FileExistsError):
        table.pointer.publish({}, table.pointer.read()["number"])


def test_progress_through_a_kill(spark, tmp_path):
    """A job that dies in its third part and is started again leaves one status for each id."""
    errors = {0: None, 1: "insufficient_source: 20 characters", 2: "ConnectError: server", 3: "no JSON"}
    queue = spark.createDataFrame([(i, i % 4) for i in range(40)] + [(0, 0)], "id long, kind int")
    text = F.create_map(*(F.lit(x) for k, v in errors.items() for x in (k, v)))
    seen = []

    def analyse(part, fail_at=None, away=True):
        if fail_at == len(seen):
            raise RuntimeError("killed")
        seen.append(sorted(r["id"] for r in part.collect()))
        return part.select("id", F.when((F.col("kind") != 2) | F.lit(away), text[F.col("kind")]).alias("error"))

    log = progress.progress_log(spark, str(tmp_path / "log"), keep=3)
    with pytest.raises(RuntimeError):
        progress.run_pass(queue, lambda p: analyse(p, 2), log, 5)
    assert log.last == 1
    assert progress.run_pass(queue, analyse, log, 5) == 3 and progress.run_pass(queue, analyse, log, 5) == 0
    assert sorted(set(sum(seen, []))) == list(range(40)) and len(sum(seen, [])) == 41
    got = {r["id"]: r["status"] for r in log.read().collect()}
    assert len(got) == 30 and log.read().count() == 30
    assert [got.get(i) for i in range(4)] == ["ok", "skip:insufficient_source: 20 characters", None, "fail:no JSON"]
    # the next turn takes up those without a status; with retry_failed failed ones too
    seen.clear()
    assert progress.run_pass(queue, lambda p: analyse(p, away=False), log, 5, turn=1) == 5
    assert sorted(sum(seen, [])) == list(range(2, 40, 4))
    seen.clear()
    progress.run_pass(queue, analyse, log, 5, turn=2, retry_failed=True)
    assert sorted(sum(seen, [])) == list(range(3, 40, 4)) and log.read().count() == 40
