import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.sweeps import Sweep
from millrace.sources.state_log import Conflict, StateLog

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


@pytest.fixture
def log(spark, tmp_path):
    return StateLog(spark, f"file://{tmp_path}/store", ["k"], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def changes(spark, *rows):
    return spark.createDataFrame(rows, "k string, v bigint, revision bigint")


def test_commits_and_snapshots(spark, log):
    assert log.version() == 0 and rows_of(log.snapshot()) == []
    assert log.commit(changes(spark, ("a", 1, None), ("b", 2, None), (None, 3, None))) == 1
    assert log.commit(changes(spark, ("a", 10, 1), (None, 30, 1))) == 2
    assert rows_of(log.snapshot()) == rows_of(changes(spark, ("a", 10, 2), ("b", 2, 1), (None, 30, 2)))
    assert rows_of(log.snapshot(1)) == rows_of(changes(spark, ("a", 1, 1), ("b", 2, 1), (None, 3, 1)))
    with pytest.raises(ValueError):
        log.snapshot(3)
    with pytest.raises(ValueError):
        log.commit(changes(spark, ("c", 1, None), ("c", 2, None)))
    assert log.version() == 2 and log.history().count() == 5


def test_a_change_of_another_revision_is_refused_whole(spark, log):
    log.commit(changes(spark, ("a", 1, None)))
    for wrong in (("a", 2, None), ("a", 2, 2), ("z", 1, 4)):
        with pytest.raises(Conflict):
            log.commit(changes(spark, ("n", 5, None), wrong))
    assert rows_of(log.snapshot()) == [("a", 1, 1)] and log.collect_garbage() == 0


def test_two_writers_of_one_revision_one_is_refused(spark, log):
    log.commit(changes(spark, ("a", 1, None), ("b", 1, None)))
    said = []

    def write(value):
        try:
            own = StateLog(spark, log.path, ["k"], SCHEMA)
            said.append(own.commit(changes(spark, ("a", value, 1))))
        except Conflict:
            said.append("refused")

    writers = [threading.Thread(target=write, args=(v,)) for v in (7, 8)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(map(str, said)) == ["2", "refused"]
    assert rows_of(log.snapshot())[0][2] == 2


def test_the_loser_of_a_number_takes_the_next_one_unless_its_keys_were_touched(spark, log, monkeypatch):
    other = StateLog(spark, log.path, ["k"], SCHEMA)
    log.commit(changes(spark, ("a", 1, None), ("b", 1, None)))
    plain, late = StateLog._put, []

    def slow(self, entry):
        if self is log and not late:
            late.append(other.commit(changes(spark, ("b", 5, 1))))
        return plain(self, entry)

    monkeypatch.setattr(StateLog, "_put", slow)
    assert log.commit(changes(spark, ("a", 9, 1), ("new", 1, None))) == 3
    assert rows_of(log.snapshot()) == [("a", 9, 2), ("b", 5, 2), ("new", 1, 1)]
    late.clear()
    with pytest.raises(Conflict):
        other.commit(changes(spark, ("a", 0, 1)))

    def again(self, entry):
        if self is log and not late:
            late.append(other.commit(changes(spark, ("new", 7, 1))))
        return plain(self, entry)

    monkeypatch.setattr(StateLog, "_put", again)
    with pytest.raises(Conflict):
        log.commit(changes(spark, ("new", 8, 1)))


def test_a_batch_counts_once(spark, log):
    add = lambda rows: rows.select("k", (F.coalesce("v", F.lit(0)) + F.col("n")).alias("v"), "revision")
    batch = spark.createDataFrame([("a", 5), ("b", 1)], "k string, n bigint")
    assert [log.update(batch, add, writer="w", batch=0), log.update(batch, add, writer="w", batch=0), log.update(batch, add, writer="w", batch=1)] == [1, 1, 2]
    assert rows_of(log.snapshot()) == [("a", 10, 2), ("b", 2, 2)]


def test_deleted_states_and_compaction(spark, log):
    log.commit(changes(spark, ("a", 1, None), ("b", 2, None)))
    log.commit(changes(spark, ("a", None, 1)).withColumn("deleted", F.lit(True)))
    assert rows_of(log.snapshot()) == [("b", 2, 1)]
    assert log.compact() == 3 and rows_of(log.snapshot()) == [("b", 2, 1)]
    with pytest.raises(Conflict):
        log.commit(changes(spark, ("a", 4, None)))  # its revision is 2, also when it is deleted
    log.commit(changes(spark, ("a", 4, 2)))
    assert rows_of(log.snapshot()) == [("a", 4, 3), ("b", 2, 1)] and log.history().count() == 4


def test_a_stream_writes_each_batch_once(spark, log, tmp_path):
    for i in range(3):
        spark.createDataFrame([("a", i), ("b", 1)], "k string, n bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add = lambda rows: rows.select("k", (F.coalesce("v", F.lit(0)) + F.col("n")).alias("v"), "revision")

    def put(df, batch):
        sums = df.groupBy("k").agg(F.sum("n").alias("n"))
        for _ in range(2):  # a batch that is delivered again
            log.update(sums, add, writer="stream", batch=batch)

    stream = spark.readStream.schema("k string, n bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [(k, v) for k, v, _ in rows_of(log.snapshot())] == [("a", 3), ("b", 3)]


def test_leases_of_a_sweep(spark, tmp_path):
    sweep = Sweep(spark, f"file://{tmp_path}/sweep")
    ask = lambda *rows, more="": spark.createDataFrame(rows, "case_id string, attempt_id string, lease_owner string" + more)
    told = lambda df: {r["case_id"]: r["result"] for r in df.collect()}
    at = lambda minute: f"2024-01-01 00:{minute:02d}:00"
    sweep.initialize(spark.createDataFrame([("x",), ("y",), ("x",)], "case_id string"), at(0))
    sweep.initialize(spark.createDataFrame([("x",)], "case_id string"), at(0))
    assert told(sweep.claim(ask(("x", "a1", "o1"), ("x", "a2", "o2"), ("z", "a1", "o1")), at(0))) == {"x": "claimed", "z": "unknown"}
    assert told(sweep.claim(ask(("x", "a1", "o1")), at(5))) == {"x": "held"}
    assert told(sweep.claim(ask(("x", "a1", "o2")), at(5))) == {"x": "other owner"}
    assert told(sweep.claim(ask(("x", "a2", "o2")), at(5))) == {"x": "busy"}
    assert told(sweep.renew(ask(("x", "a9", "o1")), at(6))) == {"x": "no lease"}
    assert told(sweep.claim(ask(("x", "a1", "o1")), at(10))) == {"x": "used"}  # its time is over
    assert told(sweep.claim(ask(("x", "a2", "o2"), ("y", "b1", "o2")), at(10))) == {"x": "claimed", "y": "claimed"}
    done = lambda d: ask(("y", "b1", "o2", d), more=", run_digest string")
    assert [told(sweep.succeed(done(d), at(11)))["y"] for d in ("d", "d", "e")] == ["ok", "same", "other digest"]
    assert told(sweep.fail(ask(("x", "a2", "o2", "BROKEN"), more=", error_code string"), at(12))) == {"x": "ok"}
    assert told(sweep.claim(ask(("x", "a3", "o1"), ("y", "b2", "o1")), at(13))) == {"x": "claimed", "y": "not pending"}
    sweep.reap(at(30))
    state = {r["case_id"]: r for r in sweep.cases().collect()}
    assert (state["x"]["state"], state["x"]["attempt"], state["x"]["failure_codes"]) == ("failed", 3, ["LEASE_EXPIRED", "BROKEN", "LEASE_EXPIRED"])
    assert (state["y"]["state"], state["y"]["run_digest"], state["y"]["revision"]) == ("succeeded", "d", 3)
