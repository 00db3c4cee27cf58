import random

import pytest
from pyspark.sql import functions as F

from millrace.streaming.machines import Barrier, DayBudget, OperationTimer, Retention, run_stream, run_table

SCHEMA = "k string, at double, seq bigint, client string, cost bigint, closed boolean, job string, member string, identity string, op string"
MACHINES = {
    "budget": DayBudget(most=12, seconds=500, capacity=2, window=600),
    "retention": Retention(ttl=900, capacity=4),
    "barrier": Barrier(needed=3, deadline=1200),
    "timer": OperationTimer(limit=400),
}


def events(seed, n=120):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        at = 1_700_000_000.0 + pick.randrange(0, 6000) + pick.choice([0, 0.25, 0.0005])
        rows.append((pick.choice(["a", "b", None]), at, i, pick.choice("xyz"), pick.randint(10, 60), pick.random() < 0.1, f"j{i}", pick.choice("pqrs"), "same" if pick.random() < 0.9 else "other", pick.choice(["start", "done", "failed"])))
    return rows


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("name", sorted(MACHINES))
def test_streams_of_shuffled_micro_batches_tell_what_the_table_tells(spark, tmp_path, rocks, name):
    rows, machine = events(3), MACHINES[name]
    table = spark.createDataFrame(rows, SCHEMA)
    whole = told(run_table(table, "k", "at", "seq", machine, until=1_700_000_000 + 90_000))
    # Out of order by less than the lateness, in five micro-batches; a last row moves the watermark past all others.
    pick = random.Random(5)
    dealt = sorted(rows, key=lambda r: r[1] + pick.uniform(0, 500))
    for i in range(5):
        part = dealt[i * 24 : (i + 1) * 24]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = [("end", 1_700_000_000.0 + 100_000, 10_000, "x", 1, False, "jz", "p", "same", "start")]
    spark.createDataFrame(last, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
    out = run_stream(stream, "k", "at", "seq", machine, lateness="10 minutes")
    run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = told(spark.read.schema(out.schema).parquet(str(tmp_path / "out")).filter("k is null or k <> 'end'"))
    assert whole and got == whole


def test_all_four_refusals_in_order(spark):
    rows = [
        ("d", 0.0, 1, "c", 10, True),
        ("d", 1.0, 2, "c", 10, False),
        ("d", 2.0, 3, "c", 10, False),  # the bucket of c is empty
        ("d", 3.0, 4, "e", 95, False),  # more seconds than are left
        ("d", 4.0, 5, "e", 5, False),
        ("d", 5.0, 6, "e", 5, False),  # two are in, and that is all
        ("d", 6.0, 7, "e", 5, True),
    ]
    table = spark.createDataFrame(rows, "k string, at double, seq bigint, client string, cost bigint, closed boolean")
    out = run_table(table, "k", "at", "seq", DayBudget(most=2, seconds=100, capacity=1, window=3600)).collect()
    assert [r["reason"] for r in sorted(out, key=lambda r: r["sequence"])] == ["closed", None, "rate", "seconds", None, "count", "closed"]


def test_what_is_due_comes_before_what_happens_then(spark):
    rows = [("a", 0.0, 1, "start"), ("a", 10.0, 2, "done"), ("a", 11.0, 3, "start"), ("a", 12.0, 4, "start"), ("a", 14.0, 5, "done"), ("b", None, 6, "start")]
    out = run_table(spark.createDataFrame(rows, "k string, at double, seq bigint, op string"), "k", "at", "seq", OperationTimer(limit=10))
    assert told(out) == [("a", 1, "expired", 10.0), ("a", 2, "no start", None), ("a", 3, "done", 3.0), ("a", 4, "overlap", None)]


def test_empty_table(spark):
    for machine in MACHINES.values():
        assert run_table(spark.createDataFrame([], SCHEMA), "k", "at", "seq", machine).collect() == []
