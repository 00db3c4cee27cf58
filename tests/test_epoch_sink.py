import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.epoch_sink import EpochSink

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])


def _told(sink):
    return sorted((r.epoch, str(r.k), r.n) for r in sink.read().collect())


def test_epochs_are_whole_or_not_there(spark, tmp_path):
    sink = EpochSink(spark, str(tmp_path / "sink"), SCHEMA)
    assert sink.epochs() == [] and sink.read().count() == 0 and sink.roll_back(0) is False
    rows = spark.createDataFrame([("a", 1), ("a", 1), (None, None)], SCHEMA)
    assert sink.write(rows, 0) is True
    assert sink.write(rows, 0) is False
    assert sink.write(rows.limit(0), 1) is True
    with pytest.raises(Exception, match="bad row"):
        sink.write(rows.withColumn("n", F.when(F.col("k") == "a", F.raise_error(F.lit("bad row"))).cast("long")), 2)
    assert sink.epochs() == [0, 1]
    assert _told(sink) == [(0, "None", None), (0, "a", 1), (0, "a", 1)]
    assert [p.name for p in (tmp_path / "sink").iterdir() if p.name.startswith(".staging")] == []


def test_columns_are_exact(spark, tmp_path):
    sink = EpochSink(spark, str(tmp_path / "sink"), SCHEMA)
    rows = spark.createDataFrame([("a", 1)], SCHEMA)
    for wrong in (rows.drop("n"), rows.withColumn("more", F.lit(1)), rows.withColumn("n", F.col("n").cast("string"))):
        with pytest.raises(ValueError, match="are not"):
            sink.write(wrong, 0)
    assert sink.write(rows.select("n", "k"), 0)
    assert _told(sink) == [(0, "a", 1)]
    with pytest.raises(ValueError, match="own column"):
        EpochSink(spark, str(tmp_path / "x"), T.StructType([T.StructField("epoch", T.LongType())]))


def test_roll_back_of_one_orphan(spark, tmp_path):
    sink = EpochSink(spark, str(tmp_path / "sink"), SCHEMA)
    for e in range(4):
        sink.write(spark.createDataFrame([("a", e)], SCHEMA), e)
    with pytest.raises(ValueError, match="2 epochs"):
        sink.roll_back(1)
    assert sink.epochs() == [0, 1, 2, 3]
    assert sink.roll_back(2) is True and sink.epochs() == [0, 1, 2]
    assert sink.write(spark.createDataFrame([("b", 9)], SCHEMA), 3) and _told(sink)[-1] == (3, "b", 9)


def test_stream_that_fails_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        spark.createDataFrame([("a", i), ("b", 10 + i)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink = EpochSink(spark, str(tmp_path / "sink"), SCHEMA)
    failed = []

    def put(rows, epoch):
        sink.write(rows, epoch)
        if epoch == 1 and not failed:
            failed.append(epoch)  # the epoch is there, but the stream does not know it
            raise RuntimeError("lost")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    assert sink.epochs() == [0, 1]
    run()
    assert sink.epochs()[:2] == [0, 1]
    assert sorted((r.k, r.n) for r in sink.read().collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 10), ("b", 11), ("b", 12)]
