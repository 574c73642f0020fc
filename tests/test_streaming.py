from pyspark.sql import functions as F

from strata.plans.store import Store
from strata.streaming.ingest import ingest, latest_view, windowed_commits


def stream_of(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_into_store_once(spark, tmp_path):
    schema = "seq long, op string, k string, v string"
    folder = str(tmp_path / "in")
    stream_of(spark, folder, [(1, "PUT", "a", "1"), (2, "PUT", "b", "2")], schema)
    stream = stream_of(spark, folder, [(3, "REMOVE", "a", ""), (4, "PUT", "c", "3")], schema)
    store = Store(spark, str(tmp_path / "store"))
    ingest(stream, store, "events", str(tmp_path / "checkpoint"), "seq").awaitTermination()
    assert {r.k: r.v for r in store.live().collect()} in ({"b": "2", "c": "3"}, {"a": "1", "b": "2", "c": "3"})  # files may come in any order
    before = store.last_seq()
    again = spark.createDataFrame([("z", "1")], "k string, v string")
    assert store.put_all(again, stream=("events", 0)) == 0 and store.last_seq() == before
    assert store.put_all(again, stream=("events", 99)) == 1


def test_latest_view_goes_by_sequence(spark, tmp_path):
    schema = "seq long, op string, k string, v string"
    stream = stream_of(spark, str(tmp_path / "in"), [(5, "PUT", "a", "new"), (1, "PUT", "a", "old"), (2, "PUT", "b", ""), (9, "CLEAR", "", "")], schema)
    q = latest_view(stream).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, r.v, r.live) for r in spark.table("latest").collect()} == {("a", "new", True), ("b", "", False)}


def test_windows_with_late_records(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:0{i // 2}") for i in range(8)]
    stream = stream_of(spark, str(tmp_path / "in"), rows, "seq long, at string").withColumn("at", F.to_timestamp("at"))
    q = windowed_commits(stream, "at", "1 second", "0 seconds").writeStream.outputMode("append").format("memory").queryName("commits").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.records for r in spark.table("commits").collect()} == {2}
