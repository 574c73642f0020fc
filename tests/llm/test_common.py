from pyspark.sql import functions as F

from strata.llm import common


def test_salted_join_gives_what_a_plain_one_gives(spark, monkeypatch):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    rows = rows.unionByName(spark.createDataFrame([(5000, None), (5001, "alone")], "id long, k string"))
    groups = common.cut(rows.where("k is not null and k <> 'alone'").groupBy("k").agg(F.count("*").alias("n")))
    want = sorted(map(tuple, rows.join(groups, "k", "left").select("id", "n").collect()))
    assert sorted(map(tuple, common.salted_left(rows, groups, "k", "id").select("id", "n").collect())) == want
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    salted = common.salted_left(rows, groups, "k", "id")
    assert "SortMergeJoin" in salted._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, salted.select("id", "n").collect())) == want


def test_split_join_gives_what_a_plain_one_gives(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.lit("s").alias("salt"))
    groups = spark.createDataFrame([("hot", 1, 0), ("hot", 2, 0), ("k1", 3, 0), ("none", 4, 0)], "k string, n int, copies int")
    want = sorted(map(tuple, rows.join(groups, "k").select("id", "n", "salt", "copies").collect()))
    for most in (100, 10_000):
        assert sorted(map(tuple, common.split_join(rows, groups, "k", "id", most).select("id", "n", "salt", "copies").collect())) == want
    assert common.split_join(rows, groups, "k", "id", 100).columns == rows.join(groups, "k").columns


def test_blobs_are_files_with_a_trailer(spark):
    raw = [bytes(range(256)) * 3, b"", b"\n\r\xff\xfe"]
    path = common.write_blobs(spark.createDataFrame([(bytearray(b),) for b in raw], "data binary"), "data", "END")
    assert sorted(bytes(r.content) for r in common.read_blobs(spark, path).collect()) == sorted(b + b"END" for b in raw)


def test_dropped_tables_are_gone(spark):
    import os

    df = common.cut(spark.range(3))
    other = common.cut(spark.range(4))
    path = common._paths[df]
    assert df.count() == 3
    common.drop(df, df)
    assert not os.path.exists(path.removeprefix("file://")) and other.count() == 4


def test_a_worker_holds_one_table():
    made, held_by_worker = [], common.held_by_worker
    make = lambda x: lambda: made.append(x) or x
    assert [held_by_worker("a", make(1)), held_by_worker("a", make(2)), held_by_worker("b", make(3)), held_by_worker(None, None), held_by_worker("b", make(4))] == [1, 1, 3, None, 4]
    assert made == [1, 3, 4]
