import pyarrow as pa
from pyspark.sql import functions as F

from spanloom.plans.session import BATCH_BYTES, data_bytes, give_back, ship, small_or_plain


def test_bytes_of_a_side(spark):
    df = spark.range(10).select("id", F.lit(1).alias("k"))
    assert data_bytes(df) == 10 * 24
    assert data_bytes(df.limit(0)) == 0
    rows = [("abc", [1, 2], [(1, 2)], {"a": "bc"}, ["xy", "z"]), (None, None, None, None, None)]
    wide = spark.createDataFrame(rows, "s string, a array<int>, r array<struct<x:int,y:int>>, m map<string,string>, t array<string>")
    full, empty = (data_bytes(wide.limit(1)), data_bytes(wide.where("s IS NULL")))
    assert full > empty > 0 and data_bytes(wide) == full + empty
    long = spark.createDataFrame([("x" * 5000,)], "s string")
    assert 5000 < data_bytes(long) < 5100


def test_a_side_is_broadcast_by_its_bytes(spark):
    df = spark.createDataFrame([("x" * 5000,)], "s string")
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(small_or_plain(df)) and not hinted(small_or_plain(df, 4000))


def test_odd_names(spark):
    assert data_bytes(spark.range(3).toDF("a.b")) == 3 * 16


def test_batches_are_bounded_by_bytes(spark):
    """Long rows come to a Python worker a few at a time; a smaller bound of the session's own is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "1g")
        ship(spark)
        assert int(spark.conf.get(key)) == BATCH_BYTES
        spark.conf.set(key, "1m")
        ship(spark)
        assert spark.conf.get(key) == "1m"
        df = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 500_000).alias("s"))
        sizes = df.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").collect()
        assert sum(r.n for r in sizes) == 40 and max(r.n for r in sizes) <= 5
    finally:
        spark.conf.set(key, was)


def test_heaps_are_given_back(spark):
    """A heap that grew shrinks again."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    # a shuffled sort of long rows leaves much garbage
    spark.range(0, 400_000, 1, 4).selectExpr("id", "repeat(CAST(id AS STRING), 300) AS t").repartition(4, "t").sortWithinPartitions("t").write.format("noop").mode("overwrite").save()
    grown, used = runtime.totalMemory(), runtime.totalMemory() - runtime.freeMemory()
    give_back(spark)
    assert runtime.totalMemory() - runtime.freeMemory() < used and runtime.totalMemory() < grown
