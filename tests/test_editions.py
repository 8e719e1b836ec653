import random

import pytest
from pyspark.sql import functions as F

from courier.operators.editions import audit_sketches, editions, key_sketches, overlapping_editions
from courier.operators.scan import running_max


@pytest.mark.parametrize("partitions", [1, 5, 30])
def test_running_max_equals_brute_force(spark, partitions):
    rnd = random.Random(partitions)
    rows = [(rnd.choice(["hot"] * 5 + ["a", "b", None]), i, rnd.choice([None, rnd.randrange(50)])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(4)
    got = {r["o"]: r["before"] for r in running_max(df, ["g"], ["o"], "v", partitions=partitions).collect()}
    want = {o: max((v for h, p, v in rows if h == g and p < o and v is not None), default=None) for g, o, _ in rows}
    assert got == want


def test_editions_that_overlap(spark):
    rows = [("k", "a", 1), ("k", "a", 9), ("k", "b", 4), ("k", "b", 5), ("k", "c", 9), ("k", "d", 10), ("k", "d", 12), ("k", "e", 20),
            (None, "a", 1), (None, "b", 2), ("z", "a", None), ("y", None, 1), ("y", "b", 1)]
    df = spark.createDataFrame(rows, "key string, course string, ts int")
    out = {(r["key"], r["course"]): (r["until"], r["overlaps"]) for r in overlapping_editions(editions(df)).collect()}
    assert out == {("k", "a"): (None, False), ("k", "b"): (9, True), ("k", "c"): (9, True), ("k", "d"): (9, False), ("k", "e"): (12, False),
                   (None, "a"): (None, False), (None, "b"): (1, False), ("y", None): (None, False), ("y", "b"): (1, True)}
    assert overlapping_editions(editions(df.limit(0))).count() == 0


def test_a_key_with_all_editions_spans_the_blocks(spark):
    df = spark.range(20_000).select(F.lit("k").alias("key"), F.col("id").alias("course"), (F.col("id") * 2).alias("first_ts"),
                                    (F.col("id") * 2 + F.when(F.col("id") % 100 == 0, 5).otherwise(1)).alias("last_ts"))
    out = overlapping_editions(df, partitions=16)
    assert out.where("overlaps").count() == 200 * 2
    assert out.select(F.spark_partition_id()).distinct().count() > 1


def test_sketches_of_days_merge_within_their_bound(spark):
    n = 20_000
    df = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") % 3).alias("course"), F.col("id").alias("owner"),
                               F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 30).alias("ts"))
    twice = df.unionByName(df)
    daily = key_sketches(twice)
    assert daily.select("day").distinct().count() > 5
    row = audit_sketches(daily).first()
    assert row["n_course"] == 3 and row["n_writes"] == 2 * n and abs(row["n_owner"] - n) < 4 * 0.033 * n
    one = spark.createDataFrame([("a", "c", "o", 1), ("a", "c", "o", 2), ("b", "c", "o", 1), ("b", "c", "p", 90_000)], "key string, course string, owner string, s long")
    got = audit_sketches(key_sketches(one.withColumn("ts", F.timestamp_seconds("s")))).collect()
    assert [(r["key"], r["n_course"], r["n_owner"], r["n_writes"]) for r in got] == [("b", 1, 2, 2)]
