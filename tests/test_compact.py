import os

import pytest
from pyspark.sql import functions as F

from courier.operators.bundle import BundleError, compact_objects
from courier.session import local_path, work_dir


@pytest.mark.parametrize("codec", ["zstd", "gzip"])
def test_files_follow_the_plan(spark, codec):
    objects = spark.range(3000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("key"),
                                       F.encode(F.concat(F.col("id").cast("string"), F.expr("string(uuid())"), F.lit("x" * 60)), "UTF-8").alias("content"), "id")
    objects = objects.withColumn("length", F.octet_length("content"))
    rows = [tuple(r) for r in objects.select("key", "id").collect()]
    target = work_dir(spark, "compact", codec)
    out = compact_objects(objects, target, target_bytes=50_000, codec=codec)
    assert out.columns == objects.columns and sorted(tuple(r) for r in out.select("key", "id").collect()) == sorted(rows)
    assert out.where("octet_length(content) <> length").count() == 0
    names = [n for n in os.listdir(local_path(target)) if n.endswith(".parquet")]
    assert all(f".{'gz' if codec == 'gzip' else codec}." in n for n in names)
    per = out.groupBy(F.input_file_name().alias("f")).agg(F.sum("length").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).orderBy("a").collect()
    assert len(per) == len(names) and all(r["n"] <= 50_000 + 120 for r in per) and len(per) <= 7
    assert all(x["b"] < y["a"] for x, y in zip(per, per[1:]))


def test_edge_cases(spark):
    objects = spark.createDataFrame([("a", b"1", 1), ("b", None, None), ("c", b"", 0)], "key string, content binary, length long")
    got = compact_objects(objects, work_dir(spark, "c"), target_bytes=1)
    assert {(r["key"], None if r["content"] is None else bytes(r["content"])) for r in got.collect()} == {("a", b"1"), ("b", None), ("c", b"")}
    assert compact_objects(objects.limit(0), work_dir(spark, "c")).count() == 0
    for bad in (objects.unionByName(objects.limit(1)), objects.withColumn("key", F.when(F.col("key") != "a", F.col("key")))):
        with pytest.raises(BundleError):
            compact_objects(bad, work_dir(spark, "c"))
