import random

import pytest
from pyspark.sql import functions as F

from courier.operators import folder_sizes

SCHEMA = "owner string, key string, length bigint, is_link boolean"


def brute(rows, names=("__pycache__", ".ipynb_checkpoints"), by=True):
    out = {}
    for owner, key, n, link in rows:
        if key is None or link:
            continue
        parts = key.split("/")[:-1]
        if any(p in names for p in parts):
            continue
        for d in range(len(parts) + 1):
            at = (owner if by else None, "/".join(parts[:d]), d)
            b, f = out.get(at, (0, 0))
            out[at] = (b + (n or 0), f + 1)
    return out


def got(df, by=True):
    rows = df.collect()
    out = {(r["owner"] if by else None, r["folder"], r["depth"]): (r["total_bytes"], r["n_files"]) for r in rows}
    assert len(out) == len(rows)
    return out


def tree(seed, n=400):
    rnd = random.Random(seed)
    names = ["a", "b", "b-", "b.c", "a b", "é", "__pycache__", "x", "B", "0", "~"]
    rows = [(rnd.choice(["u", "u", "u", "v", None]), "/".join(rnd.choice(names) for _ in range(rnd.randrange(1, 7))),
             rnd.choice([None, 0, 1, 10, 10**12]), rnd.random() < .1) for _ in range(n)]
    return rows + [("u", None, 5, False), ("hot", "r/s/t/file", 1, None)] + [("hot", f"r/s/{i:04d}", 2, None) for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 7, 40])
@pytest.mark.parametrize("by", [True, False])
def test_equals_brute_force(spark, partitions, by):
    rows = tree(partitions)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(folder_sizes(df, ["owner"] if by else [], partitions=partitions), by) == brute(rows, by=by)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert folder_sizes(empty, ["owner"]).collect() == []
    rows = [("u", "a//b", 1, None), ("u", "a/", 2, None), ("u", "/top", 4, None), ("u", "a/b", 8, None), ("u", "a/b/c", 16, None), ("u", "a/b", 8, None)]
    assert got(folder_sizes(spark.createDataFrame(rows, SCHEMA), ["owner"])) == brute(rows)
    with pytest.raises(ValueError):
        folder_sizes(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("owner", "Folder"), ["Folder"])
    # columns of the operator's own names in the inventory
    odd = spark.createDataFrame([("x/y", 3, 9, 9)], "key string, length bigint, _n int, _key int")
    assert {r["folder"]: r["total_bytes"] for r in folder_sizes(odd).collect()} == {"": 3, "x": 3}


def test_work_follows_folders_not_depth(spark):
    """10,000 files at depth 50: the rows behind the pass are two per folder."""
    deep = "/".join(f"d{i}" for i in range(50))
    inv = spark.range(10_000).select(F.concat(F.lit(deep + "/f"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("key"), F.lit(1).alias("length"))
    out = folder_sizes(inv, partitions=16)
    assert out.count() == 51 and out.where("total_bytes <> 10000 OR n_files <> 10000").count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "CartesianProduct" not in plan
