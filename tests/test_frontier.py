import os

import pytest
from pyspark.sql import functions as F

from courier.sources.frontier import frontier_inventory
from courier.sources.tree import object_inventory


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("frontier")
    names = [".bashrc", "__init__.py", "_c=d.txt", "a b/é.txt", "deep/1/2/3/4/5/x", ".git/config", "__pycache__/x.pyc", "deep/__pycache__/y"]
    names += [f"hot/{i % 40}/f{i}" for i in range(400)] + [f"flat/{i:05d}" for i in range(300)]
    for i, name in enumerate(names):
        os.makedirs(os.path.dirname(base / name), exist_ok=True)
        (base / name).write_bytes(b"x" * (i % 50))
    os.makedirs(base / "empty/inner")
    os.symlink("a b/é.txt", base / "link")
    os.symlink("deep", base / "folder_link")
    return str(base)


def keys(df):
    return {(r["key"], r["length"]) for r in df.collect()}


def test_equals_the_tree_source(spark, root):
    cols = ["key", "length", "is_link", "link_target", "mode", "modified"]
    got = frontier_inventory(spark, root)
    want = object_inventory(spark, root)
    assert got.count() == want.count() == 710
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    with_folders = frontier_inventory(spark, f"file:{root}", folders=True, prune=["__pycache__"])
    want = object_inventory(spark, root, folders=True, prune=["__pycache__"])
    assert {r["key"] for r in with_folders.collect()} == {r["key"] for r in want.collect()} >= {"empty/inner", ".bashrc", "_c=d.txt"}


def test_arrow_lister_keeps_hidden_names(spark, root):
    want = {k for k in keys(object_inventory(spark, root).where("NOT is_link"))}
    got = keys(frontier_inventory(spark, root, lister="arrow"))
    assert want <= got and {k for k, _ in got} - {k for k, _ in want} == {"link"}
    assert {k for k, _ in keys(frontier_inventory(spark, root, lister="arrow", prefix="deep/1"))} == {"deep/1/2/3/4/5/x"}


def test_prefix_and_missing_root(spark, root):
    assert keys(frontier_inventory(spark, root, prefix="hot/7/f")) == keys(object_inventory(spark, root, prefix="hot/7/f")) != set()
    assert frontier_inventory(spark, root + "/none").count() == 0
    with pytest.raises(ValueError):
        frontier_inventory(spark, "s3://bucket/x", lister="local")


def test_a_heavy_child_spreads_over_all_tasks(spark, root):
    out = frontier_inventory(spark, root, partitions=8).groupBy(F.spark_partition_id().alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("key").startswith("hot/"), 1)).alias("hot"),
        F.count(F.when(F.col("key").startswith("flat/"), 1)).alias("flat")).collect()
    assert len(out) == 8 and max(r["n"] for r in out) < 2 * 710 / 8
    assert all(r["hot"] > 20 and r["flat"] > 15 for r in out)
