import os

from pyspark.sql import functions as F

from courier.operators import fetch_user_archive
from courier.operators.suffixes import find_archives, keys_ending, store_by_suffix
from courier.session import work_dir
from courier.sources import object_inventory


def test_filters_reach_the_listing(spark, tmp_path):
    for name in ["a/x.txt", "a/x.gz", "ab/y.txt", "b/x.txt", ".a/x.txt"]:
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text("text")
    inv = object_inventory(spark, str(tmp_path), content=True)
    found = lambda c: sorted(r["key"] for r in inv.where(c).collect())
    assert found(F.col("key").startswith("a") & F.col("key").endswith(".txt")) == ["a/x.txt", "ab/y.txt"]
    assert found(F.col("key") == "b/x.txt") == ["b/x.txt"]
    assert found(F.col("key").startswith("a/") & F.col("key").startswith("b")) == []
    assert found(F.col("key").startswith("a/") & F.col("key").startswith("a") & (F.col("length") > 3)) == ["a/x.gz", "a/x.txt"]
    assert found(F.col("key").endswith("x.txt") & F.col("key").endswith("t")) == [".a/x.txt", "a/x.txt", "b/x.txt"]
    # what the source took is no filter of Spark any more
    plan = inv.where(F.col("key").endswith(".txt"))._jdf.queryExecution().executedPlan().toString()
    assert "EndsWith" not in plan.split("BatchScan")[0]
    assert "Filter" in inv.where(F.col("key") == "b/x.txt")._jdf.queryExecution().executedPlan().toString()


def test_reader_takes_only_what_it_can():
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringEndsWith, StringStartsWith

    from courier.sources.tree import TreeReader

    reader = TreeReader({"path": "/none", "prefix": "a"})
    left = list(reader.pushFilters([StringStartsWith(("key",), "ab"), StringEndsWith(("key",), "z"), GreaterThan(("length",), 3),
                                    EqualTo(("key",), "abcz"), StringStartsWith(("link_target",), "q")]))
    assert [type(f).__name__ for f in left] == ["GreaterThan", "EqualTo", "StringStartsWith"]
    assert (reader.prefix, reader.suffix, reader.nothing) == ("abcz", "abcz", False)
    list(reader.pushFilters([StringEndsWith(("key",), "y")]))
    assert reader.nothing


def test_suffix_look_ups_prune_the_stored_inventory(spark, monkeypatch):
    inv = spark.range(5000).select(F.concat(F.lit("c/m_user_"), F.col("id").cast("string"), F.lit(".tar.gz")).alias("key"), F.col("id").alias("length"))
    inv = inv.unionByName(spark.createDataFrame([("c/other.txt", 1), (None, 2), ("m_é.tar.gz", 3)], "key string, length long"))
    path = work_dir(spark, "suffixes")
    assert store_by_suffix(inv, path).count() == 5002
    got = keys_ending(spark, path, ["_17.tar.gz", "é.tar.gz"])
    assert {r["key"] for r in got.collect()} == {"c/m_user_17.tar.gz", "m_é.tar.gz"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(reversed_key,zg.rat.71_)" in plan
    assert keys_ending(spark, path, []).count() == 0
    owners = spark.createDataFrame([("user.7",), ("user.49",), ("zed",), ("é",), ("9",)], "owner string")
    want = sorted(tuple(r) for r in fetch_user_archive(inv, owners, match="suffix").collect())
    assert sorted(tuple(r) for r in find_archives(spark, path, owners).collect()) == want and len(want) == 4
    import courier.operators.suffixes as module
    monkeypatch.setattr(module, "SUFFIXES_IN_A_FILTER", 2)
    assert sorted(tuple(r) for r in find_archives(spark, path, owners).collect()) == want
