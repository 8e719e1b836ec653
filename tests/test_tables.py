import pytest

from courier.functions import tables
from courier.operators import pack_archives, unpack_archives


def test_lateral_and_table_forms_equal_the_operator(spark):
    tables.register(spark)
    objects = spark.createDataFrame([("u", "a", b"1"), ("u", "b/c", b"22"), ("v", "d", b""), ("v", "__pycache__/x", b"3")], "owner string, key string, content binary")
    bundles = pack_archives(objects, "owner", max_part_bytes=1).unionByName(
        spark.createDataFrame([("w", "f", 0, "n", bytearray(b"junk"), 0, 0), ("w", "f", 1, "n", None, 0, 0)], pack_archives(objects, "owner").schema))
    bundles.createOrReplaceTempView("bundles_of_test")
    want = {(r["owner"], r["part"], r["path"], r["length"], r["kind"]) for r in unpack_archives(bundles).collect()}
    lateral = spark.sql("SELECT b.owner, b.part, m.* FROM bundles_of_test b, LATERAL unpack_archive(b.archive) m").collect()
    assert {(r["owner"], r["part"], r["path"], r["length"], r["kind"]) for r in lateral} == want
    assert sorted(r["error"] or "" for r in lateral if r["owner"] == "w")[1] == "missing archive"
    whole = spark.sql("SELECT * FROM unpack_archives(TABLE(bundles_of_test) PARTITION BY owner ORDER BY part)").collect()
    assert {(r["owner"], r["part"], r["path"], r["length"], r["kind"]) for r in whole} == want
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM unpack_archives(TABLE(SELECT owner FROM bundles_of_test) PARTITION BY owner)").collect()
