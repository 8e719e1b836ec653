"""Keys of deliveries and files, for owners, folders and prefixes of our own.

Fixed values: the key formats ``<prefix>/<folder>_<owner slug>.tar.gz`` and
``<prefix>/<stem>_<owner slug><extension>``, the slug (dots become underscores) and ``s3://<bucket>/<key>``.
"""

from itertools import product

import pytest

from courier.operators import delivery_keys, file_keys

OWNERS = ["lena.k", "o", "a.b.c", ""]


def _keys(spark, rows, **kw):
    df = spark.createDataFrame(rows, "path string, owner string, branch string")
    return {(r["path"], r["owner"], r["branch"]): r.asDict() for r in delivery_keys(df, **kw).collect()}


@pytest.mark.parametrize("prefix", [None, "term-7", ""])
def test_delivery_keys_follow_the_format(spark, prefix):
    folders = {"/srv/data/lab 3": "lab 3", "/srv/data/week.2/": "week.2", "notes": "notes"}
    rows = list(product(folders, OWNERS, ["main", "dev/x"]))
    got = _keys(spark, rows, bucket="store", **({} if prefix is None else {"prefix": prefix}))
    assert len(got) == len(rows)
    for path, owner, branch in rows:
        pre = branch if prefix is None else prefix
        name = f"{folders[path]}_{owner.replace('.', '_')}.tar.gz"
        key = f"{pre}/{name}" if pre else name
        assert (got[path, owner, branch]["key"], got[path, owner, branch]["uri"]) == (key, f"s3://store/{key}")


def test_file_keys_follow_the_format(spark):
    names = {"/d/scan.v2.nc": ("scan.v2", ".nc"), "/d/.profile": (".profile", ""), "run": ("run", ""), "/d/x.tar.gz": ("x.tar", ".gz")}
    rows = list(product(names, OWNERS, ["main"]))
    df = spark.createDataFrame(rows, "path string, owner string, branch string").withColumnRenamed("path", "p")
    for kw, pre in (({}, "main"), ({"prefix": "lab"}, "lab"), ({"prefix": ""}, "")):
        got = sorted(r["key"] for r in file_keys(df, name_col="p", bucket="store", **kw).collect())
        want = [(f"{stem}_{owner.replace('.', '_')}{end}" if owner else stem + end) for (stem, end), owner in product(names.values(), OWNERS)]
        assert got == sorted(f"{pre}/{w}" if pre else w for w in want)
    assert {r["key"] for r in file_keys(df, name_col="p", prefix="lab", key="one.bin").collect()} == {"lab/one.bin"}
