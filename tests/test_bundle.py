import io
import tarfile

import pytest

from pyspark.sql import functions as F

from courier.operators import bundle_plan, pack_archives, unpack_archives
from courier.sources.tables import documents_inventory

from conftest import SF001


def test_pack_unpack_roundtrip_bounded_and_reproducible(spark):
    inv = documents_inventory(spark, SF001, content=True)
    bundles = pack_archives(inv, "owner", max_part_bytes=8192, partitions=7)
    rows = bundles.collect()
    plan = (bundle_plan(inv.drop("content"), "owner", "key", "length", 8192).groupBy("owner", "part")
            .agg(F.count("*").alias("n"), F.sum("length").alias("b")).collect())
    assert sorted((r.owner, r.part, r.n_files, r.bytes) for r in rows) == sorted(tuple(r) for r in plan)
    assert len({(r.owner, r.part) for r in rows}) == len(rows)
    members = unpack_archives(bundles).select(F.col("path").alias("key"), "content")
    orig = inv.select("key", "content")
    assert members.exceptAll(orig).count() == 0 and orig.exceptAll(members).count() == 0
    again = {(r.owner, r.part): r.archive for r in pack_archives(inv, "owner", max_part_bytes=8192, partitions=3).collect()}
    assert again == {(r.owner, r.part): r.archive for r in rows}


def test_pack_hot_owner_spans_blocks(spark):
    rows = [("hot", f"k{i:05d}", bytes([i % 251]) * (i % 300)) for i in range(3000)]
    rows += [(f"o{i % 40}", f"k{i:05d}", b"x" * (i % 50)) for i in range(400)]
    df = spark.createDataFrame(rows, "owner string, key string, content binary")
    out = pack_archives(df, "owner", max_part_bytes=4096, partitions=16).collect()
    plan = (bundle_plan(df.withColumn("length", F.octet_length("content")), max_part_bytes=4096)
            .groupBy("owner", "part").agg(F.count("*").alias("n"), F.sum("length").alias("b")).collect())
    assert sorted((r.owner, r.part, r.n_files, r.bytes) for r in out) == sorted(tuple(r) for r in plan)
    members = unpack_archives(spark.createDataFrame(out)).select("path", "content")
    assert members.exceptAll(df.select(F.col("key").alias("path"), "content")).count() == 0
    assert members.count() == df.count()


def test_bundle_plan_parts(spark):
    rows = [("o", f"k{i:02d}", 40) for i in range(10)]
    df = spark.createDataFrame(rows, "owner string, key string, length bigint")
    parts = [r.part for r in bundle_plan(df, max_part_bytes=100).orderBy("key").collect()]
    assert parts == [0, 0, 0, 1, 1, 2, 2, 2, 3, 3]


def _tar(members):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tar:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return buf.getvalue()


def test_unpack_rules(spark):
    blob = _tar([("root/a.txt", b"a"), ("root/.ipynb_checkpoints/x", b"x"), ("root/__pycache__/y.pyc", b"y"),
                 ("root/../../etc/passwd", b"p")])
    df = spark.createDataFrame([("u", 0, blob), ("v", 0, b"not an archive"), ("w", 0, None)],
                               "owner string, part bigint, archive binary")
    rows = unpack_archives(df).collect()
    ok = {r.path: r.content for r in rows if r._error is None}
    assert ok == {"a.txt": b"a", "__pycache__/y.pyc": b"y"}
    errors = sorted(r._error.split(":")[0] for r in rows if r._error)
    assert errors == ["corrupt archive", "missing archive", "unsafe member path"]


def test_empty_inputs(spark):
    from courier.operators import running_sum, transfer_progress

    empty = spark.createDataFrame([], "owner string, key string, content binary")
    assert pack_archives(empty, "owner").count() == 0
    assert unpack_archives(pack_archives(empty, "owner")).count() == 0
    e2 = spark.createDataFrame([], "g string, o bigint, v bigint")
    assert running_sum(e2, ["g"], ["o"], "v", "cum").count() == 0
    assert transfer_progress(e2, ["g"], ["o"], "v").count() == 0


@pytest.mark.parametrize("row, error", [(("o", None, b"y", 1), "without a key"), (("o", "b.txt", None, 1), "no body"),
                                        (("o", "c.txt", b"cut", 9), "3 of 9 bytes"), (("o", "a.txt", b"again", 5), "keys twice")])
def test_nothing_is_left_out_silently(spark, row, error):
    df = spark.createDataFrame([("o", "a.txt", b"x", 1), row], "owner string, key string, content binary, length bigint")
    with pytest.raises(Exception, match=error):
        pack_archives(df, "owner").collect()


def test_two_folders_of_one_owner_are_two_bundles(spark):
    df = spark.createDataFrame([("u", "/h/bootcamp", "a.txt", b"1"), ("u", "/h/materials", "a.txt", b"22"), ("u", "/h/materials/", "b.txt", b"3")],
                               "owner string, dir string, key string, content binary")
    rows = {r.name: (r.folder, r.n_files, r.bytes) for r in pack_archives(df, path_col="dir").collect()}
    assert rows == {"bootcamp_u.tar.gz": ("bootcamp", 1, 1), "materials_u.tar.gz": ("materials", 2, 3)}


def test_links_folders_and_modes_are_stored(spark, tmp_path):
    import os

    from courier.sources import object_inventory

    (tmp_path / "d" / "void").mkdir(parents=True)
    (tmp_path / "d" / "run.sh").write_bytes(b"#!/bin/sh")
    os.chmod(tmp_path / "d" / "run.sh", 0o750)
    os.symlink("run.sh", tmp_path / "d" / "link")
    os.symlink("/etc/passwd", tmp_path / "d" / "out")
    inv = object_inventory(spark, str(tmp_path), content=True, folders=True).withColumn("owner", F.lit("u"))
    rows = {r.path: r for r in unpack_archives(pack_archives(inv)).collect()}
    assert (rows["d/run.sh"].kind, rows["d/run.sh"].mode, bytes(rows["d/run.sh"].content)) == ("file", 0o750, b"#!/bin/sh")
    assert (rows["d/link"].kind, rows["d/link"].link_target) == ("link", "run.sh")
    assert rows["d/void"].kind == "folder"
    assert rows["materials_u.tar.gz/d/out"]._error == "unsafe member path"


def test_hard_links_are_files_and_other_members_errors(spark, tmp_path):
    import os

    (tmp_path / "home" / ".skip").mkdir(parents=True)
    (tmp_path / "home" / ".skip" / "a").write_bytes(b"body")
    for name in ("b", "c"):
        os.link(tmp_path / "home" / ".skip" / "a", tmp_path / "home" / name)
    os.mkfifo(tmp_path / "home" / "pipe")
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tar:
        tar.add(tmp_path / "home", arcname="home")
        lost = tarfile.TarInfo("home/lost")
        lost.type, lost.linkname = tarfile.LNKTYPE, "home/nowhere"
        tar.addfile(lost)
        types = {m.name: m.type for m in tar.getmembers()}
    assert list(types.values()).count(tarfile.LNKTYPE) == 3
    df = spark.createDataFrame([("u", "f", 0, buf.getvalue())], "owner string, folder string, part int, archive binary")
    rows = {r.path: r for r in unpack_archives(df, exclude=(".skip",)).collect()}
    assert {p: bytes(r.content) for p, r in rows.items() if r.kind == "file"} == {"b": b"body", "c": b"body"}
    assert {p: r._error for p, r in rows.items() if r._error} == {
        "home/lost": "hard link without a file", "home/pipe": "member type is not restored"}


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_running_sum_whatever_the_plan(spark, reuse, adaptive):
    from pyspark.sql import Window

    from courier.operators import running_sum

    df = spark.range(20_000).selectExpr("id % 3 = 0 AS g", "pmod(xxhash64(id), 1000000007) AS o", "id % 17 AS v")
    conf = {"spark.sql.exchange.reuse": reuse, "spark.sql.adaptive.enabled": adaptive}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = running_sum(df, ["g"], ["o"], "v", "cum", partitions=16)
        w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
        assert got.exceptAll(df.withColumn("cum", F.sum("v").over(w))).count() == 0 and got.count() == 20_000
        assert "Python" not in got._jdf.queryExecution().toString() and "Pandas" not in got._jdf.queryExecution().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
