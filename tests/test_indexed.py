import random
import tarfile

import pytest
from pyspark.sql import functions as F

from courier.operators import unpack_archives
from courier.operators.indexed import missing_paths, pack_indexed, read_members, restore_paths
from courier.session import local_path, materialise, work_dir


@pytest.fixture(scope="module")
def bundle(spark):
    rnd = random.Random(3)
    files = {("u", f"d/{i:03d}"): rnd.randbytes(rnd.choice([0, 1, 511, 512, 513, 4000, 20_000])) for i in range(60)}
    files |= {("v.w", "big"): rnd.randbytes(300_000), ("v.w", "é" * 120): "é".encode() * 999, ("v.w", "z"): b"zero" * 5000}
    objects = spark.createDataFrame([(o, k, bytearray(b)) for (o, k), b in files.items()], "owner string, key string, content binary")
    folder = local_path(work_dir(spark, "indexed"))
    index = materialise(pack_indexed(objects, folder, block_bytes=4096, max_part_bytes=100_000), "index")
    return files, folder, index


def test_every_file_by_its_blocks(bundle):
    files, _, index = bundle
    rows = read_members(index).collect()
    assert {(r["owner"], r["path"]): bytes(r["content"]) for r in rows} == files and len(rows) == len(files)
    assert not [r["_error"] for r in rows if r["_error"]]


@pytest.mark.parametrize("start, size", [(0, 10), (0, 0), (700, 5000), (150_000, 1), (299_999, 100), (10**9, 5), (4096, None)])
def test_byte_ranges(bundle, start, size):
    files, _, index = bundle
    for r in read_members(index, start=start, size=size).collect():
        body = files[r["owner"], r["path"]]
        assert bytes(r["content"]) == body[start:None if size is None else start + size]
        want = len(r["content"])
        # whole blocks of 4 KB of random bytes: the range, and a block at each end at most
        assert r["bytes_read"] <= want + 2 * (4096 + 512 + 64) + want // 4096 * 64 + 1024


def test_archives_are_ordinary(spark, bundle):
    files, folder, index = bundle
    archives = index.select("owner", "folder", "part", "archive").distinct()
    members = unpack_archives(archives, path_col="archive").collect()
    assert {(r["owner"], r["path"]): bytes(r["content"]) for r in members} == files
    with tarfile.open(archives.first()["archive"], "r:gz") as tar:
        assert tar.getmembers()


def test_restore_by_path(spark, bundle):
    files, _, index = bundle
    wanted = spark.createDataFrame([("u", "d/007"), ("u", "d/007"), ("v.w", "z"), ("u", "z")], "owner string, path string")
    got = {(r["owner"], r["path"]): bytes(r["content"]) for r in restore_paths(index, wanted).collect()}
    assert got == {k: files[k] for k in [("u", "d/007"), ("v.w", "z")]}
    assert [tuple(r) for r in missing_paths(index, wanted).collect()] == [("u", "z")]


def test_damage_gives_an_error_row(spark, bundle, tmp_path):
    files, _, index = bundle
    row = index.where("path = 'big'").first()
    bad = tmp_path / "bad.tar.gz"
    data = bytearray(open(row["archive"], "rb").read())
    at = row["blocks"][10]["offset"]
    data[at + 20:at + 400] = bytes(380)
    bad.write_bytes(data[:row["blocks"][40]["offset"] + 9])
    index = index.where("path = 'big'").withColumn("archive", F.lit(str(bad)))
    assert read_members(index).first()["_error"]
    assert bytes(read_members(index, start=0, size=100).first()["content"]) == files["v.w", "big"][:100]  # its blocks are whole
    assert read_members(index.withColumn("archive", F.lit(str(tmp_path / "none")))).first()["_error"]
    assert read_members(index.limit(0)).count() == 0
