import os

from pyspark.sql import functions as F

from courier.operators import exclude_paths, list_objects, object_preview, pack_archives, tree_stats, unpack_archives
from courier.sources import binary_inventory, object_inventory


def _write(root, files):
    for rel, body in files.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body if isinstance(body, bytes) else body.encode())


def test_tree_small(spark, tmp_path):
    _write(tmp_path, {"a.txt": "12345", ".ipynb_checkpoints/j.txt": "zzz"})
    r = tree_stats(object_inventory(spark, str(tmp_path))).first()
    assert (r.total_bytes, r.n_files) == (5, 1)


def test_tree_missing(spark, tmp_path):
    r = tree_stats(object_inventory(spark, str(tmp_path / "nope"))).first()
    assert (r.total_bytes, r.n_files) == (0, 0)


def test_tree_hidden_names_and_links(spark, tmp_path):
    _write(tmp_path, {"__init__.py": "x", ".bashrc": "yy", "_c=d.txt": "z", "a=b.txt": "w", "d/__pycache__": "f"})
    os.symlink(tmp_path / ".bashrc", tmp_path / "link")
    inv = object_inventory(spark, str(tmp_path))
    rows = {r.key: r for r in inv.collect()}
    assert set(rows) == {"__init__.py", ".bashrc", "_c=d.txt", "a=b.txt", "d/__pycache__", "link"}
    assert rows["link"].is_link and not rows[".bashrc"].is_link
    # size-up rule counts a file named __pycache__, the bundle rule does not; links never count
    assert tree_stats(inv, mode="directory").first().n_files == 5
    assert tree_stats(inv, mode="component").first().n_files == 4
    # Spark's own listing loses the hidden names
    fast = {r.key for r in binary_inventory(spark, str(tmp_path)).collect()}
    assert "__init__.py" not in fast and ".bashrc" not in fast


def test_exclusion_modes(spark):
    keys = ["a/.ipynb_checkpoints/x", "a/__pycache__/y.pyc", "b/__pycache__", "c/my.ipynb_checkpoints.txt", "ok.txt"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    comp = {r.key for r in exclude_paths(df, mode="component").collect()}
    dirs = {r.key for r in exclude_paths(df, mode="directory").collect()}
    sub = {r.key for r in exclude_paths(df, names=(".ipynb_checkpoints",), mode="substring").collect()}
    assert comp == {"c/my.ipynb_checkpoints.txt", "ok.txt"}
    assert dirs == {"b/__pycache__", "c/my.ipynb_checkpoints.txt", "ok.txt"}
    assert sub == {"a/__pycache__/y.pyc", "b/__pycache__", "ok.txt"}


def test_tree_bundle(spark, tmp_path):
    root = tmp_path / "materials"
    _write(root, {"a.txt": "hello", "sub/b.txt": "world!!", ".ipynb_checkpoints/junk": "nope",
                  "__pycache__/x.pyc": "nope"})
    inv = object_inventory(spark, str(root), content=True).withColumn("owner", F.lit("u"))
    bundles = pack_archives(inv, "owner", folder="materials").collect()
    assert len(bundles) == 1 and bundles[0].bytes == 12 and bundles[0].name == "materials_u.tar.gz"
    import io
    import tarfile

    with tarfile.open(fileobj=io.BytesIO(bundles[0].archive)) as tar:
        names = tar.getnames()
    assert names == ["materials_u.tar.gz/a.txt", "materials_u.tar.gz/sub/b.txt"]
    members = {r.path: r.content for r in unpack_archives(spark.createDataFrame(bundles)).collect()}
    assert members == {"a.txt": b"hello", "sub/b.txt": b"world!!"}


def test_list_objects_plan_and_order(spark, tmp_path):
    keys = ["B", "a", "a-b", "a/b", "é", "x/1", "a/c"]
    df = spark.createDataFrame([(k, 1) for k in keys], "key string, length bigint")
    assert [r.key for r in list_objects(df, "", 10).collect()] == sorted(keys, key=lambda k: k.encode())
    assert [r.key for r in list_objects(df, "a/", 1).collect()] == ["a/b"]
    path = str(tmp_path / "inv")
    df.write.parquet(path)
    plan = list_objects(spark.read.parquet(path), "a/", 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "StringStartsWith(key,a/)" in plan


def test_preview_of_binary_drops_cut_characters(spark):
    bodies = ["héllo wörld".encode(), b"\xff\xfeabc", "€€€".encode(), b""]
    df = spark.createDataFrame([(b,) for b in bodies], "content binary")
    got = [r.head for r in object_preview(df, "content", 4).collect()]
    assert got == [b[:4].decode("utf-8", errors="ignore") for b in bodies]


def test_tree_split_spreads_one_big_directory(spark, tmp_path):
    from courier.sources.tree import TreeReader

    files = {f"home/u/d{i:03d}/f{j}.txt": "x" * j for i in range(120) for j in range(3)}
    files.update({"home/top.txt": "t", "home/u/mid.txt": "mm", "other/z.txt": "zzz"})
    _write(tmp_path, files)
    assert len(TreeReader({"path": str(tmp_path), "partitions": "8"}).partitions()) == 8
    for budget in (1, 5, 60, 200):  # the driver reads only so many entries, whatever it then has to deal out
        parts = TreeReader({"path": str(tmp_path), "partitions": "8", "plan_entries": str(budget)}).partitions()
        assert len(parts) == 8
        keys = [r[0] for p in parts for r in TreeReader({"path": str(tmp_path), "partitions": "8", "plan_entries": str(budget)}).read(p)]
        assert sorted(keys) == sorted(files)
    inv = object_inventory(spark, str(tmp_path), partitions=8)
    got = {r.key: r.length for r in inv.collect()}
    assert got == {k: len(v) for k, v in files.items()}
    only = {r.key for r in object_inventory(spark, str(tmp_path), prefix="home/u/d00").collect()}
    assert only == {f"home/u/d00{i}/f{j}.txt" for i in range(10) for j in range(3)}


def test_preview_keeps_genuine_replacement_character(spark):
    bodies = ["a�b".encode() + b"\xff", "ok".encode(), b"\xe2\x82"]
    df = spark.createDataFrame([(b,) for b in bodies], "content binary")
    got = [r.head for r in object_preview(df, "content", 10).collect()]
    assert got == [b[:10].decode("utf-8", errors="ignore") for b in bodies]


def test_sizes_do_not_read_bodies(spark, tmp_path):
    _write(tmp_path, {"a/x.txt": "12345", "b/y.txt": "1"})
    stats = tree_stats(binary_inventory(spark, str(tmp_path)))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    read_schema = [l for l in plan.splitlines() if "ReadSchema" in l or "FileScan" in l]
    assert read_schema and not any("content" in l for l in read_schema)
    r = stats.first()
    assert (r.total_bytes, r.n_files) == (6, 2)


def test_preview_reads_only_the_first_bytes_of_files(spark, tmp_path):
    body = ("é" * 600).encode()  # 1200 bytes, two per character
    _write(tmp_path, {"a.txt": body, "b.bin": b"\xff" * 50})
    inv = object_inventory(spark, str(tmp_path), max_bytes=9)
    assert "content" not in inv.columns
    rows = {r.key: r for r in object_preview(inv, "head", 9, out="text").collect()}
    assert len(rows["a.txt"].head) == 9 and rows["a.txt"].length == 1200
    assert rows["a.txt"].text == body[:9].decode("utf-8", errors="ignore") == "éééé"
    assert rows["b.bin"].text == ""


def test_unreadable_bodies_are_rows_with_an_error(tmp_path, monkeypatch):
    from courier.sources.tree import TreeReader

    _write(tmp_path, {"locked.txt": "secret", "open.txt": "x"})
    real = open

    def deny(path, *args, **kw):
        if str(path).endswith("locked.txt"):
            raise PermissionError(13, "Permission denied")
        return real(path, *args, **kw)

    monkeypatch.setattr("builtins.open", deny)
    reader = TreeReader({"path": str(tmp_path), "content": "true", "partitions": "2"})
    rows = {r[0]: (r[7], r[9]) for p in reader.partitions() for r in reader.read(p)}
    assert rows == {"locked.txt": (None, "locked.txt: Permission denied"), "open.txt": (b"x", None)}


def test_schemes(spark, tmp_path):
    import pytest

    _write(tmp_path, {"d/a.txt": "12345", ".hidden": "x"})
    assert {r.key for r in object_inventory(spark, f"file:{tmp_path}").collect()} == {"d/a.txt", ".hidden"}
    fast = binary_inventory(spark, f"file:{tmp_path}", content=True).first()
    assert (fast.key, fast.length, bytes(fast.content)) == ("d/a.txt", 5, b"12345")
    for uri in ("s3a://bucket/prefix", "nosuch://bucket/x"):  # no connector here: an error, not an empty listing
        with pytest.raises(Exception):
            object_inventory(spark, uri).count()


def test_prune_skips_directories_while_listing(spark, tmp_path):
    _write(tmp_path, {"a.txt": "12345", ".ipynb_checkpoints/j.txt": "zzz", "sub/__pycache__/x.pyc": "p",
                      "sub/b.txt": "bb", "sub/__pycache__file": "f"})
    pruned = object_inventory(spark, str(tmp_path), prune=("__pycache__", ".ipynb_checkpoints"))
    assert {r.key for r in pruned.collect()} == {"a.txt", "sub/b.txt", "sub/__pycache__file"}
    full = tree_stats(object_inventory(spark, str(tmp_path))).first()
    assert tuple(tree_stats(pruned).first()) == tuple(full) == (8, 3)
