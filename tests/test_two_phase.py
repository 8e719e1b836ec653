import os

import pytest
from pyspark.sql import Row

from courier.plans import copy_objects
from courier.session import local_path, work_dir
from courier.sources import objects
from courier.sources.objects import ObjectsWriter, recover_objects
from courier.sources.tree import STAGING


def held(root):
    out = {}
    for folder, _, names in os.walk(root):
        for n in names:
            path = os.path.join(folder, n)
            if STAGING not in path:
                out[os.path.relpath(path, root)] = open(path, "rb").read()
    return out


def test_a_failing_task_leaves_every_old_object(spark):
    target = work_dir(spark, "two_phase")
    root = local_path(target)
    old = spark.createDataFrame([(f"f{i}", b"old", "p") for i in range(8)], "key string, content binary, branch string")
    copy_objects(old, target, owner_col="branch", prefix="x")
    before = held(root)
    assert len(before) == 8 and set(before.values()) == {b"old"}
    new = spark.createDataFrame([(f"f{i}", b"new" if i < 7 else None, "p") for i in range(8)], old.schema).repartition(4)
    with pytest.raises(Exception, match="no body"):
        copy_objects(new, target, owner_col="branch", prefix="x")
    assert held(root) == before and not os.path.exists(f"{root}/{STAGING}")
    copy_objects(new.where("content IS NOT NULL"), target, owner_col="branch", prefix="x")
    assert sorted(held(root).values()) == [b"new"] * 7 + [b"old"]


def test_a_commit_that_dies_is_finished(tmp_path, monkeypatch):
    root = str(tmp_path)
    (tmp_path / "a").write_bytes(b"old")
    writer = ObjectsWriter({"path": root})
    parts = [writer.write(iter([Row(key=f"{c}{i}" if i else c, content=b"new") for i in range(5)])) for c in "ab"]
    writer.write(iter([Row(key="a", content=b"of an attempt that did not count")]))
    assert held(root) == {"a": b"old"}
    real, calls = os.replace, []

    def replace(src, dst):
        calls.append(dst)
        if len(calls) > 4:
            raise OSError("lost")
        real(src, dst)

    monkeypatch.setattr(os, "replace", replace)
    with pytest.raises(OSError):
        writer.commit(parts)
    writer.abort(parts)
    monkeypatch.undo()
    assert 0 < sum(b == b"new" for b in held(root).values()) < 10
    assert recover_objects(root) == 1
    assert held(root) == {f"{c}{i}" if i else c: b"new" for c in "ab" for i in range(5)}
    assert recover_objects(root) == 0 and not os.path.exists(f"{root}/{STAGING}")


def test_abort_and_empty_writes(tmp_path):
    writer = ObjectsWriter({"path": str(tmp_path)})
    message = writer.write(iter([Row(key="x", content=b"1")]))
    assert recover_objects(str(tmp_path)) == 0  # staged, not committed: it may be running
    writer.abort([message])
    assert held(str(tmp_path)) == {} and not (tmp_path / STAGING).exists()
    empty = ObjectsWriter({"path": str(tmp_path)})
    empty.commit([empty.write(iter([]))])
    assert held(str(tmp_path)) == {} and objects.safe_key("a/b") and not objects.safe_key("../b")
