"""Sorted runs: versions are whole, publishes write what they are given, compaction keeps the rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from courier.plans import runs
from courier.plans.runs import compact_runs, publish_run, read_runs, vacuum, version, versions
from courier.sources import store

SCHEMA = "bucket string, key string, ts int, delivery_id long, length long"


def rows(spark, items):
    return spark.createDataFrame([("b", k, i, i, v) for i, (k, v) in enumerate(items)], SCHEMA)


def keys(spark, names):
    return spark.createDataFrame([("b", n) for n in names], "bucket string, key string")


def held(spark, target, **kw):
    got = [(r["key"], r["length"]) for r in read_runs(spark, target, **kw).collect()]
    assert len(got) == len({k for k, _ in got})
    return dict(got)


@pytest.mark.parametrize("fanout, broadcast_bytes", [(None, 1 << 20), (None, 0), (2, 1 << 20), (3, 0)])
def test_equals_a_dictionary(spark, tmp_path, fanout, broadcast_bytes):
    rnd, want, target = random.Random(4), {}, str(tmp_path / "t")
    for step in range(6):
        writes = [(f"k{rnd.randrange(60)}", step * 100 + i) for i in range(rnd.choice([1, 5, 40]))]
        gone = [f"k{rnd.randrange(60)}" for _ in range(rnd.randrange(8))]
        publish_run(rows(spark, writes), target, deletes=keys(spark, gone) if gone else None, fanout=fanout)
        for k in gone:
            want.pop(k, None)
        want.update(dict(writes))
        if step % 3 == 2:
            assert held(spark, target, broadcast_bytes=broadcast_bytes) == want
    compact_runs(spark, target, everything=True)
    assert held(spark, target) == want and len(version(spark, target)["runs"]) == 1
    assert not spark.read.parquet(f"{target}/runs/{version(spark, target)['runs'][0]['name']}").where("_deleted").count()


def test_writes_what_it_is_given(spark, tmp_path):
    target = str(tmp_path / "t")
    publish_run(spark.range(200_000).selectExpr("'b' bucket", "concat('k', id) key", "1 ts", "id delivery_id", "id length"), target, fanout=None)
    before = store.folder_bytes(spark, target)
    small = publish_run(rows(spark, [("k7", 1), ("new", 2)]), target, fanout=None)
    assert store.folder_bytes(spark, target) - before < 30_000 < before
    assert small["runs"][-1]["rows"] == 2
    got = read_runs(spark, target)
    assert got.count() == 200_001 and got.where("key = 'k7'").first()["length"] == 1
    # the large run is filtered where it lies, not shuffled
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan


def test_runs_grow_by_tiers(spark, tmp_path):
    target, written = str(tmp_path / "t"), 0
    for i in range(20):
        publish_run(rows(spark, [(f"k{i}-{j}", j) for j in range(4)]), target, fanout=4)
    assert len(version(spark, target)["runs"]) <= 8
    assert len(held(spark, target)) == 80


@pytest.mark.parametrize("step", ["_write_run", "create_text"])
def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    target = str(tmp_path / "t")
    publish_run(rows(spark, [("a", 1), ("b", 2)]), target, fanout=None)
    real_write, real_create = runs._write_run, store.create_text

    def write(*a):
        real_write(*a)
        raise RuntimeError("lost")

    def create(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(*((runs, "_write_run", write) if step == "_write_run" else (store, "create_text", create)))
    with pytest.raises(RuntimeError):
        publish_run(rows(spark, [("a", 5)]), target, deletes=keys(spark, ["b"]), fanout=None)
    with pytest.raises(RuntimeError):
        compact_runs(spark, target, everything=True) if step == "create_text" and len(version(spark, target)["runs"]) > 1 else write(
            rows(spark, [("c", 1)]).withColumn("_deleted", F.lit(False)), target, ["bucket", "key"])
    monkeypatch.undo()
    assert held(spark, target) == {"a": 1, "b": 2} and versions(spark, target) == [1]
    publish_run(rows(spark, [("a", 5)]), target, deletes=keys(spark, ["b"]), fanout=None)
    assert held(spark, target) == {"a": 5}
    assert held(spark, target, number=1) == {"a": 1, "b": 2}
    assert len(vacuum(spark, target, older_than_s=-1)) >= 1  # the runs that no version lists
    assert held(spark, target) == {"a": 5}
    assert vacuum(spark, target, keep=1, older_than_s=-1) == [] and versions(spark, target) == [2]


def test_crash_in_compaction_and_lost_races(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    for i in range(3):
        publish_run(rows(spark, [("a", i), (f"k{i}", i)]), target, fanout=None)
    want = {"a": 2, "k0": 0, "k1": 1, "k2": 2}
    real = store.create_text
    raced = []

    def late(spark_, path, text):
        if not raced:  # another publisher is first with this number
            raced.append(path)
            monkeypatch.setattr(store, "create_text", real)
            publish_run(rows(spark, [("z", 9)]), target, fanout=None)
            monkeypatch.setattr(store, "create_text", late)
        return real(spark_, path, text)

    monkeypatch.setattr(store, "create_text", late)
    done = compact_runs(spark, target, everything=True)
    assert len(done["runs"]) == 2 and versions(spark, target) == [1, 2, 3, 4, 5]
    assert held(spark, target) == {**want, "z": 9}
    raced.clear()
    publish_run(rows(spark, [("y", 8)]), target, fanout=None)
    monkeypatch.undo()
    assert held(spark, target) == {**want, "z": 9, "y": 8}


def test_key_ranges_prune_runs(spark, tmp_path):
    target = str(tmp_path / "t")
    one = lambda names: spark.createDataFrame([(n, 1, 1) for n in names], "key string, ts int, delivery_id long")
    publish_run(one(["a", "b", "c"]), target, fanout=None)
    publish_run(one(["m", "n"]), target, fanout=None)
    publish_run(one(["x", "é", None]), target, fanout=None)
    got = read_runs(spark, target, first="m", last="n")
    assert sorted(r["key"] for r in got.collect()) == ["m", "n"]
    assert len({f.rsplit("/", 2)[-2] for f in got.inputFiles()}) == 1
    assert sorted(r["key"] or "" for r in read_runs(spark, target).collect()) == ["", "a", "b", "c", "m", "n", "x", "é"]
    assert [r["key"] for r in read_runs(spark, target, first="y").collect()] == ["é"]


def test_edge_cases(spark, tmp_path):
    target = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        read_runs(spark, target)
    assert publish_run(rows(spark, [("a", 1)]).limit(0), target)["number"] == 0
    publish_run(rows(spark, [("a", 1), ("a", 2)]), target)
    publish_run(None, target, deletes=keys(spark, ["a", "never"]))
    assert held(spark, target) == {}
    more = rows(spark, [("a", 3)]).withColumn("note", F.lit("n"))
    publish_run(more, target, deletes=keys(spark, ["a"]))
    assert [(r["key"], r["note"]) for r in read_runs(spark, target).collect()] == [("a", "n")]
    with pytest.raises(ValueError):
        publish_run(more.drop("bucket"), target)
    with pytest.raises(ValueError):
        publish_run(more.withColumn("length", F.lit("x")), target, fanout=None)
        read_runs(spark, target)
    assert os.path.isdir(target)
