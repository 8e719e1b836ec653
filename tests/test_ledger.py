import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from courier.operators import (SizeLimitExceeded, fetch_user_archive, key_collisions, latest_delivery,
                               missing_archives, running_sum, size_guard, transfer_progress)


def test_latest_delivery_tie_break(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("k1", t, 1, "a"), ("k1", t, 2, "b"), ("k1", t - dt.timedelta(days=1), 9, "c"), ("k2", t, 3, "d")]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, delivery_id bigint, v string")
    got = {r.key: r.v for r in latest_delivery(df).collect()}
    assert got == {"k1": "b", "k2": "d"}


def test_key_collisions_courses_and_slugs(spark):
    rows = [("b/m_x.tar.gz", "c1", "x"), ("b/m_x.tar.gz", "c2", "x"), ("b/m_a_b.tar.gz", "c1", "a.b"),
            ("b/m_a_b.tar.gz", "c1", "a_b"), ("b/m_y.tar.gz", "c1", "y")]
    df = spark.createDataFrame(rows, "key string, course string, owner string")
    got = {r.key: (r.n_courses, r.n_owners, r.n_writes) for r in key_collisions(df).collect()}
    assert got == {"b/m_x.tar.gz": (2, 1, 2), "b/m_a_b.tar.gz": (1, 2, 2)}


def test_size_guard_edges(spark):
    df = spark.createDataFrame([("a", 1024 * 1024), ("b", 3 * 1024 * 1024)], "owner string, length bigint")
    over = [r.owner for r in size_guard(df, ["owner"], "length", 1).collect()]
    assert over == ["b"]  # exactly 1 MiB passes (strict >)
    with pytest.raises(SizeLimitExceeded):
        size_guard(df, ["owner"], "length", 1, mode="fail")
    assert size_guard(df, ["owner"], "length", 3, mode="fail") is None
    assert size_guard(df, ["owner"], "length", 0).count() == 2  # 0 is a real limit


def test_suffix_loose_fixture(spark):
    objs = spark.createDataFrame([("b/x_mario_rossi.tar.gz",), ("b/x_rossi.tar.gz",), ("c/x_zed.tar.gz",)], "key string")
    owners = spark.createDataFrame([("rossi",), ("mario_rossi",), ("zed",)], "owner string")
    got = {r.owner: r.key for r in fetch_user_archive(objs, owners, prefix="b", match="suffix").collect()}
    assert got == {"rossi": "b/x_mario_rossi.tar.gz", "mario_rossi": "b/x_mario_rossi.tar.gz"}
    found = fetch_user_archive(objs, owners, prefix="b", match="suffix")
    assert [r.owner for r in missing_archives(owners, found).collect()] == ["zed"]


def test_suffix_explode_equals_theta_join_and_has_no_nested_loop(spark):
    rnd = random.Random(1)
    keys = [f"p/{rnd.choice(['m', 'mat'])}_{rnd.choice(['u', 'user_', ''])}{rnd.randint(0, 300)}.tar.gz" for _ in range(600)]
    keys += ["p/.tar.gz", "q/x_1.tar.gz", "p/x_1.zip"]
    objs = spark.createDataFrame([(k,) for k in keys], "key string")
    owners = spark.createDataFrame([(str(i),) for i in range(0, 320, 3)] + [("",), ("user.1",)], "owner string")
    got = fetch_user_archive(objs, owners, prefix="p", match="suffix")
    slugged = owners.withColumn("s", F.replace("owner", F.lit("."), F.lit("_")))
    theta = (slugged.join(objs.where(F.col("key").startswith("p/")),
                          F.expr("endswith(key, concat(s, '.tar.gz'))"))
             .groupBy("owner").agg(F.min("key").alias("key")))
    assert sorted(got.collect()) == sorted(theta.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_owner_match(spark):
    objs = spark.createDataFrame([("c/m_a.tar.gz", "a"), ("c/z_a.tar.gz", "a"), ("d/m_b.tar.gz", "b")], "key string, owner string")
    owners = spark.createDataFrame([("a",), ("b",), ("c",)], "owner string")
    got = {r.owner: r.key for r in fetch_user_archive(objs, owners, prefix="c").collect()}
    assert got == {"a": "c/m_a.tar.gz"}


def loop_milestones(chunks, step=10):
    """Replay of a byte counter that logs when the percentage passes the next step."""
    total = sum(chunks)
    done, last, out = 0, 0, []
    for i, n in enumerate(chunks):
        done += n
        if total:
            pct = int(done * 100 / total)
            if pct >= last + step:
                last = pct - (pct % step)
                out.append((i, pct, done))
    return out


def test_transfer_progress_equals_loop_replay(spark):
    rnd = random.Random(5)
    rows, want = [], []
    for t in range(6):
        chunks = [rnd.choice([0, 1, 5, 50, 400, 3000]) for _ in range(rnd.randint(1, 60))]
        if t == 5:
            chunks = [0, 0]
        rows += [(f"t{t}", i, n) for i, n in enumerate(chunks)]
        want += [(f"t{t}", i, pct, done) for i, pct, done in loop_milestones(chunks)]
    df = spark.createDataFrame(rows, "xfer string, seq bigint, n bigint")
    got = transfer_progress(df, ["xfer"], ["seq"], "n").select("xfer", "seq", "pct", "done").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_running_sum_skewed_group_spans_many_tasks(spark):
    rnd = random.Random(9)
    rows = [("hot", i, rnd.randint(0, 100)) for i in range(5000)] + \
           [(f"k{i % 50}", i, rnd.randint(0, 100)) for i in range(1000)] + [(None, i, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, o bigint, v bigint")
    got = running_sum(df, ["g"], ["o"], "v", "cum", total="tot", partitions=16)
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("cum", F.sum("v").over(w)).withColumn("tot", F.sum("v").over(Window.partitionBy("g")))
    assert got.exceptAll(ref.select(*got.columns)).count() == 0
    assert got.count() == df.count()


def test_suffix_rows_follow_the_slug_lengths(spark):
    objs = spark.createDataFrame([(f"p/m_user_{i}.tar.gz",) for i in range(40)], "key string")
    owners = spark.createDataFrame([("a" * 30,), ("user_7",), ("39",)], "owner string")
    got = fetch_user_archive(objs, owners, prefix="p", match="suffix")
    assert sorted((r.owner, r.key) for r in got.collect()) == [("39", "p/m_user_39.tar.gz"), ("user_7", "p/m_user_7.tar.gz")]
    assert "Subquery" in got._jdf.queryExecution().executedPlan().toString()


def test_stored_prefix_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "ledger")
    spark.createDataFrame([("p", "p/m_a.tar.gz", "a"), ("q", "q/m_a.tar.gz", "a")], "prefix string, key string, owner string").write.parquet(path)
    owners = spark.createDataFrame([("a",)], "owner string")
    got = fetch_user_archive(spark.read.parquet(path), owners, prefix="q", prefix_col="prefix")
    assert [r.key for r in got.collect()] == ["q/m_a.tar.gz"]
    assert "EqualTo(prefix,q)" in got._jdf.queryExecution().toString()


def test_running_sum_groups_across_small_arrow_batches(spark):
    rnd = random.Random(11)
    rows = [("hot", i, rnd.randint(0, 9)) for i in range(300)]
    rows += [(f"g{i % 7}", i, rnd.randint(0, 9)) for i in range(120)] + [(None, i, 2) for i in range(15)]
    df = spark.createDataFrame(rows, "g string, o bigint, v bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = running_sum(df, ["g"], ["o"], "v", "cum", total="tot", partitions=5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("cum", F.sum("v").over(w)).withColumn("tot", F.sum("v").over(Window.partitionBy("g")))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, ref.collect())))
    plan = running_sum(df, ["g"], ["o"], "v", "cum")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_transfer_progress_with_declared_total(spark):
    rows = [("t", i, 100, 1000) for i in range(5)]  # interrupted: 500 of 1000 bytes
    df = spark.createDataFrame(rows, "xfer string, seq bigint, n bigint, size bigint")
    got = [(r.seq, r.pct) for r in transfer_progress(df, ["xfer"], ["seq"], "n", total_col="size").orderBy("seq").collect()]
    assert got == [(0, 10), (1, 20), (2, 30), (3, 40), (4, 50)]


def test_key_collisions_approx_matches_exact_on_small_data(spark):
    rows = [(f"k{i % 7}", f"c{i % 3}", f"o{i % 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "key string, course string, owner string")
    exact = sorted(tuple(r) for r in key_collisions(df).collect())
    approx = sorted(tuple(r) for r in key_collisions(df, approx=True).collect())
    assert exact == approx and len(exact) == 7
