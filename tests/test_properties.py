"""Property checks on generated inputs (few examples each: every example runs Spark jobs)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from courier.operators import bundle_plan, pack_archives, running_sum, unpack_archives

SETTINGS = dict(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))

owners = st.sampled_from(["a", "b.c", "hot", "", "z"])
names = st.text(alphabet="abcxyz/._-é", min_size=1, max_size=12).filter(
    lambda s: not s.startswith("/") and "//" not in s and not s.endswith("/")
    and all(p not in ("", ".", "..") for p in s.split("/")))
files = st.lists(st.tuples(owners, names, st.binary(max_size=300)), min_size=1, max_size=60,
                 unique_by=lambda t: (t[0], t[1]))


@settings(**SETTINGS)
@given(files=files, part=st.integers(min_value=1, max_value=700), blocks=st.integers(min_value=1, max_value=6))
def test_pack_unpack_is_identity_and_parts_follow_the_plan(spark, files, part, blocks):
    df = spark.createDataFrame(files, "owner string, key string, content binary")
    bundles = pack_archives(df, "owner", max_part_bytes=part, partitions=blocks, exclude=())
    rows = bundles.collect()
    plan = (bundle_plan(df.withColumn("length", F.octet_length("content")), max_part_bytes=part)
            .groupBy("owner", "part").agg(F.count("*").alias("n"), F.sum("length").alias("b")).collect())
    assert sorted((r.owner, r.part, r.n_files, r.bytes) for r in rows) == sorted(tuple(r) for r in plan)
    back = unpack_archives(spark.createDataFrame(rows, bundles.schema), exclude=())
    got = sorted((r.owner, r.path, bytes(r.content)) for r in back.collect())
    assert got == sorted((o, k, bytes(c)) for o, k, c in files)


@settings(**SETTINGS)
@given(rows=st.lists(st.tuples(st.sampled_from(["g", "h", None, "k"]), st.integers(0, 10**6),
                               st.integers(0, 1000)), min_size=1, max_size=200, unique_by=lambda t: (t[0], t[1])),
       blocks=st.integers(min_value=1, max_value=9))
def test_running_sum_equals_the_window(spark, rows, blocks):
    df = spark.createDataFrame(rows, "g string, o bigint, v bigint")
    got = running_sum(df, ["g"], ["o"], "v", "cum", total="tot", partitions=blocks)
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("cum", F.sum("v").over(w)).withColumn("tot", F.sum("v").over(Window.partitionBy("g")))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, ref.collect())))


@settings(**SETTINGS)
@given(keys=st.lists(st.text(alphabet="ab_1.", min_size=0, max_size=8), min_size=1, max_size=40),
       owners=st.lists(st.text(alphabet="ab_1.", min_size=0, max_size=5), min_size=1, max_size=12, unique=True))
def test_suffix_lookup_equals_the_theta_join(spark, keys, owners):
    from courier.operators import fetch_user_archive

    objs = spark.createDataFrame([(f"p/{k}.tar.gz",) for k in keys] + [("q/x.tar.gz",)], "key string")
    own = spark.createDataFrame([(o,) for o in owners], "owner string")
    got = sorted(tuple(r) for r in fetch_user_archive(objs, own, prefix="p", match="suffix").collect())
    want = []
    for o in owners:
        s = o.replace(".", "_") + ".tar.gz"
        hits = sorted(k for k in (f"p/{k}.tar.gz" for k in keys) if k.endswith(s))
        hits = sorted(hits, key=lambda k: k.encode())
        if hits:
            want.append((o, hits[0]))
    assert got == sorted(want)


@settings(**SETTINGS)
@given(values=st.lists(st.integers(min_value=-(2 ** 62), max_value=2 ** 62), min_size=1, max_size=300))
def test_human_bytes_follows_the_python_rule(spark, values):
    from courier.functions import human_bytes
    from test_functions import exact_text

    df = spark.createDataFrame([(v,) for v in values], "n bigint")
    got = [(r.n, r.h) for r in df.select("n", human_bytes("n").alias("h")).collect()]
    assert all(h == exact_text(n) for n, h in got)
