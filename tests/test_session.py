import pytest

from courier import session
from courier.session import local_path, materialise, work_dir


def test_only_file_paths_are_local():
    assert local_path("/a/b") == local_path("file:/a/b") == local_path("file:///a/b") == "/a/b"
    assert local_path("rel/a:b") == "rel/a:b"
    for uri in ("s3a://b/k", "hdfs:/x", "viewfs://store/in", "S3://b"):
        with pytest.raises(ValueError):
            local_path(uri)


def test_materialised_rows_do_not_change(spark):
    df = materialise(spark.range(100).selectExpr("id", "rand() AS r"), "t")
    assert df.agg({"r": "sum"}).first() == df.agg({"r": "sum"}).first() and df.schema["id"].dataType.simpleString() == "bigint"


def test_work_dir_is_fresh_and_under_the_checkpoint_folder(spark):
    a, b = work_dir(spark, "x"), work_dir(spark, "x")
    assert a != b and a.startswith(spark.sparkContext.getCheckpointDir().rstrip("/"))


def test_work_dir_refuses_a_local_folder_on_a_cluster(monkeypatch):
    class FakeContext:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class FakeConf:
        def get(self, key, default=None):
            return default

    class FakeSession:
        conf = FakeConf()

    monkeypatch.setattr(session, "_context", lambda spark: FakeContext())
    with pytest.raises(RuntimeError):
        work_dir(FakeSession(), "x")
