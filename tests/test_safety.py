"""Nothing is shown, lost or mixed up without a word: the probes of earlier reviews."""

import pytest
from pyspark.sql import functions as F

from courier.operators import redact_presence, settings_report, size_guard
from courier.operators.settings import layered_settings
from courier.operators.settings import nested_lookup


def test_secret_names_ignore_case_and_must_exist(spark):
    df = spark.createDataFrame([("u", "s3cret")], "user string, password string")
    assert redact_presence(df, ["Password"]).first().asDict() == {"user": "u", "has_password": True}
    with pytest.raises(ValueError, match="pasword"):
        redact_presence(df, ["pasword"])


def test_strict_lookup_names_the_path_only(spark):
    df = spark.createDataFrame([('{"password":"hunter2","n":"x","z":null}',)], "doc string")
    for path, kind in (("user.name", "string"), ("n", "int")):
        with pytest.raises(Exception) as e:
            nested_lookup(df, "doc", path, kind, strict=True, out="o").collect()
        assert "hunter2" not in str(e.value).split("JVM stacktrace")[0] and path in str(e.value)
    assert nested_lookup(df, "doc", "z", "string", strict=True, out="o").first().o is None
    with pytest.raises(Exception, match="missing key"):
        nested_lookup(spark.createDataFrame([(None,)], "doc string"), "doc", "a", strict=True).collect()


def test_size_guard_without_limit_keeps_the_columns(spark):
    df = spark.createDataFrame([("a", "b", 5)], "x string, y string, length bigint")
    none = size_guard(df, ["x", "y"], "length", None)
    assert none.columns == ["x", "y", "total_bytes"] and none.count() == 0


def test_credentials_say_where_they_come_from(spark):
    rows = [("a", "aws_access_key_id", "k", 0), ("a", "aws_secret_access_key", "s", 1), ("b", "aws_access_key_id", "k", 0),
            ("c", "course", "x", 0)]
    res = layered_settings(spark.createDataFrame(rows, "scope string, name string, value string, layer int"))
    got = {r.scope: r.credentials for r in settings_report(res).collect()}
    assert got == {"a": "source", "b": "default-chain", "c": "default-chain"}
    assert not any("s" == v for r in settings_report(res).collect() for v in r.asDict().values())
