import pytest
from courier.operators import endpoint_inventory, layered_settings, redact_presence
from courier.sources import kafka_options, s3a_conf, settings_from_env


def _resolve(spark, rows):
    df = spark.createDataFrame(rows, "scope string, name string, value string, layer int")
    return {(r.scope, r.name): (r.resolved, r.effective, r.source) for r in layered_settings(df).collect()}


def test_defaults_env_precedence(spark):
    got = _resolve(spark, [
        ("d", "kafka_bootstrap", None, 0), ("d", "schema_registry_url", None, 1),
        ("e", "kafka_bootstrap", "broker:9092", 1), ("e", "schema_registry_url", "http://sr:8081", 1),
        ("p", "kafka_bootstrap", "env-broker:9092", 1), ("p", "kafka_bootstrap", "override:9092", 0),
        ("bo", "kafka_bootstrap", "", 0), ("bo", "kafka_bootstrap", "e", 1),
        ("be", "kafka_bootstrap", "", 1),
    ])
    assert got[("d", "kafka_bootstrap")] == ("localhost:9092", "localhost:9092", None)
    assert got[("d", "schema_registry_url")] == ("", "", None)
    assert got[("e", "kafka_bootstrap")][0] == "broker:9092"
    assert got[("e", "schema_registry_url")][0] == "http://sr:8081"
    assert got[("p", "kafka_bootstrap")] == ("override:9092", "override:9092", 0)
    assert got[("bo", "kafka_bootstrap")] == ("e", "e", 1)
    assert got[("be", "kafka_bootstrap")] == ("", "localhost:9092", 1)


def test_driver_side_settings():
    s = settings_from_env({"KAFKA_BOOTSTRAP_SERVERS": "env-broker:9092", "COURSE_NAME": "c1", "GITHUB_REPO": "r"},
                          kafka_bootstrap="override:9092", github_repo="not taken")
    assert s["kafka_bootstrap"] == "override:9092" and s["course"] == "c1" and s["github_repo"] == "r"
    blank = settings_from_env({"KAFKA_BOOTSTRAP_SERVERS": ""})
    assert blank["kafka_bootstrap"] == "" and blank.effective["kafka_bootstrap"] == "localhost:9092"
    assert settings_from_env({"KAFKA_BOOTSTRAP_SERVERS": "e"}, kafka_bootstrap="")["kafka_bootstrap"] == "e"
    with pytest.raises(TypeError):
        settings_from_env({}, kafka_boostrap="misspelt")
    s = settings_from_env({}, aws_access_key_id="AKIATEST", aws_secret_access_key="s3cr3t", aws_region="eu-west-1")
    assert "s3cr3t" not in repr(s) and "AKIATEST" not in repr(s)
    conf = s3a_conf(s)
    assert conf["spark.hadoop.fs.s3a.access.key"] == "AKIATEST"
    assert conf["spark.hadoop.fs.s3a.endpoint.region"] == "eu-west-1"
    assert conf["spark.hadoop.fs.s3.impl"].endswith("S3AFileSystem")
    mixed = settings_from_env({"AWS_SECRET_ACCESS_KEY": "e"}, aws_access_key_id="o")
    assert s3a_conf(mixed)["spark.hadoop.fs.s3a.secret.key"] == "e"
    assert not any("key" in k for k in s3a_conf(settings_from_env({}, aws_access_key_id="only-key")))


def test_kafka_options():
    assert kafka_options(settings_from_env({}, kafka_bootstrap="")) == {"kafka.bootstrap.servers": "localhost:9092"}
    opts = kafka_options(settings_from_env({}, kafka_bootstrap="b:9093", kafka_sasl_username="u", kafka_sasl_password='p"w'))
    assert opts["kafka.security.protocol"] == "SASL_SSL" and opts["kafka.sasl.mechanism"] == "PLAIN"
    assert 'password="p\\"w"' in opts["kafka.sasl.jaas.config"]
    assert "kafka.sasl.jaas.config" not in kafka_options(settings_from_env({}, kafka_sasl_password="x"))


def test_redact_no_secret_text(spark):
    rows = [("c", "segretissimo", "AKIAPROVA", "eu", ""), ("d", None, "", "", "x")]
    df = spark.createDataFrame(rows, "scope string, aws_secret_access_key string, aws_access_key_id string, aws_region string, course string")
    out = redact_presence(df, ["aws_secret_access_key", "aws_access_key_id"]).collect()
    text = repr(out)
    assert "segretissimo" not in text and "AKIAPROVA" not in text
    assert out[0].has_aws_secret_access_key and out[0].course is None
    assert not out[1].has_aws_secret_access_key and not out[1].has_aws_access_key_id and out[1].aws_region is None


def test_endpoint_inventory_broker_list(spark):
    df = spark.createDataFrame([("a:1,b,c:9093,d:",), ("b:9092",)], "servers string")
    got = sorted((r.host, r.port, r.n) for r in endpoint_inventory(df, "servers").collect())
    assert got == [("a", 1, 1), ("b", 9092, 2), ("c", 9093, 1), ("d", 9092, 1)]


def test_unknown_setting_has_no_default_and_no_join(spark):
    df = spark.createDataFrame([("s", "custom", None, 0), ("s", "custom2", "v", 1)],
                               "scope string, name string, value string, layer int")
    res = layered_settings(df)
    got = {r.name: (r.resolved, r.effective) for r in res.collect()}
    assert got == {"custom": (None, None), "custom2": ("v", "v")}
    plan = res._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Join" not in plan


def test_credentials_per_field_and_complete_pairs(spark):
    from courier.operators import credential_pairs

    rows = [("a", "aws_access_key_id", "AKIATEST", 0), ("a", "aws_secret_access_key", "s3cr3t", 1),
            ("b", "aws_access_key_id", "only-key", 1), ("c", "aws_secret_access_key", "", 0),
            ("c", "aws_access_key_id", "k", 0)]
    layers = spark.createDataFrame(rows, "scope string, name string, value string, layer int")
    pairs = credential_pairs(layered_settings(layers)).collect()
    got = {r.scope: (r.has_key, r.has_secret, r.complete) for r in pairs}
    assert got == {"a": (True, True, True), "b": (True, False, False), "c": (True, False, False)}
    assert "s3cr3t" not in repr(pairs) and "AKIATEST" not in repr(pairs)


def test_settings_report_hides_secrets(spark):
    from courier.operators import settings_report

    rows = [("u1", "kafka_bootstrap", "broker:9092", 1), ("u1", "aws_secret_access_key", "segretissimo", 1),
            ("u1", "aws_access_key_id", "AKIAPROVA", 0), ("u1", "course", "", 0), ("u2", "course", "c2", 1)]
    layers = spark.createDataFrame(rows, "scope string, name string, value string, layer int")
    rep = settings_report(layered_settings(layers)).collect()
    text = repr(rep)
    assert "segretissimo" not in text and "AKIAPROVA" not in text
    by = {r.scope: r for r in rep}
    assert by["u1"].kafka_bootstrap == "broker:9092" and by["u1"].has_aws_secret_access_key
    assert by["u1"].course is None and by["u2"].course == "c2"
    assert by["u2"].kafka_bootstrap == "localhost:9092" and not by["u2"].has_aws_access_key_id
    assert by["u2"].schema_registry_url is None


def test_s3a_session_builder_conf():
    from courier.sources import s3a_session

    class Builder:
        def __init__(self):
            self.conf = {}

        def config(self, k, v):
            self.conf[k] = v
            return self

    b = s3a_session(Builder(), settings_from_env({}, aws_access_key_id="k", aws_secret_access_key="s", aws_region="eu-west-1"))
    assert b.conf["spark.hadoop.fs.s3a.access.key"] == "k" and b.conf["spark.sql.repl.eagerEval.enabled"] == "true"
    assert b.conf["spark.hadoop.fs.s3a.endpoint.region"] == "eu-west-1"


def test_url_endpoints(spark):
    from courier.operators import endpoints

    df = spark.createDataFrame([("https://user:pw@h1.example.com:8443/a?b=1,2",), ("http://h2/x",), ("mailto:x",),
                                ("s3a://bucket/key",)], "url string")
    got = sorted((r.host, r.port) for r in endpoints(df, "url", 443, url=True).collect())
    assert got == [("bucket", 443), ("h1.example.com", 8443), ("h2", 443)]
