"""Connector options for Kafka and S3 (s3a), built from resolved settings.

The Kafka connector jar and hadoop-aws are not part of a plain PySpark install; these functions
build the options and hand them to ``spark.read`` / ``readStream`` / ``write``. Secrets go into
options only, never into a DataFrame column.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from ..operators.settings import CATALOGUE, CREDENTIAL_PAIR, SECRETS


class Resolved(dict):
    """Setting name → value, in two readings: the mapping itself lets a variable that is set to blank
    win over the default, ``effective`` passes over blanks in every layer. Shows no secret."""

    def __init__(self, values: Mapping[str, str], effective: Mapping[str, str]):
        super().__init__(values)
        self.effective = dict(effective)

    def __repr__(self) -> str:
        return repr({k: bool(v) if k in SECRETS else v for k, v in self.items()})


def settings_from_env(env: Mapping[str, str] | None = None, **overrides) -> Resolved:
    """The catalogue resolved for one scope, on the driver: the rule of :func:`layered_settings`
    over the layers override, environment, default."""
    env = os.environ if env is None else env
    layers = {name: [overrides.get(name) or None if may else None, env.get(variable), default]
              for name, variable, default, _, may in CATALOGUE}
    unknown = set(overrides) - set(layers)
    if unknown:
        raise TypeError(f"no such settings: {sorted(unknown)}")
    return Resolved({k: next(v for v in vs if v is not None) for k, vs in layers.items()},
                    {k: next((v for v in vs if v), vs[-1]) for k, vs in layers.items()})


def kafka_options(settings: Resolved) -> dict[str, str]:
    """Options of Spark's Kafka source/sink. Bootstrap passes over blanks down to the default; with a
    SASL user: PLAIN over SASL_SSL (a password without a user is ignored)."""
    opts = {"kafka.bootstrap.servers": settings.effective["kafka_bootstrap"]}
    if settings["kafka_sasl_username"]:
        quoted = {k: settings[f"kafka_sasl_{k}"].replace("\\", "\\\\").replace('"', '\\"') for k in ("username", "password")}
        opts["kafka.sasl.mechanism"] = "PLAIN"
        opts["kafka.security.protocol"] = "SASL_SSL"
        opts["kafka.sasl.jaas.config"] = ("org.apache.kafka.common.security.plain.PlainLoginModule required "
                                          + " ".join(f'{k}="{v}"' for k, v in quoted.items()) + ";")
    return opts


def kafka_read(spark, topic: str, settings: Resolved, *, stream: bool = True, **extra):
    reader = spark.readStream if stream else spark.read
    r = reader.format("kafka").options(**kafka_options(settings)).option("subscribe", topic)
    for k, v in extra.items():
        r = r.option(k, v)
    return r.load()


def kafka_write(df, topic: str, settings: Resolved, *, key_col: str = "key", checkpoint: str | None = None):
    """Rows out as JSON values keyed by ``key_col`` (one key stays in one Kafka partition)."""
    from pyspark.sql import functions as F

    out = df.select(F.col(key_col).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))
    opts = kafka_options(settings)
    if df.isStreaming:
        w = out.writeStream.format("kafka").options(**opts).option("topic", topic)
        if checkpoint:
            w = w.option("checkpointLocation", checkpoint)
        return w.start()
    out.write.format("kafka").options(**opts).option("topic", topic).save()
    return None


def s3a_conf(settings: Resolved) -> dict[str, str]:
    """Session conf so that ``s3://`` and ``s3a://`` paths read through S3A. The key pair counts only
    whole; without it the default credential chain of S3A is used."""
    conf = {
        "spark.hadoop.fs.s3.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
        "spark.hadoop.fs.s3a.multipart.threshold": "8M",
        "spark.hadoop.fs.s3a.attempts.maximum": "5",
    }
    pair = [settings.effective[name] for name in CREDENTIAL_PAIR]
    if all(pair):
        conf.update(zip(("spark.hadoop.fs.s3a.access.key", "spark.hadoop.fs.s3a.secret.key"), pair))
    if settings.effective["aws_region"]:
        conf["spark.hadoop.fs.s3a.endpoint.region"] = settings.effective["aws_region"]
    return conf


def s3a_session(builder, settings: Resolved, *, notebook: bool = True):
    """Apply :func:`s3a_conf` to a ``SparkSession.builder`` (works in classic and Connect mode);
    ``notebook`` also turns on eager evaluation so DataFrames render in a notebook."""
    conf = s3a_conf(settings)
    if notebook:
        conf["spark.sql.repl.eagerEval.enabled"] = "true"
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder


def s3a_read(spark, uri: str, fmt: str = "parquet", **options):
    """Read ``s3://`` or ``s3a://`` data (``s3://`` is mapped onto S3A by :func:`s3a_conf`)."""
    return spark.read.format(fmt).options(**options).load(uri)
