"""Publishing: write bundles or files under their delivery keys, with the size guard first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bundle import whole_body
from ..operators.keys import file_keys
from ..operators.ledger import MissingObjects, latest_delivery, size_guard
from ..session import materialise
from ..sources import objects as objects_sink
from ..sources import store
from .runs import publish_run, read_runs


def publish(deliveries: DataFrame, target: str, *, mode: str = "ledger", max_size_mb=None,
            group_cols: Sequence[str] | None = None, length_col: str = "length",
            observation=None, buckets: int = 256, deletes: DataFrame | None = None) -> DataFrame:
    """Write deliveries (rows already carrying ``key``) to ``target`` and return what is current.

    A key is identified with its bucket: columns ``bucket`` (if there is one) and ``key``.

    * ``ledger`` (default): append; the current state is :func:`latest_delivery` of the ledger, so no
      version is lost and no small per-key folders are made.
    * ``replace``: a write to a key replaces it (and within one call the latest row of a key wins).
      The rows need ``ts`` and ``delivery_id``. The table is partitioned by ``buckets`` hashes of the
      key, so it has a bounded number of folders however many owners there are; the hashes that the
      new rows touch are merged with what is stored and replaced by dynamic partition overwrite. The
      number of hashes is stored with the table; another ``buckets`` than the stored one is refused.
    * ``merge``: a write to a key replaces it, and ``deletes`` (rows with the key columns) removes keys,
      as sorted runs that are merged when read (:mod:`runs`): what a publish writes is as large as its
      input. Needs the same columns.

    ``max_size_mb`` runs the size guard on each delivery of a key as its own action before anything is
    written and raises :class:`SizeLimitExceeded`. A failed write raises (job failure).
    """
    identity = key_columns(deliveries)
    if max_size_mb is not None:
        one = list(group_cols) if group_cols else [*identity, *[c for c in ("delivery_id",) if c in deliveries.columns]]
        size_guard(deliveries, one, length_col, max_size_mb, mode="fail")
    df = deliveries if observation is None else deliveries.observe(
        observation, F.sum(length_col).cast("bigint").alias("bytes"), F.count(F.lit(1)).alias("files"))
    if mode == "ledger":
        df.write.mode("append").parquet(target)
        return current(deliveries.sparkSession, target)
    if mode not in ("replace", "merge"):
        raise ValueError("mode must be 'ledger', 'replace' or 'merge'")
    if not {"ts", "delivery_id"} <= set(deliveries.columns):
        raise ValueError(f"mode='{mode}' needs ts and delivery_id to tell which row of a key is the last")
    spark = deliveries.sparkSession
    if mode == "merge":
        publish_run(df, target, deletes=deletes, keys=identity)
        return read_runs(spark, target)
    _check_buckets(spark, target, buckets)
    # last write wins inside one publish too: one row per key (pre-aggregated, skew-safe)
    new = materialise(latest_delivery(df, identity).withColumn(
        "_bucket", F.pmod(F.xxhash64(*identity), F.lit(buckets)).cast("int")), "publish")
    try:
        stored = spark.read.schema(new.schema).parquet(target)
        kept = stored.join(new.select("_bucket").distinct(), "_bucket", "left_semi")
        cond = [kept[c].eqNullSafe(new[c]) for c in identity]
        kept = kept.join(new.select(*identity), cond, "left_anti")
        out = materialise(kept.select(*new.columns).unionByName(new), "publish")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        out = new
    (out.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("_bucket").parquet(target))
    return spark.read.schema(new.schema).parquet(target).drop("_bucket")


def _check_buckets(spark, target: str, buckets: int) -> None:
    """The number of hashes is fixed with the first write: under another one a key would lie in two folders."""
    path = f"{target.rstrip('/')}/_buckets"
    if not store.create_text(spark, path, str(buckets)) and (stored := int(store.read_text(spark, path))) != buckets:
        raise ValueError(f"{target}: the table has {stored} buckets, not {buckets}")


def key_columns(deliveries: DataFrame) -> list[str]:
    """What identifies a delivered object: its bucket, if the rows name one, and its key."""
    return [c for c in ("bucket", "key") if c in deliveries.columns]


def current(spark, target: str, key_cols: Sequence[str] | None = None) -> DataFrame:
    """The current row of every (bucket, key) in an append-only ledger."""
    rows = spark.read.parquet(target)
    return latest_delivery(rows, key_cols or key_columns(rows))


class KeyCollision(RuntimeError):
    """Several objects would be written under one key; nothing was written."""


def copy_objects(objects: DataFrame, target: str, *, name_col: str = "key", owner_col: str = "owner",
                 prefix=None, branch_col: str = "branch", key=None, bucket=None,
                 content_col: str = "content", requested: DataFrame | None = None,
                 source_root: str | None = None) -> DataFrame:
    """Write each object as is (no compression) under its file key; return ``(key, uri, length)``.

    With ``source_root`` the objects are files under that folder (an inventory: ``name_col`` is the
    relative path, ``length`` its size) and each task copies them by path, streamed, so no body
    passes through a column and files of any size are copied.

    ``requested`` (a column ``name_col``) lists what must exist: a missing object or a directory
    raises :class:`MissingObjects` before anything is written (anti join, one action). A write that fails
    leaves every object of the target as it was. Objects whose
    keys agree raise :class:`KeyCollision` (:func:`copy_collisions` lists them), a body that could not
    be read fails the job.
    """
    by_path = source_root is not None
    if requested is not None:
        present = objects if by_path else objects.where(F.col(content_col).isNotNull())
        if by_path and "is_link" in objects.columns:
            present = present.where(~F.coalesce(F.col("is_link"), F.lit(False)))
        missing = requested.join(present.select(name_col).distinct(), name_col, "left_anti")
        gone = missing.limit(5).collect()
        if gone:
            raise MissingObjects("not regular files: " + ", ".join(r[name_col] for r in gone))
    keyed = file_keys(objects.withColumn("_src", F.col(name_col)), name_col=name_col, owner_col=owner_col,
                      prefix=prefix, branch_col=branch_col, key=key, bucket=bucket)
    clash = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if clash:
        raise KeyCollision("several objects would be written as: " + ", ".join(str(r.key) for r in clash))
    objects_sink.register(objects.sparkSession)
    objects_sink.recover_objects(target)  # an earlier write that died while it was put in place
    if by_path:
        (keyed.select("key", F.col("_src").alias("src"))
              .write.format("courier_objects").mode("append").option("source_root", source_root).save(target))
        size = F.col("length").cast("bigint")
    else:
        (keyed.select("key", whole_body(keyed, content_col).alias("content"))
              .write.format("courier_objects").mode("append").save(target))
        size = F.octet_length(content_col).cast("bigint")
    cols = ["key", size.alias("length")]
    if bucket is not None:
        cols.insert(1, "uri")
    return keyed.select(*cols)


def copy_collisions(objects: DataFrame, *, name_col: str = "key", owner_col: str = "owner", prefix=None,
                    branch_col: str = "branch", key=None) -> DataFrame:
    """Keys that several objects would be written under: ``(key, n_objects, first_name, last_name)``."""
    keyed = file_keys(objects.withColumn("_src", F.col(name_col)), name_col=name_col, owner_col=owner_col,
                      prefix=prefix, branch_col=branch_col, key=key)
    return (keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_objects"), F.min("_src").alias("first_name"),
                                     F.max("_src").alias("last_name")).where("n_objects > 1"))
