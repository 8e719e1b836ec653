"""Deliver and restore whole bundles: archives as objects, a Parquet manifest that names them.

``deliver``: drop junk → plan the parts → pack every owner's files; the task that packs an archive
writes it as an object under a staging name → refuse owners whose compressed bundle is over the limit →
rename the objects into place, ``<store>/objects/<bucket>/<delivery id>-<time>/<key>`` (``…part-N.tar.gz``
if the bundle has several) → write the manifest rows of this delivery. Every delivery has a folder of its
own, so it never changes an object that an older manifest row names: until its rows are written readers
see the delivery before whole, and a delivery that fails leaves that as it is. Bodies of archives never pass through
a table or a shuffle. A bundle is identified by (bucket, key): two owners whose slugs give one key
are refused before anything is written. ``current_bundles`` gives the parts of the latest delivery of
every (bucket, key); ``restore_bundles`` unpacks them for a set of owners, each archive opened by the
task that unpacks it, and reports the owners that have none.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import col_or_lit, join_key, slug
from ..operators.bundle import DEFAULT_PART_BYTES, BundleError, stage_archives, unpack_archives
from ..operators.inventory import DEFAULT_EXCLUDE
from ..operators.ledger import missing_archives, size_guard
from ..session import local_path, materialise, ship_package
from ..sources.objects import clear_stage
from ..sources.tree import STAGING

def _place(batches):
    """Rename staged objects to their keys: a target is replaced whole or not at all."""
    import os

    import pandas as pd

    for pdf in batches:
        for staged, path in zip(pdf["staged"], pdf["path"]):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            if os.path.exists(staged):  # a repeated task finds it already in place
                os.replace(staged, path)
            elif not os.path.exists(path):
                raise FileNotFoundError(path)
        yield pd.DataFrame({"n": [len(pdf)]})


def deliver(objects: DataFrame, store: str, bucket: str, *, owner_col: str = "owner", key_col: str = "key",
            content_col: str = "content", folder: str = "materials", path_col: str | None = None, prefix=None,
            branch: str | None = None, max_size_mb=None, max_part_bytes: int = DEFAULT_PART_BYTES,
            exclude=DEFAULT_EXCLUDE, delivery_id: int | None = None, source_root: str | None = None) -> DataFrame:
    """Bundle and deliver every owner's files; returns ``(owner, bucket, key, parts, bytes)``.

    With ``source_root`` the objects are files under that folder, read once by the task that packs
    them; else rows carry their body in ``content_col``.

    ``store`` is a folder on a mount that every executor sees. ``prefix=None`` puts the bundle under
    ``branch``; ``prefix=""`` at the bucket root. A bundle over ``max_size_mb`` (compressed, strict
    ``>``) raises :class:`SizeLimitExceeded` and nothing of this delivery stays.
    """
    spark = objects.sparkSession
    ship_package(spark)
    root = local_path(store).rstrip("/")
    did = delivery_id if delivery_id is not None else time.time_ns() // 1000
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    clash = (objects.select(owner.alias("o")).distinct().groupBy(slug(F.col("o")).alias("s"))
             .agg(F.min("o").alias("a"), F.max("o").alias("b")).where("a <> b").limit(5).collect())
    if clash:
        raise BundleError("owners that would write one key: " + "; ".join(f"{r.a}, {r.b}" for r in clash))
    attempt = f"{did}-{time.time_ns()}"
    stage, placed, whole = f"{root}/{STAGING}/{attempt}", f"{root}/objects/{bucket}/{attempt}", False
    try:
        archives = stage_archives(objects, stage, owner_col, key_col=key_col, content_col=content_col, folder=folder,
                                  path_col=path_col, max_part_bytes=max_part_bytes, exclude=exclude, source_root=source_root)
        staged = materialise(archives, "staged_archives")
        if max_size_mb is not None:
            size_guard(staged, ["owner", "folder"], "compressed", max_size_mb, mode="fail")
        pre = col_or_lit(branch or "") if prefix is None else col_or_lit(prefix)
        parts = staged.groupBy(F.col("owner").alias("_o"), F.col("folder").alias("_f")).agg(F.count(F.lit(1)).alias("n_parts"))
        rows = staged.join(parts, (F.col("owner") == F.col("_o")) & (F.col("folder") == F.col("_f"))).drop("_o", "_f")
        key = join_key(pre, F.col("name"))
        stem = F.expr("substring(key, 1, char_length(key) - 7)")
        rows = rows.withColumn("key", key).withColumn("object_key", F.when(F.col("n_parts") == 1, F.col("key")).otherwise(
            F.concat(stem, F.lit(".part-"), F.col("part").cast("string"), F.lit(".tar.gz"))))
        rows = rows.withColumn("path", F.concat(F.lit(f"{placed}/"), F.col("object_key")))
        # an action of its own: the manifest names nothing that is not in place
        rows.select("staged", "path").mapInPandas(_place, "n bigint").agg(F.sum("n")).first()
        manifest = rows.select(F.lit(bucket).alias("bucket"), pre.alias("prefix"), "folder", "owner", "key", "object_key",
                               "path", "part", "n_parts", "n_files", "bytes", "compressed",
                               F.localtimestamp().alias("ts"), F.lit(did).cast("bigint").alias("delivery_id"))
        target = f"{store.rstrip('/')}/manifest"
        (manifest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("delivery_id").parquet(target))
        whole = True
    finally:
        clear_stage(stage)
        if not whole:  # no manifest row names them
            clear_stage(placed)
    return (spark.read.schema(manifest.schema).parquet(f"{target}/delivery_id={did}").groupBy("owner", "bucket", "key")
            .agg(F.count(F.lit(1)).alias("parts"), F.sum("compressed").alias("bytes")))


def manifest(spark, store: str) -> DataFrame:
    """One row per archive of every delivery."""
    return spark.read.parquet(f"{store.rstrip('/')}/manifest")


def current_bundles(spark, store: str) -> DataFrame:
    """The manifest rows of the latest delivery (by ts, then delivery id) of every (bucket, key)."""
    rows = manifest(spark, store)
    latest = rows.groupBy("bucket", "key").agg(F.max_by("delivery_id", F.struct("ts", "delivery_id")).alias("delivery_id"))
    return rows.join(latest, ["bucket", "key", "delivery_id"], "left_semi")


def restore_bundles(spark, store: str, owners: DataFrame, *, bucket: str | None = None, prefix: str | None = None,
                    owner_col: str = "owner", exclude=(".ipynb_checkpoints",)):
    """Members of every requested owner's first current bundle in key order (all its parts), and the
    owners without one. Only manifest rows are joined; tasks open the archives they unpack."""
    rows = current_bundles(spark, store)
    if bucket is not None:
        rows = rows.where(F.col("bucket") == bucket)
    if prefix is not None:
        rows = rows.where(F.col("prefix") == prefix)
    first = rows.groupBy("owner").agg(F.min(F.struct("key", "bucket")).alias("_at"))
    wanted = owners.select(F.col(owner_col).alias("owner")).distinct()
    found = first.join(wanted, "owner", "left_semi").select("owner", "_at.key", "_at.bucket")
    chosen = rows.join(found, ["owner", "key", "bucket"], "left_semi").select("owner", "folder", "part", "path")
    # an archive per row: spread them, whatever few files the manifest has
    members = unpack_archives(chosen.repartition("owner", "folder", "part"), path_col="path", exclude=exclude)
    return members, missing_archives(owners.withColumnRenamed(owner_col, "owner"), found, "owner")
