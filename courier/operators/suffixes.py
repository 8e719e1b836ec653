"""Look-ups of object names by how they end, on a stored inventory.

A bucket listing is in key order, so a prefix is a range and a suffix is anywhere. An inventory that is
stored a second time in the order of the *reversed* keys turns a suffix into a range too: the filter
reaches the Parquet files as ``StringStartsWith``, and files and row groups whose least and largest
value cannot begin so are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import slug
from .ledger import fetch_user_archive

#: A look-up of more suffixes than this is a join, not a filter.
SUFFIXES_IN_A_FILTER = 200


def store_by_suffix(inv: DataFrame, path: str, key_col: str = "key") -> DataFrame:
    """Write an inventory in the order of its reversed keys (column ``reversed_key``) and read it back.
    Rows without a key cannot be found by one and are left out."""
    if "reversed_key" in {c.lower() for c in inv.columns}:
        raise ValueError("the inventory has a column reversed_key")
    rows = inv.where(F.col(key_col).isNotNull()).withColumn("reversed_key", F.reverse(key_col))
    rows.repartitionByRange("reversed_key").sortWithinPartitions("reversed_key").write.mode("overwrite").parquet(path)
    return inv.sparkSession.read.schema(rows.schema).parquet(path)


def keys_ending(spark: SparkSession, path: str, suffixes: Sequence[str]) -> DataFrame:
    """Rows of a stored inventory whose key ends with one of ``suffixes``."""
    rows = spark.read.parquet(path)
    if not suffixes:
        return rows.limit(0).drop("reversed_key")
    ends = [F.col("reversed_key").startswith(s[::-1]) for s in sorted(set(suffixes))]
    return rows.where(reduce(lambda a, b: a | b, ends)).drop("reversed_key")


def find_archives(spark: SparkSession, path: str, owners: DataFrame, *, owner_col: str = "owner", key_col: str = "key",
                  suffix: str = ".tar.gz") -> DataFrame:
    """``(owner, key)``: for every owner the first key that ends with the owner's slug and ``suffix``.

    Up to ``SUFFIXES_IN_A_FILTER`` owners are looked up by ranges of the stored inventory; more of them
    are joined with all of it (:func:`fetch_user_archive`). The results are the same.
    """
    some = owners.select(F.col(owner_col).alias("o"), F.concat(slug(F.coalesce(F.col(owner_col), F.lit(""))), F.lit(suffix)).alias("s"))
    few = [r["s"] for r in some.select("s").distinct().limit(SUFFIXES_IN_A_FILTER + 1).collect()]
    rows = spark.read.parquet(path).drop("reversed_key") if len(few) > SUFFIXES_IN_A_FILTER else keys_ending(spark, path, few)
    return fetch_user_archive(rows, owners, match="suffix", key_col=key_col, owner_col=owner_col, suffix=suffix)
