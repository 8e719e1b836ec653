"""Delivery keys: where a bundle or a single file of an owner is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import (archive_name, basename, col_or_lit, file_name_for_owner, join_key,
                               last_segment, s3_uri, slug)


def _prefix(prefix, branch_col: str) -> Column:
    """``None`` → the branch column; ``""`` → bucket root; a string or Column otherwise."""
    if prefix is None:
        return F.col(branch_col)
    return col_or_lit(prefix)


def delivery_keys(df: DataFrame, *, path_col: str = "path", owner_col: str = "owner",
                  prefix=None, branch_col: str = "branch", bucket=None) -> DataFrame:
    """Add ``folder``, ``file_name``, ``key`` (and ``uri`` when a bucket is given).

    ``folder`` = last segment of the path; ``file_name`` = ``<folder>_<owner slug>.tar.gz``;
    ``key`` = ``<prefix>/<file_name>`` or ``<file_name>`` for an empty prefix.
    """
    out = (df.withColumn("folder", basename(F.col(path_col)))
             .withColumn("file_name", archive_name(F.col("folder"), slug(F.coalesce(F.col(owner_col), F.lit("")))))
             .withColumn("key", join_key(_prefix(prefix, branch_col), F.col("file_name"))))
    if bucket is not None:
        out = out.withColumn("uri", s3_uri(col_or_lit(bucket), F.col("key")))
    return out


def file_keys(df: DataFrame, *, name_col: str = "path", owner_col: str = "owner", prefix=None,
              branch_col: str = "branch", key=None, bucket=None) -> DataFrame:
    """Key of a single file written as is: ``<prefix>/<stem>_<slug><ext>``.

    An explicit ``key`` replaces the derived file name but is still prefixed. With an empty owner the
    base name is kept.
    """
    base = last_segment(F.col(name_col))
    name = col_or_lit(key) if key is not None else file_name_for_owner(
        base, slug(F.coalesce(F.col(owner_col), F.lit(""))))
    out = df.withColumn("key", join_key(_prefix(prefix, branch_col), name))
    if bucket is not None:
        out = out.withColumn("uri", s3_uri(col_or_lit(bucket), F.col("key")))
    return out
