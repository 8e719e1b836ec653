"""Inventory operators: exclusion rules, listing, previews, tree sizes and size reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import human_bytes
from ..functions.text import binary_head, decode_ignore, utf8_head

# Junk names left out of bundles and tree sizes.
DEFAULT_EXCLUDE = ("__pycache__", ".ipynb_checkpoints")

MODES = ("component", "directory", "substring")


def excluded(key: Column, names: Sequence[str] = DEFAULT_EXCLUDE, mode: str = "component") -> Column:
    """True when ``key`` is junk under one of the three rules.

    * ``component``: any path component equals a name (what goes into a bundle);
    * ``directory``: any directory component equals a name, the file name itself is not tested
      (what a tree's size counts);
    * ``substring``: the key contains a name anywhere (what a restore leaves out).
    Names compare exactly and case-sensitively. Keys are relative to the tree's root, so the root's
    own name is never tested.
    """
    names = list(names)
    if not names:
        return F.lit(False)
    parts = F.split(key, "/")
    if mode == "component":
        return F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    if mode == "directory":
        dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names]))
    if mode == "substring":
        hit = None
        for n in names:
            e = key.contains(n)
            hit = e if hit is None else hit | e
        return hit
    raise ValueError(f"mode must be one of {MODES}")


def exclude_paths(df: DataFrame, key_col: str = "key", names: Sequence[str] = DEFAULT_EXCLUDE,
                  mode: str = "component") -> DataFrame:
    """Drop junk entries (see :func:`excluded`). A plain filter: pushed into the scan's pipeline."""
    return df.where(~excluded(F.col(key_col), names, mode))


def list_objects(inv: DataFrame, prefix: str = "", limit: int | None = 10,
                 key_col: str = "key") -> DataFrame:
    """Keys under a plain string prefix in binary key order; the first ``limit`` of them.

    The prefix becomes ``StringStartsWith`` in the Parquet scan; ``orderBy + limit`` plans as a
    per-partition top-k (``TakeOrderedAndProject``), so no full sort is needed.
    """
    out = inv.where(F.col(key_col).startswith(prefix)) if prefix else inv
    out = out.orderBy(key_col)
    return out.limit(limit) if limit is not None else out


def object_preview(df: DataFrame, col: str, size: int = 1000, decode: bool = True,
                   out: str = "head") -> DataFrame:
    """First ``size`` bytes of a text or binary column; text is decoded with errors ignored."""
    dtype = dict(df.dtypes)[col]
    if dtype == "string":
        head = utf8_head(F.col(col), size) if decode else binary_head(F.encode(F.col(col), "UTF-8"), size)
    else:
        head = decode_ignore(binary_head(F.col(col), size)) if decode else binary_head(F.col(col), size)
    return df.withColumn(out, head)


def tree_stats(inv: DataFrame, group_cols: Sequence[str] = (), *, key_col: str = "key",
               length_col: str = "length", names: Sequence[str] = DEFAULT_EXCLUDE,
               mode: str = "directory", rollup: bool = False) -> DataFrame:
    """Total bytes and number of regular files per group (partial + final hash aggregate).

    Links are not counted. With no group columns a missing or empty tree gives one row (0, 0).
    ``rollup=True`` adds the subtotals of every prefix of ``group_cols`` and the grand total (NULL
    in the rolled-up columns), e.g. per (prefix, owner), per prefix, and overall.
    """
    df = exclude_paths(inv, key_col, names, mode)
    if "is_link" in inv.columns:
        df = df.where(~F.coalesce(F.col("is_link"), F.lit(False)))
    agg = [F.coalesce(F.sum(length_col), F.lit(0)).cast("bigint").alias("total_bytes"),
           F.count(F.lit(1)).alias("n_files")]
    grouped = df.rollup(*group_cols) if rollup and group_cols else df.groupBy(*group_cols)
    return grouped.agg(*agg)


def size_report(df: DataFrame, group_cols: Sequence[str], length_col: str = "length", *,
                rollup: bool = False) -> DataFrame:
    """``total_bytes``, ``n_files`` and the human-readable ``human`` per group (``rollup=True`` adds
    subtotals and the grand total)."""
    grouped = df.rollup(*group_cols) if rollup and group_cols else df.groupBy(*group_cols)
    agg = (grouped
           .agg(F.coalesce(F.sum(length_col), F.lit(0)).cast("bigint").alias("total_bytes"),
                F.count(F.lit(1)).alias("n_files")))
    return agg.withColumn("human", human_bytes("total_bytes"))
