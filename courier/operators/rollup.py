"""Totals of every folder of a tree at once, from one pass over the keys in order.

Below a folder lie the keys of one range, so in key order a folder *opens* at its first key and
*closes* at its last, and its total is the difference of two running sums. A key opens the folders
that the key before it was not in and closes those that the next one is not in: together as many as
there are folders, whatever the depth of the tree. Nothing is exploded to all ancestors of a file,
and no folder, the root included, meets in one task: the keys are range-partitioned like in
:mod:`scan`, and blocks exchange one key and one sum each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .inventory import DEFAULT_EXCLUDE, exclude_paths
from .scan import BLOCK


def _shared(a: Column, b: Column) -> Column:
    """How many leading parts two paths share; a null path shares none, not even the root (-1)."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.coalesce(F.when(differs > 0, differs - 1).otherwise(F.least(F.size(a), F.size(b))), F.lit(-1)).cast("int")


def folder_sizes(inv: DataFrame, by: Sequence[str] = (), *, key_col: str = "key", length_col: str = "length",
                 names: Sequence[str] = DEFAULT_EXCLUDE, mode: str = "directory", partitions: int | None = None) -> DataFrame:
    """Bytes and files below every folder: ``(*by, folder, depth, total_bytes, n_files)``.

    ``folder`` is the path without its last slash, ``''`` (depth 0) the root of each ``by`` group
    (owner, bucket). The rules are those of :func:`tree_stats`: links are not counted, junk folders
    neither counted nor listed. Folders without files below them are in no key, so not in the result;
    a null length counts as 0 bytes, a null key is left out, a repeated key counts each time. An empty
    inventory has no folders. Runs one job, which stores the narrow rows in key order.
    """
    by = list(by)
    clash = {c.lower() for c in by} & {"folder", "depth", "total_bytes", "n_files"}
    if clash:
        raise ValueError(f"columns clash with results: {sorted(clash)}")
    df = exclude_paths(inv, key_col, names, mode).where(F.col(key_col).isNotNull())
    if "is_link" in inv.columns:
        df = df.where(~F.coalesce(F.col("is_link"), F.lit(False)))
    groups = [f"_g{i}" for i in range(len(by))]
    # folders in between end with the separator, so that keys below them stay together in byte order
    narrow = df.select(*[F.col(c).alias(g) for c, g in zip(by, groups)], F.col(key_col).alias("_key"),
                       F.coalesce(F.col(length_col).cast("bigint"), F.lit(0)).alias("_n"))
    blocks = [partitions] if partitions else []
    rows = materialise(narrow.repartitionByRange(*blocks, *groups, "_key").withColumn(BLOCK, F.spark_partition_id()), "folder_sizes")

    # per block: its sums, and its first and last row for the neighbours
    at = F.struct(*groups, "_key")
    ends = rows.groupBy(BLOCK).agg(F.sum("_n").alias("_sum"), F.count(F.lit(1)).alias("_rows"),
                                   F.min(at).alias("_first"), F.max(at).alias("_last"))
    in_order = Window.orderBy(BLOCK)  # one row per block
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(BLOCK, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_bytes0"),
                       F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_files0"),
                       F.lag("_last").over(in_order).alias("_prev0"), F.lead("_first").over(in_order).alias("_next0"))
    inside = Window.partitionBy(BLOCK).orderBy(*groups, "_key")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", at.alias("_at")).select(
        "*", F.sum("_n").over(upto).alias("_sum"), F.row_number().over(inside).alias("_row"),
        F.lag("_at").over(inside).alias("_prev"), F.lead("_at").over(inside).alias("_next"))
    rows = rows.join(F.broadcast(ends), BLOCK)  # a row per block, and blocks are partitions
    bytes_to, files_to = F.col("_bytes0") + F.col("_sum"), F.col("_files0") + F.col("_row")

    parts = lambda c: F.slice(F.split(c["_key"], "/"), F.lit(1), F.size(F.split(c["_key"], "/")) - 1)
    same = lambda c: reduce(lambda a, b: a & b, [c[g].eqNullSafe(F.col(g)) for g in groups], c.isNotNull())
    prev, nxt = F.coalesce("_prev", "_prev0"), F.coalesce("_next", "_next0")
    own = parts(F.col("_at"))
    edges = rows.select(*groups, own.alias("_own"), "_n", bytes_to.alias("_to"), files_to.alias("_files"),
                        F.when(same(prev), _shared(own, parts(prev))).otherwise(-1).alias("_was"),
                        F.when(same(nxt), _shared(own, parts(nxt))).otherwise(-1).alias("_stays"))
    depths = lambda shared: F.sequence(F.col(shared) + 1, F.size("_own"))
    touched = edges.where((F.col("_was") < F.size("_own")) | (F.col("_stays") < F.size("_own")))
    marks = touched.select(*groups, "_own", F.inline(F.concat(
        F.when(F.col("_was") < F.size("_own"), F.transform(depths("_was"), lambda d: F.struct(
            d.alias("depth"), (F.col("_n") - F.col("_to")).alias("_b"), (1 - F.col("_files")).alias("_f")))).otherwise(F.array()),
        F.when(F.col("_stays") < F.size("_own"), F.transform(depths("_stays"), lambda d: F.struct(
            d.alias("depth"), F.col("_to").alias("_b"), F.col("_files").alias("_f")))).otherwise(F.array()))))
    folder = F.array_join(F.slice("_own", F.lit(1), F.col("depth")), "/")
    # two rows per folder: where it opens and where it closes
    return (marks.select(*groups, folder.alias("folder"), "depth", "_b", "_f").groupBy(*groups, "folder", "depth")
            .agg(F.sum("_b").cast("bigint").alias("total_bytes"), F.sum("_f").cast("bigint").alias("n_files"))
            .withColumnsRenamed(dict(zip(groups, by))))
