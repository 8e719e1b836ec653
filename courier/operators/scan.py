"""Exact running sums that never put a whole group into one task.

``sum(x) OVER (PARTITION BY g ORDER BY o)`` sends every row of a group to one task; a group holding a
third of the data would then hold a third of the job. Here the rows are range-partitioned on
``(g, o)``, so a large group spans many contiguous blocks, and written once with their block number:
every later step reads that one table, so all agree on the blocks. A window per (block, group) gives
the running sum inside a block, one row per (block, group) gives each block its offset. The result
is the same exact ROWS-frame running sum. Everything is native; pass narrow rows, not bodies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

BLOCK = "_blk"


def _null_safe_join(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in cols],
                     *[c for c in right.columns if c not in cols])
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(r[f"_r_{c}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in cols])


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str,
                out: str = "running", *, total: str | None = None,
                partitions: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the rows of the same ``by`` group up to and including this
    one in ``order`` (``order`` must make rows unique within a group). ``total`` adds the group total.
    ``value`` is a whole number (bytes, counts); NULL counts as 0.

    Runs one job, which writes the rows with their block number under the shared checkpoint folder.
    ``partitions`` is the number of blocks; without it the session's shuffle partitions. A group that
    spans blocks needs a correction: at most two (block, group) pairs per block, so that side of the
    join is small whatever the data.
    """
    by, order = list(by), list(order)
    blocks = [partitions] if partitions else []
    ranged = df.repartitionByRange(*blocks, *by, *order).withColumn(BLOCK, F.spark_partition_id())
    rows = materialise(ranged, "running_sum")
    amount = F.coalesce(F.col(value).cast("bigint"), F.lit(0))
    inside = Window.partitionBy(BLOCK, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(BLOCK, *by).agg(F.sum(amount).alias("_sum"))
    group = Window.partitionBy(*by)
    before = group.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    spanning = sums.select(BLOCK, *by, F.count(F.lit(1)).over(group).alias("_nblk"),
                           F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"),
                           F.sum("_sum").over(group).alias("_tot")).where(F.col("_nblk") > 1).drop("_nblk")
    local = rows.withColumn("_local", F.sum(amount).over(inside))
    if total:
        whole = Window.partitionBy(BLOCK, *by)
        local = local.withColumn("_ltot", F.sum(amount).over(whole))
    res = _null_safe_join(local, spanning, [BLOCK, *by], "left")
    res = res.withColumn(out, (F.coalesce("_off", F.lit(0)) + F.col("_local")).cast("bigint"))
    if total:
        res = res.withColumn(total, F.coalesce("_tot", "_ltot").cast("bigint"))
    return res.drop(BLOCK, "_local", "_ltot", "_off", "_tot")


def running_max(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str = "before", *,
                partitions: int | None = None) -> DataFrame:
    """Add ``out`` = largest ``value`` of the *earlier* rows of the same ``by`` group in ``order`` (which
    must make rows unique within a group); null for the first, nulls count as nothing.

    Blocks and their carried values are those of :func:`running_sum`: a group of any size spans as many
    blocks as it needs, and each (block, group) pair passes on one maximum.
    """
    by, order = list(by), list(order)
    blocks = [partitions] if partitions else []
    rows = materialise(df.repartitionByRange(*blocks, *by, *order).withColumn(BLOCK, F.spark_partition_id()), "running_max")
    most = rows.groupBy(BLOCK, *by).agg(F.max(value).alias("_max"))
    group = Window.partitionBy(*by)
    before = group.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = most.select(BLOCK, *by, F.count(F.lit(1)).over(group).alias("_nblk"), F.max("_max").over(before).alias("_carried"))
    inside = Window.partitionBy(BLOCK, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.max(value).over(inside))
    res = _null_safe_join(local, carried.where("_nblk > 1").drop("_nblk"), [BLOCK, *by], "left")
    return res.withColumn(out, F.greatest("_local", "_carried")).drop(BLOCK, "_local", "_carried")
