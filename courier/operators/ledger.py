"""Delivery-ledger operators: current state by key, collisions, size guard, owner lookups, progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import slug
from .scan import running_sum


class SizeLimitExceeded(RuntimeError):
    """A bundle is above the requested size limit; nothing was written."""


class MissingObjects(RuntimeError):
    """Requested objects do not exist (or are not regular files)."""


def latest_delivery(deliveries: DataFrame, key_cols: Sequence[str] = ("key",),
                    order_cols: Sequence[str] = ("ts", "delivery_id")) -> DataFrame:
    """One row per key: the last write wins, ties broken by the next order column.

    ``max_by(struct(row), struct(order))`` is a plain aggregate, so it is pre-aggregated on the map
    side: a hot key costs one row per map task in the shuffle, never the whole key in one task.
    """
    cols = deliveries.columns
    win = F.max_by(F.struct(*cols), F.struct(*order_cols)).alias("_w")
    return deliveries.groupBy(*key_cols).agg(win).select("_w.*")


def key_collisions(deliveries: DataFrame, key_col: str = "key", course_col: str = "course",
                   owner_col: str = "owner", *, approx: bool = False) -> DataFrame:
    """Keys written by more than one course (or by owners that share a slug): they overwrite each other."""
    # one row per (key, course, owner) first: what is counted distinct below is small, and a key that
    # is written very often is combined before the shuffle
    writes = deliveries.groupBy(key_col, course_col, owner_col).agg(F.count(F.lit(1)).alias("_n"))
    distinct = F.approx_count_distinct if approx else (lambda c: F.size(F.collect_set(c)).cast("bigint"))
    agg = writes.groupBy(key_col).agg(distinct(course_col).alias("n_courses"), distinct(owner_col).alias("n_owners"),
                                      F.sum("_n").alias("n_writes"))
    return agg.where((F.col("n_courses") > 1) | (F.col("n_owners") > 1))


def oversized(df: DataFrame, group_cols: Sequence[str], length_col: str, max_size_mb) -> DataFrame:
    """Groups whose total exceeds ``max_size_mb`` MiB (strict ``>``); ``0`` is a real limit."""
    limit = int(max_size_mb) * 1024 * 1024
    agg = df.groupBy(*group_cols).agg(F.sum(length_col).cast("bigint").alias("total_bytes"))
    return agg.where(F.col("total_bytes") > F.lit(limit))


def size_guard(df: DataFrame, group_cols: Sequence[str], length_col: str = "length",
               max_size_mb=None, *, mode: str = "filter"):
    """``filter``: the groups over the limit. ``fail``: run that check as its own action and raise
    :class:`SizeLimitExceeded` before anything is written. ``max_size_mb=None`` means no limit."""
    if max_size_mb is None:
        none = df.groupBy(*group_cols).agg(F.sum(length_col).cast("bigint").alias("total_bytes")).limit(0)
        return none if mode == "filter" else None
    over = oversized(df, group_cols, length_col, max_size_mb)
    if mode == "filter":
        return over
    if mode != "fail":
        raise ValueError("mode must be 'filter' or 'fail'")
    sample = over.limit(5).collect()
    if sample:
        shown = ", ".join(str(r.asDict()) for r in sample)
        raise SizeLimitExceeded(f"over the limit of {max_size_mb} MB: {shown}")
    return None


def fetch_user_archive(objects: DataFrame, owners: DataFrame, *, prefix: str | None = None,
                       match: str = "owner", key_col: str = "key", owner_col: str = "owner",
                       objects_owner_col: str = "owner", suffix: str = ".tar.gz",
                       prefix_col: str | None = None) -> DataFrame:
    """The archive of every owner: ``(owner, key)``, first key in listing order.

    ``match="owner"``: equi-join on the ledger's owner column. ``match="suffix"``: the loose rule of
    a bucket listing, the key ends with ``<owner slug><suffix>``. The theta join becomes an equi join
    on the suffix: a key yields one suffix per length that some slug has, so the rows grow with the
    number of distinct slug lengths and not with the longest slug. Suffixes are combined to their
    ``min(key)`` before the join, so one that many keys share is one row per map task.

    ``prefix_col`` names a stored column that holds the key's prefix: the filter then reaches the
    scan, where a filter on a computed key cannot.
    """
    objs = objects
    if prefix is not None and prefix_col is not None:
        objs = objs.where(F.col(prefix_col) == prefix)
    elif prefix is not None:
        objs = objs.where(F.col(key_col).startswith(prefix + "/") if prefix else ~F.col(key_col).contains("/"))
    if match == "owner":
        firsts = (objs.where(F.col(key_col).endswith(suffix))
                  .groupBy(F.col(objects_owner_col).alias("_o")).agg(F.min(key_col).alias(key_col)))
        return (owners.select(owner_col).distinct()
                .join(firsts, F.col(owner_col) == F.col("_o"), "inner").select(owner_col, key_col))
    if match != "suffix":
        raise ValueError("match must be 'owner' or 'suffix'")
    o = owners.select(owner_col).distinct().withColumn("_slug", slug(F.coalesce(F.col(owner_col), F.lit(""))))
    # a scalar: the lengths that occur, at most as many as the longest name has characters
    lengths = o.agg(F.collect_set(F.char_length("_slug"))).scalar()
    stems = (objs.where(F.col(key_col).endswith(suffix))
             .select(key_col, F.expr(f"substring({key_col}, 1, char_length({key_col}) - {len(suffix)})").alias("_stem")))
    cut = (stems.withColumn("_lengths", lengths).select(key_col, "_stem", F.explode("_lengths").alias("_l"))
           .where(F.col("_l") <= F.char_length("_stem"))
           .select(key_col, F.expr("substring(_stem, char_length(_stem) - _l + 1)").alias("_sfx")))
    firsts = cut.groupBy("_sfx").agg(F.min(key_col).alias(key_col))
    return o.join(firsts, o["_slug"] == firsts["_sfx"], "inner").select(owner_col, key_col)


def missing_archives(owners: DataFrame, found: DataFrame, owner_col: str = "owner",
                     found_owner_col: str | None = None) -> DataFrame:
    """Owners with no archive: a left anti join against the distinct owners that have one.

    The found side is reduced to distinct owners first (partial aggregation), so an owner with very
    many objects is one row per map task, not a hot key in the join.
    """
    f = found.select(F.col(found_owner_col or owner_col).alias("_found")).distinct()
    return owners.join(f, owners[owner_col] == f["_found"], "left_anti")


def transfer_progress(chunks: DataFrame, transfer_cols: Sequence[str], order_cols: Sequence[str],
                      n_col: str, step: int = 10, *, total_col: str | None = None) -> DataFrame:
    """Milestones of a byte counter: the rows where the integer percentage reaches a new multiple of
    ``step`` (a jump over several steps emits once, at its real percentage). A transfer of 0 bytes
    emits nothing. Adds ``done`` (running bytes) and ``pct``.

    The percentage is taken of ``total_col`` when given (the size declared before the transfer, so an
    interrupted transfer stops below 100 %), else of the sum of the transfer's chunks. The running
    sum is exact and skew-safe (see :mod:`scan`); the previous row's percentage is derived from
    ``done - n``, so no ``lag`` (and no second window) is needed.
    """
    r = running_sum(chunks, transfer_cols, order_cols, n_col, "done", total="_sum")
    r = r.withColumn("_total", F.col(total_col).cast("bigint") if total_col else F.col("_sum"))
    pct = F.expr("(done * 100) div _total")
    prev = F.expr(f"((done - coalesce({n_col}, 0)) * 100) div _total")
    return (r.where(F.col("_total") > 0)
             .withColumn("pct", pct.cast("bigint"))
             .where(F.floor(F.col("pct") / step) > F.floor(prev / step))
             .drop("_total", "_sum"))
