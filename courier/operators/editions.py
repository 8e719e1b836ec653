"""Collisions over time: editions of a course that overwrite each other under one key.

An *edition* is what one course (or one owner) writes under a key, from its first to its last write.
Editions of a key whose times overlap overwrite each other's bundles in turn; editions that follow
each other only replace an older one. Which of the two it is takes the times, not only the counts of
:func:`key_collisions`.

The second part keeps the counts up to date without rereading the ledger: a sketch per key and day,
merged over any set of days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import running_max


def editions(deliveries: DataFrame, key_cols: Sequence[str] = ("key",), edition_col: str = "course", ts_col: str = "ts") -> DataFrame:
    """``(*key_cols, edition_col, first_ts, last_ts, n_writes)``, combined before the shuffle. Rows
    without a time are no writes; null keys and editions are values like others."""
    return (deliveries.where(F.col(ts_col).isNotNull()).groupBy(*key_cols, edition_col)
            .agg(F.min(ts_col).alias("first_ts"), F.max(ts_col).alias("last_ts"), F.count(F.lit(1)).alias("n_writes")))


def overlapping_editions(found: DataFrame, key_cols: Sequence[str] = ("key",), edition_col: str = "course", *,
                         partitions: int | None = None) -> DataFrame:
    """The editions with ``until``, the latest end of the key's editions that began before (ties by
    edition), and ``overlaps``: it began when one of those had not ended (a shared instant counts).

    A sweep in order of the starts that carries the latest end: the rows are cut into ranges of (key,
    start), so a key with any number of editions is no single task, and no pairs are made.
    """
    swept = running_max(found, key_cols, ["first_ts", edition_col], "last_ts", "until", partitions=partitions)
    return swept.withColumn("overlaps", F.coalesce(F.col("first_ts") <= F.col("until"), F.lit(False)))


def key_sketches(deliveries: DataFrame, key_cols: Sequence[str] = ("key",), count_cols: Sequence[str] = ("course", "owner"),
                 ts_col: str = "ts", lg_k: int = 10) -> DataFrame:
    """Per key and ``day``: ``n_writes`` and a HyperLogLog sketch of each of ``count_cols``. Store it
    partitioned by ``day``; a new day is one more partition. Up to some dozens of values a sketch is a
    short list and exact; beyond, its standard error is about 1.04 / sqrt(2 ** lg_k), 3 % at 10."""
    day = F.to_date(ts_col).alias("day")
    sketches = [F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(f"{c}_sketch") for c in count_cols]
    return deliveries.groupBy(*key_cols, day).agg(F.count(F.lit(1)).alias("n_writes"), *sketches)


def audit_sketches(sketches: DataFrame, key_cols: Sequence[str] = ("key",), count_cols: Sequence[str] = ("course", "owner")) -> DataFrame:
    """``n_<column>`` distinct values per key over all days in ``sketches``, and ``n_writes``; keys of one
    course and one owner are left out. Sketches are merged before the shuffle."""
    merged = sketches.groupBy(*key_cols).agg(
        F.sum("n_writes").alias("n_writes"),
        *[F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")).alias(f"n_{c}") for c in count_cols])
    return merged.where(" OR ".join(f"n_{c} > 1" for c in count_cols))
