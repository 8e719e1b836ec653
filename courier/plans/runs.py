"""A delivery table of sorted runs: publishing writes what it is given, reading merges.

``publish(mode="replace")`` rewrites every hash bucket that a publish touches. Here a publish writes
one *run*, a Parquet folder with one row per (bucket, key), ranged and sorted by them, and then a new
*version*: a small JSON file that lists the runs in the order in which they were published. Versions
are numbered and created without overwriting, so a version is there whole or not at all, two
publishers cannot both write the same one (the later takes the next number), and readers of an older
version are not disturbed. Deleted keys are rows with ``_deleted`` (tombstones).

* **Reading** a version: of each key the row of the latest run that has it, tombstones left out. The
  largest run is not shuffled if the keys of the others are small enough to be broadcast (their size
  is in the version): it is filtered by them and the merged others are added. Beyond that size all
  runs are merged by key. Runs whose key range misses the asked range are not opened.
* **Compaction** is size-tiered: ``fanout`` neighbouring runs of one tier (sizes within a factor of
  ``fanout``) become one, so a row is rewritten once per tier and there are a logarithmic number of
  runs. Tombstones go when the merged runs are the oldest. It commits a version like a publish; if a
  publisher came first, its run is kept.
* **Vacuum** deletes runs that no kept version lists, older than a given age, so a run that is being
  written stays.

A crash leaves a run or a temporary file that no version lists: the table is as before.

Defined results: rows of one call that share a key count as one, the last by ``ts`` and
``delivery_id``; a later call replaces an earlier one whatever its ``ts``; a key that one call both
writes and deletes is written; deleting a key that is not there does nothing; null buckets and keys
are values like others; an empty publish makes no run; columns added by a later call are null in
earlier rows; a table without versions has no rows and raises :class:`FileNotFoundError` when read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ledger import latest_delivery
from ..sources import store

#: Reading broadcasts the keys of the smaller runs up to so many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024
#: Tries of a commit against other publishers.
COMMITS = 100


def versions(spark: SparkSession, target: str) -> list[int]:
    return sorted(int(n[:-5]) for n in store.names(spark, f"{target}/versions") if n.endswith(".json") and n[:-5].isdigit())


def version(spark: SparkSession, target: str, number: int | None = None) -> dict:
    """A version (the last one, if no number is given): its ``runs`` and the table's ``keys``."""
    if number is None:
        there = versions(spark, target)
        if not there:
            return {"number": 0, "runs": [], "keys": None}
        number = there[-1]
    return json.loads(store.read_text(spark, f"{target}/versions/{number}.json"))


def _commit(spark: SparkSession, target: str, change) -> dict:
    """Write the version after the last; ``change`` makes it from the last, anew after a lost race."""
    for _ in range(COMMITS):
        last = version(spark, target)
        new = change(last)
        if new is None:
            return last
        new = {**new, "number": last["number"] + 1}
        if store.create_text(spark, f"{target}/versions/{new['number']}.json", json.dumps(new)):
            return new
    raise store.StoreError(f"{target}: no version could be written in {COMMITS} tries")


def _write_run(rows: DataFrame, target: str, keys: Sequence[str]) -> dict | None:
    """Write rows (one per key) as a sorted run; its entry for a version, or ``None`` without rows."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    path = f"{target}/runs/{name}"
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)
    end = F.col(keys[-1]).cast("string")
    n, first, last = spark.read.schema(rows.schema).parquet(path).agg(F.count(F.lit(1)), F.min(end), F.max(end)).first()
    if not n:
        store.delete(spark, path)
        return None
    return {"name": name, "rows": n, "bytes": store.folder_bytes(spark, path), "first": first, "last": last,
            "schema": json.loads(rows.schema.json())}


def publish_run(deliveries: DataFrame | None, target: str, *, deletes: DataFrame | None = None,
                keys: Sequence[str] | None = None, fanout: int | None = 8) -> dict:
    """Publish ``deliveries`` (with ``key``, maybe ``bucket``, ``ts`` and ``delivery_id``) and delete
    the keys of ``deletes``; returns the new version. ``fanout=None`` leaves compaction to
    :func:`compact_runs`."""
    given = deliveries if deliveries is not None else deletes
    spark, target = given.sparkSession, target.rstrip("/")
    keys = list(keys or [c for c in ("bucket", "key") if c in given.columns])
    stored = version(spark, target)["keys"]
    if stored is not None and stored != keys:
        raise ValueError(f"{target}: the table's keys are {stored}, not {keys}")
    parts = []
    if deliveries is not None:
        parts.append(latest_delivery(deliveries, keys).withColumn("_deleted", F.lit(False)))
    if deletes is not None:
        gone = deletes.select(*keys).distinct().withColumn("_deleted", F.lit(True))
        if deliveries is not None:
            gone = gone.join(deliveries.select(*[F.col(k).alias(f"_w_{k}") for k in keys]),
                             reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys]), "left_anti")
        parts.append(gone)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    run = _write_run(rows, target, keys)
    if run is None:
        return version(spark, target)
    done = _commit(spark, target, lambda last: {"keys": keys, "runs": [*last["runs"], run]})
    return compact_runs(spark, target, fanout=fanout) if fanout else done


def _rows(spark: SparkSession, target: str, runs: list[dict], schema: T.StructType) -> DataFrame:
    """Rows of runs with ``_at``, their place in the order of publishing."""
    one = [spark.read.schema(T.StructType.fromJson(r["schema"])).parquet(f"{target}/runs/{r['name']}") for r in runs]
    names = [f.name for f in schema.fields]
    whole = [d.select(*[F.col(n) if n in d.columns else F.lit(None).cast(schema[n].dataType).alias(n) for n in names],
                      F.lit(i).alias("_at")) for i, d in enumerate(one)]
    return reduce(DataFrame.unionByName, whole)


def _schema(runs: list[dict]) -> T.StructType:
    """All columns of the runs; a column must keep its type."""
    fields: dict = {}
    for r in runs:
        for f in T.StructType.fromJson(r["schema"]).fields:
            if fields.setdefault(f.name, f).dataType != f.dataType:
                raise ValueError(f"column {f.name} changes its type: {fields[f.name].dataType}, {f.dataType}")
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields.values()])


def _merged(spark, target, runs, keys, schema) -> DataFrame:
    """The latest row of every key over some runs, tombstones included."""
    rows = _rows(spark, target, runs, schema)
    if len(runs) == 1:
        return rows.drop("_at")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[f.name for f in schema.fields]), "_at").alias("_w")).select("_w.*")


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    return left.join(right, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]), how)


def read_runs(spark: SparkSession, target: str, *, number: int | None = None, first: str | None = None,
              last: str | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """What the table holds at a version. ``first`` and ``last`` bound the (last) key column, for string
    keys: runs outside are not opened, and the filter reaches the sorted files of the others."""
    target = target.rstrip("/")
    at = version(spark, target, number)
    if not at["runs"]:
        raise FileNotFoundError(f"{target}: no version with rows")
    keys, schema = at["keys"], _schema(at["runs"])
    bounded = first is not None or last is not None
    runs = at["runs"]
    if bounded:  # null keys are in no range
        runs = [r for r in runs if r["first"] is not None and (last is None or r["first"].encode() <= last.encode())
                and (first is None or r["last"].encode() >= first.encode())] or runs[:1]
    cut = (lambda d: d) if not bounded else lambda d: d.where(
        (F.col(keys[-1]) >= first if first is not None else F.lit(True)) & (F.col(keys[-1]) <= last if last is not None else F.lit(True)))
    big = max(range(len(runs)), key=lambda i: runs[i]["bytes"])
    rest = runs[:big] + runs[big + 1:]
    if big == 0 and rest and sum(r["bytes"] for r in rest) <= broadcast_bytes:
        # the oldest run is the largest: rows that a later run has are left out where they lie
        newer = cut(_merged(spark, target, rest, keys, schema))
        base = cut(_merged(spark, target, runs[:1], keys, schema))
        rows = _null_safe(base, F.broadcast(newer.select(*keys)), keys, "left_anti").unionByName(newer)
    else:
        rows = cut(_merged(spark, target, runs, keys, schema))
    return rows.where(~F.col("_deleted")).drop("_deleted")


def _full_tier(runs: list[dict], fanout: int) -> tuple[int, int] | None:
    """The first stretch of ``fanout`` or more neighbouring runs whose sizes are of one tier or below
    that of their largest."""
    tier = [max(r["rows"], 1).bit_length() // max(fanout.bit_length() - 1, 1) for r in runs]
    for level in sorted(set(tier)):
        start = 0
        while start < len(runs):
            end = start
            while end < len(runs) and tier[end] <= level:
                end += 1
            if sum(t == level for t in tier[start:end]) >= fanout:
                return start, end
            start = end + 1
    return None


def compact_runs(spark: SparkSession, target: str, *, fanout: int = 8, everything: bool = False) -> dict:
    """Merge full tiers (or all runs) into one run each, and commit; returns the last version."""
    target = target.rstrip("/")
    while True:
        at = version(spark, target)
        runs = at["runs"]
        found = (0, len(runs)) if everything and len(runs) > 1 else _full_tier(runs, fanout)
        if found is None:
            return at
        start, end = found
        part, schema = runs[start:end], _schema(runs)
        rows = _merged(spark, target, part, at["keys"], schema)
        if start == 0:  # nothing older that a tombstone could hide
            rows = rows.where(~F.col("_deleted"))
        merged = _write_run(rows, target, at["keys"])
        names = [r["name"] for r in part]

        def change(last):
            now = [r["name"] for r in last["runs"]]
            at = next((i for i in range(len(now)) if now[i:i + len(names)] == names), None)
            if at is None or (start == 0 and at != 0):
                return None  # another compaction took them: its runs stay
            kept = [merged] if merged is not None else []
            return {"keys": last["keys"], "runs": [*last["runs"][:at], *kept, *last["runs"][at + len(names):]]}

        done = _commit(spark, target, change)
        if everything:
            return done


def vacuum(spark: SparkSession, target: str, *, keep: int = 2, older_than_s: float = 7 * 86400) -> list[str]:
    """Delete versions but the last ``keep``, and runs that no kept version lists and that were last
    written ``older_than_s`` seconds ago or earlier; returns the names of the deleted runs."""
    target = target.rstrip("/")
    there = versions(spark, target)
    kept = there[-max(keep, 1):]
    used = {r["name"] for n in kept for r in version(spark, target, n)["runs"]}
    for n in there[:-max(keep, 1)]:
        store.delete(spark, f"{target}/versions/{n}.json")
    gone = []
    for name, modified in store.folders(spark, f"{target}/runs"):
        if name not in used and modified <= time.time() - older_than_s:
            store.delete(spark, f"{target}/runs/{name}")
            gone.append(name)
    return gone
