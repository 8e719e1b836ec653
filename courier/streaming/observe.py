"""Byte and file totals observed while data moves, without a second pass over it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..sources import store


def observed_transfer(df: DataFrame, length_col: str = "length", name: str = "transfer"):
    """Attach ``bytes`` and ``files`` metrics to ``df``. Returns ``(observed_df, observation)``;
    after the first action on ``observed_df`` (a write, a count), ``observation.get`` holds them.
    In a stream the same metrics arrive in ``StreamingQueryProgress.observedMetrics``."""
    obs = Observation(name)
    out = df.observe(obs, F.coalesce(F.sum(length_col), F.lit(0)).cast("bigint").alias("bytes"),
                     F.count(F.lit(1)).alias("files"))
    return out, obs


def observed_stream(df: DataFrame, length_col: str = "length", name: str = "transfer") -> DataFrame:
    """Streaming form: named metrics reported with every micro-batch's progress."""
    return df.observe(name, F.coalesce(F.sum(length_col), F.lit(0)).cast("bigint").alias("bytes"),
                      F.count(F.lit(1)).alias("files"))


class TransferMetrics(StreamingQueryListener):
    """Keeps the observed metrics of every micro-batch of observed streams as a table of small files,
    ``<sink>/<query id>/<batch id>.json``: once per batch, also when a query starts again.

    A batch's file is created without overwriting, so a batch that is reported twice counts once. Events
    come after the batch and can be lost with the driver: :meth:`catch_up` records what a query still
    remembers (the last hundred batches or so), and a batch that ran again after a restart is reported
    again. Batches without observed metrics are left out. ``names`` limits the metrics that are kept.
    """

    def __init__(self, spark: SparkSession, sink: str, names=None):
        self.spark, self.sink, self.names = spark, sink.rstrip("/"), set(names) if names is not None else None

    def _record(self, query_id: str, batch_id: int, timestamp: str, metrics: dict) -> None:
        kept = {n: m for n, m in metrics.items() if m and (self.names is None or n in self.names)}
        if kept:
            text = "\n".join(json.dumps({"query_id": query_id, "batch_id": batch_id, "at": timestamp, "name": n, **m}) for n, m in sorted(kept.items()))
            store.create_text(self.spark, f"{self.sink}/{query_id}/{batch_id}.json", text + "\n")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._record(str(p.id), p.batchId, p.timestamp, {n: row.asDict() for n, row in p.observedMetrics.items()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def catch_up(self, query: StreamingQuery) -> None:
        for p in query.recentProgress:
            p = json.loads(p.json) if hasattr(p, "json") else p
            self._record(str(p["id"]), p["batchId"], p["timestamp"], p.get("observedMetrics") or {})


def read_transfer_metrics(spark: SparkSession, sink: str, metrics: str = "bytes long, files long") -> DataFrame:
    """One row per query, batch and metric name, with the columns ``metrics``."""
    return (spark.read.schema(f"query_id string, batch_id long, at string, name string, {metrics}")
            .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(sink))
