"""A streaming delivery ledger: the current row of every key, kept up to date from a stream.

State is one row per key (``max_by`` on event time), so the order of arrival does not matter: a
late, older write never wins. No watermark by default, because dropping a key's state would let an
older record win later. ``update`` output re-emits a key whenever a row for it arrives; the sink is
idempotent (each micro-batch overwrites its own ``batch=<id>`` folder), and readers keep the last
row per key across batches. Set ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB
provider, as the session helpers do, so that the state is kept on local disk and not in the heap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import latest_delivery
from ..sources import store


def latest_by_key(stream: DataFrame, key_cols: Sequence[str] = ("key",),
                  order_cols: Sequence[str] = ("ts", "delivery_id")) -> DataFrame:
    cols = stream.columns
    return (stream.groupBy(*key_cols)
            .agg(F.max_by(F.struct(*cols), F.struct(*order_cols)).alias("_w")).select("_w.*"))


def stream_delivery_ledger(stream: DataFrame, sink: str, checkpoint: str, *,
                           key_cols: Sequence[str] = ("key",),
                           order_cols: Sequence[str] = ("ts", "delivery_id"),
                           available_now: bool = True, processing_time: str | None = None,
                           compact_every: int = 100):
    """Start the ledger stream; returns the ``StreamingQuery``.

    The number of state partitions is the session's ``spark.sql.shuffle.partitions`` at the first
    start; the checkpoint keeps it. After every ``compact_every`` micro-batches the folders so far are
    merged into one with a row per key, so readers never meet an unbounded number of folders.
    """
    spark = stream.sparkSession
    agg = latest_by_key(stream, key_cols, order_cols)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        folder = f"{sink.rstrip('/')}/batch={batch_id}"
        if compact_every and batch_id and batch_id % compact_every == 0:
            # this batch's folder takes over all earlier rows; those folders go once it is complete
            earlier = read_ledger(spark, sink, key_cols, order_cols)
            latest_delivery(earlier.unionByName(batch.select(*earlier.columns)), key_cols, order_cols).write.mode(
                "overwrite").parquet(f"{sink.rstrip('/')}/.compacting-{batch_id}")
            _replace(spark, f"{sink.rstrip('/')}/.compacting-{batch_id}", folder, sink, batch_id)
        else:
            batch.write.mode("overwrite").parquet(folder)

    w = (agg.writeStream.outputMode("update").foreachBatch(upsert)
         .option("checkpointLocation", checkpoint))
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    elif available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def _replace(spark: SparkSession, made: str, folder: str, sink: str, batch_id: int) -> None:
    """Put the compacted folder in place, then delete the folders it contains. Every step is checked:
    nothing is deleted unless the compacted folder lies where readers look."""
    store.delete(spark, folder)  # an earlier attempt of this batch
    store.rename(spark, made, folder)
    for name in store.names(spark, sink):
        if name.startswith("batch=") and int(name[6:]) < batch_id:
            store.delete(spark, f"{sink.rstrip('/')}/{name}")


def read_ledger(spark: SparkSession, sink: str, key_cols: Sequence[str] = ("key",),
                order_cols: Sequence[str] = ("ts", "delivery_id")) -> DataFrame:
    """Current row of every key across all micro-batch folders."""
    df = spark.read.parquet(sink)
    return latest_delivery(df.drop("batch"), key_cols, order_cols)


def compact_ledger(spark: SparkSession, sink: str, target: str, key_cols: Sequence[str] = ("key",),
                   order_cols: Sequence[str] = ("ts", "delivery_id")) -> DataFrame:
    """Write the current row of every key once into ``target`` (a fresh folder) and return it read
    back: one row per key instead of one per re-emission, so later reads scan far fewer files.
    Readers combine it with newer batches through :func:`read_ledger` on both folders."""
    read_ledger(spark, sink, key_cols, order_cols).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def read_ledgers(spark: SparkSession, paths: Sequence[str], key_cols: Sequence[str] = ("key",),
                 order_cols: Sequence[str] = ("ts", "delivery_id")) -> DataFrame:
    """Current row of every key across a compacted base and the batch folders written after it."""
    dfs = [spark.read.parquet(p) for p in paths]
    dfs = [d.drop("batch") if "batch" in d.columns else d for d in dfs]
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return latest_delivery(out, key_cols, order_cols)


def kafka_delivery_ledger(spark: SparkSession, topic: str, settings, sink: str, checkpoint: str, *,
                          schema=None, starting_offsets: str = "earliest", **kwargs):
    """The ledger fed by a Kafka topic of JSON delivery records (``schema``: the deliveries table's
    by default). Offsets are tracked in ``checkpoint``; needs Spark's Kafka connector on the
    classpath."""
    from ..schema import DELIVERIES
    from ..sources.connectors import kafka_read

    raw = kafka_read(spark, topic, settings, stream=True, startingOffsets=starting_offsets)
    rows = raw.select(F.from_json(F.col("value").cast("string"), schema or DELIVERIES).alias("d")).select("d.*")
    return stream_delivery_ledger(rows, sink, checkpoint, **kwargs)
