"""The driver's tables seen as inventories and delivery ledgers.

* ``documents`` → inventory: key ``<source>/<lang>/doc_<doc_id>.txt``, length = UTF-8 bytes of the
  text, owner = source, content = the text's bytes.
* ``events`` → deliveries: owner ``user.<user_id>``, course = prefix = ``event_type``, folder path
  ``/home/jovyan/materials``, ts, delivery_id = ``event_id``, length = ``floor(value * 1024)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import delivery_keys

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed values used by the mapping of events onto deliveries.
MATERIALS_PATH = "/home/jovyan/materials"
RESULTS_BUCKET = "results"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def document_key():
    return F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"),
                    F.col("doc_id").cast("string"), F.lit(".txt"))


def documents_inventory(spark: SparkSession, sf_dir: str, *, content: bool = False,
                        text: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cols = [document_key().alias("key"), F.octet_length("text").cast("bigint").alias("length"),
            F.col("source").alias("owner"), "lang", "doc_id"]
    if content:
        cols.append(F.encode("text", "UTF-8").alias("content"))
    if text:
        cols.append("text")
    return docs.select(*cols)


def events_deliveries(spark: SparkSession, sf_dir: str, *, bucket: str = RESULTS_BUCKET) -> DataFrame:
    return deliveries_from_events(table(spark, sf_dir, "events"), bucket=bucket)


def deliveries_from_events(ev: DataFrame, *, bucket: str = RESULTS_BUCKET) -> DataFrame:
    """Works on a batch or a streaming DataFrame of ``events``."""
    d = ev.select(
        F.lit(bucket).alias("bucket"),
        F.col("event_type").alias("prefix"),
        F.col("event_type").alias("course"),
        F.lit(MATERIALS_PATH).alias("path"),
        F.concat(F.lit("user."), F.col("user_id").cast("string")).alias("owner"),
        F.floor(F.col("value") * 1024).cast("bigint").alias("length"),
        "ts", F.col("event_id").alias("delivery_id"), "user_id")
    return delivery_keys(d, path_col="path", owner_col="owner", prefix=F.col("prefix"), bucket=F.col("bucket"))
