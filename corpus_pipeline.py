"""The corpus pipeline: raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` applies them in order and writes each result as Parquet in the shared
checkpoint folder, so that a lost executor costs one stage's tasks and no earlier stage runs again.

Defined results, besides those of the operators: columns other than those of ``documents`` are left
out; rows with null ids pass like any other; of rows that repeat an id and a fingerprint one stays, the
same in every run.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courier.llm.common import stored
from courier.llm.decontaminate import decontaminate
from courier.llm.line_dedup import drop_boilerplate
from courier.llm.packing import pack_documents
from courier.llm.quality_rules import quality_rules
from courier.llm.simhash import fingerprints, members
from courier.session import ship_package
from courier.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted rules take for good and that pass the base rule."""
    ship_package(spark)
    out = quality_rules(docs.select(*COLUMNS), COLUMNS, materialise=lambda df: stored(df, "statistics"))
    return out.where("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; ``n_chars`` follows the text."""
    out = drop_boilerplate(docs.select(*COLUMNS), "source")
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near duplicates: that with the least id."""
    ship_package(spark)
    # written once: fingerprints are computed once and row numbers stay what they are
    rows = stored(fingerprints(docs.select(*COLUMNS), COLUMNS).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    # of a component's ids the least, nulls last; of rows with that id the least fingerprint, then by content
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", F.xxhash64(*COLUMNS).alias("content"), "row")
    own = rows.select("doc_id", "fp", order.alias("place"))
    stay = (own.join(members(own.select("doc_id", "fp"), "doc_id"), "fp").groupBy("root")
            .agg(F.min("place").alias("first")).select(F.col("first.row").alias("row")))
    return rows.join(stay, "row", "left_semi").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    ship_package(spark)
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), mode="documents")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    ship_package(spark)
    return pack_documents(docs.select("doc_id", "text"), ["doc_id"], public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: Expectation-maximisation, connected components and the genetic search are beyond one SQL query.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the table ``documents`` under ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
