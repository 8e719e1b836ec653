"""One query per operator, on the whole tables, with its production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, work_dir
from ..sources.tables import table
from .chat import chat_digests, format_chats
from .classifier import quality_scores
from .common import stored
from .conversations import damaged, repair_digests
from .decontaminate import contamination
from .line_dedup import drop_boilerplate
from .oracles import ORACLE  # noqa: F401
from .packing import pack_documents
from .phrases import collocations
from .quality_rules import quality_rules
from .simhash import near_duplicates
from .substrings import drop_repeats
from .surrogates import replace_pii
from .token_counts import token_counts
from .warc import page_records, read_archives, write_archives

#: The surrogate key of the registered query only; callers of ``replace_pii`` pass a secret of their own.
SURROGATE_KEY = "registered query"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op2_quality_rules(spark, sf_dir):
    out = quality_rules(_documents(spark, sf_dir), ["doc_id"], materialise=lambda df: stored(df, "stats"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "p_good")


def op3_simhash_near_dedup(spark, sf_dir):
    out = near_duplicates(_documents(spark, sf_dir), "doc_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_warc(spark, sf_dir):
    """Writes the pages as WARC archives into the shared folder, then reads the archives back."""
    ship_package(spark)
    path = work_dir(spark, "llm", "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return page_records(read_archives(spark, path, payload=False))


def op4_decontamination(spark, sf_dir):
    return contamination(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op5_packing(spark, sf_dir):
    return pack_documents(_documents(spark, sf_dir), ["doc_id"], public_tokenizers.path("word_bpe_49k.json"))


def op6_chat_formatting(spark, sf_dir):
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(format_chats(turns.unionByName(extra)))


def op7_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, "source").drop("source")


def op8_quality_classifier(spark, sf_dir):
    return quality_scores(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_pii_surrogates(spark, sf_dir):
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op10_token_counts(spark, sf_dir):
    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])


def op11_conversation_repair(spark, sf_dir):
    ship_package(spark)
    turns = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return repair_digests(turns, present=F.col("present")).withColumnRenamed("conv", "conv_id")


def op12_substring_dedup(spark, sf_dir):
    out = drop_repeats(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_phrase_collocations(spark, sf_dir):
    ship_package(spark)
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_packing": op5_packing,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_phrase_collocations": op13_phrase_collocations,
}
