"""Line de-duplication by site-relative frequency.

Pages are grouped by host. A line (white space around it stripped) is boilerplate of a host if more
than ``ratio`` of the host's pages contain it, in ``min_pages`` pages at least. Boilerplate lines are
dropped from the pages of their host; a page that would have no other line left is a copy of a whole
page rather than boilerplate and stays as it is, for document de-duplication to judge.

Lines are counted as 64-bit hashes, combined within each task before the shuffle. A host has at most
(its distinct lines per page / ratio) boilerplate lines, however many pages it has, so the lines of a
host fit one small array that is joined to its pages.

Defined results: null hosts form a host of their own; a null text stays null and counts as a page
without lines; empty lines are kept and never counted; a line counts once per page; repeated rows
are pages of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spare_name

#: Pages of one host meet its lines in so many tasks: a host with a third of all pages is no hot key.
SALTS = 64
_BLANKS = " \t\x0b\x0c\r"


def _lines(text_col: str):
    return F.split(F.col(text_col), "\n", -1)


def _hash(line):
    return F.xxhash64(F.btrim(line, F.lit(_BLANKS)))


def boilerplate(docs: DataFrame, host_col: str, text_col: str = "text", *, ratio: float = 0.1,
                min_pages: int = 3) -> DataFrame:
    """(host, line_hash, pages_with_line, host_pages) of every boilerplate line."""
    host = F.col(host_col).alias("host")
    totals = docs.groupBy(host).agg(F.count("*").alias("host_pages"))
    empty = _hash(F.lit(""))
    hashes = F.array_remove(F.array_distinct(F.transform(_lines(text_col), _hash)), empty)
    counts = (docs.select(host, F.explode(hashes).alias("line_hash"))
              .groupBy("host", "line_hash").agg(F.count("*").alias("pages_with_line"))
              .where(F.col("pages_with_line") >= min_pages))
    found = counts.join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return found.where(F.col("pages_with_line") > ratio * F.col("host_pages"))


def drop_boilerplate(docs: DataFrame, host_col: str, text_col: str = "text", *, ratio: float = 0.1,
                     min_pages: int = 3) -> DataFrame:
    """``docs`` with its columns, the text without boilerplate lines, and ``n_lines``, ``n_dropped``."""
    columns = docs.columns
    new = {"n_lines", "n_dropped"} & {c.lower() for c in columns}
    if new:
        raise ValueError(f"columns clash with results: {sorted(new)}")
    known = spare_name(columns, "boilerplate_lines")
    host = spare_name([*columns, known], "boilerplate_host")
    kept = spare_name([*columns, known, host], "kept_lines")
    salt, row_salt = spare_name(columns, "host_salt"), spare_name(columns, "row_salt")
    lines = boilerplate(docs, host_col, text_col, ratio=ratio, min_pages=min_pages)
    # by host: a small array, bounded as the module says, repeated for every salt
    per_host = lines.groupBy(F.col("host").alias(host)).agg(F.collect_set("line_hash").alias(known))
    per_host = per_host.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = docs.withColumn(row_salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(SALTS)).cast("int"))
    joined = salted.join(per_host, (F.col(row_salt) == F.col(salt)) & F.col(host_col).eqNullSafe(F.col(host)), "left")
    every = _lines(text_col)
    rest = F.when(F.col(known).isNotNull(),
                  F.filter(every, lambda x: ~F.array_contains(F.col(known), _hash(x))))
    out = joined.withColumn(kept, rest)
    # whole if nothing was found, or if no line with a word would be left
    whole = F.col(kept).isNull() | (F.length(F.btrim(F.array_join(kept, ""), F.lit(_BLANKS))) == 0)
    n = F.coalesce(F.size(every), F.lit(0)).cast("long")
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(n)
    dropped = F.when(whole, F.lit(0).cast("long")).otherwise(n - F.size(kept).cast("long"))
    text = F.when(whole, F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in columns],
                      n_lines.alias("n_lines"), dropped.alias("n_dropped"))
