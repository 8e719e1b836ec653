"""Phrase collocations from a weighted de Bruijn graph of word grams.

Edges are the longest grams (``longest`` words), nodes their shorter prefixes. Every word position of
a text contributes one edge: the longest gram that starts there. Near the end of a piece it is shorter,
a *piece-end correction* of the node it stops at. A node's count is then the flow through it: the
weights of the edges that leave it plus the corrections that end in it. So only one gram per position
is ever aggregated, and the counts of all shorter phrases follow level by level from far fewer rows.

* **Breaks.** A pair of words that occurs fewer than ``min_count`` times is in no candidate, so a gram
  may stop before it like at a piece end, and the flows stay exact. Such pairs are found with a table
  of counters: pairs are hashed to buckets, a bucket's sum below ``min_count`` proves all its pairs
  rare. The table has one bit per bucket on every worker; its size follows the text and ends at
  ``max_filter_bits`` (16 MB by default). Beyond that fewer pairs are cut away and more grams travel;
  results are the same.
* **Unary paths.** A node all of whose flow goes on through one edge to the right, or came in through
  one edge from the left, is inside a unary path: the longer phrase says all it says. Such nodes are
  compacted into their path (they are no results). A longer phrase with the same count always passes
  through a node of one more word with that count, so one step decides.
* **Scores.** For each cut of a candidate into two parts: floor(1000 · a · n / (l · r)) in whole
  decimals; the least cut counts.

Everything is per group (language). Aggregations combine before their shuffle; look-ups of part counts
are salted, and the best phrases per group are taken per partition first, so no group meets whole in
one task.

Defined results: null groups are ``und``; null, empty and blank texts have no words; texts of any
length are counted whole; repeated rows count as often as they occur; ties in score go by count, then
by phrase in byte order; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import _slices, stored
from .wordarrays import Words, gram_hashes, mix

_U = np.uint64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes between words, and those of them that end a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
GAPS = b" \t" + ENDS
#: Pairs gathered in a task before their buckets are sent; distinct grams gathered likewise.
PAIRS_AT_ONCE, GRAMS_AT_ONCE = 1 << 22, 200_000
BLOCKS = 4096
SALTS = 16


class _Pieces:
    """Words of a slice of texts, with their group and whether the next word follows in the piece."""

    def __init__(self, texts, groups: list[str]):
        self.words = w = Words([None if t is None else t.translate(_LOWER) for t in texts], GAPS)
        names, code = np.unique(np.array(groups, object).astype(str), return_inverse=True)
        self.names, self.group = names.tolist(), code[w.text]
        # one word's bytes count differently in every group
        tag = np.array([hash_name(n) for n in self.names], _U)
        self.hash = w.hash ^ tag[self.group] if len(w) else w.hash
        stop = np.zeros(256, np.int64)
        stop[list(ENDS)] = 1
        stops = np.concatenate(([0], np.cumsum(stop[w.buf])))
        follows = np.zeros(len(w), bool)
        if len(w) > 1:
            follows[:-1] = (w.text[1:] == w.text[:-1]) & (stops[w.start[1:]] == stops[w.end[:-1]])
        self.follows = follows

    def pairs(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Word places with a follower, and the bucket of each such pair."""
        at = np.flatnonzero(self.follows)
        return at, (gram_hashes(self.hash, 2)[at] >> _U(64 - bits)).astype(np.int64)


def hash_name(name: str) -> int:
    w = Words([name.encode()], b"\x00")
    return int(np.bitwise_xor.reduce(mix(w.hash + np.arange(1, len(w) + 1, dtype=_U)))) if len(w) else 0


def _batches(batches):
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        groups = batch.column(batch.schema.get_field_index("grp"))
        for lo, hi in _slices(column):
            yield _Pieces(column.slice(lo, hi - lo).cast(pa.large_binary()).to_pylist(), groups.slice(lo, hi - lo).to_pylist())
        pa.default_memory_pool().release_unused()


def _frequent_pairs(rows: DataFrame, min_count: int, bits: int, parts: int) -> np.ndarray:
    """One bit per bucket of word pairs: whether its pairs occur ``min_count`` times together."""
    block_bits = max(bits - 12, 3)
    blocks = 1 << (bits - block_bits)

    def packed(held):
        bucket, n = np.unique(np.concatenate(held), return_counts=True)
        block = bucket >> block_bits
        cut = np.searchsorted(block, np.arange(blocks + 1))
        offset = (bucket & ((1 << block_bits) - 1)).astype(np.uint32)
        n = np.minimum(n, 0xFFFFFFFF).astype(np.uint32)
        used = np.flatnonzero(np.diff(cut))
        yield pa.RecordBatch.from_arrays([
            pa.array(used.astype(np.int32)),
            pa.array([offset[cut[b]:cut[b + 1]].tobytes() for b in used], pa.binary()),
            pa.array([n[cut[b]:cut[b + 1]].tobytes() if (n[cut[b]:cut[b + 1]] > 1).any() else None for b in used], pa.binary()),
        ], names=["block", "offsets", "counts"])

    def count(batches):
        held, size = [], 0
        for pieces in _batches(batches):
            bucket = pieces.pairs(bits)[1]
            held.append(bucket)
            size += len(bucket)
            if size >= PAIRS_AT_ONCE:
                yield from packed(held)
                held, size = [], 0
        if size:
            yield from packed(held)

    def add(batches):
        sums = {}
        for batch in batches:
            for block, offsets, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at = np.frombuffer(offsets, np.uint32)
                own = sums.setdefault(block, np.zeros(1 << block_bits, np.uint32))
                n = np.uint32(1) if counts is None else np.frombuffer(counts, np.uint32)
                own[at] = np.minimum(own[at].astype(np.int64) + n, min_count)
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([
            pa.array(keys, pa.int32()),
            pa.array([np.packbits(sums[k] >= min_count, bitorder="little").tobytes() for k in keys], pa.binary())],
            names=["block", "bits"])

    sums = (rows.mapInArrow(count, "block int, offsets binary, counts binary").repartition(parts, "block")
            .mapInArrow(add, "block int, bits binary"))
    out = np.zeros((blocks, (1 << block_bits) // 8), np.uint8)
    for r in sums.collect():  # one bit per bucket: a bounded size
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _grams(rows: DataFrame, longest: int, bits: int, frequent) -> DataFrame:
    """(grp, gram, size, n): one gram per word position, counted per task."""

    def run(batches):
        held: dict = {}

        def flush():
            keys = list(held)
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.binary()).cast(pa.string()),
                pa.array([k[2] for k in keys], pa.int32()), pa.array(list(held.values()), pa.int64())],
                names=["grp", "gram", "size", "n"])
            held.clear()

        table = frequent.value
        for pieces in _batches(batches):
            w = pieces.words
            if not len(w):
                continue
            at, bucket = pieces.pairs(bits)
            link = np.zeros(len(w) + longest, np.int64)
            link[at] = (table[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1
            size = np.ones(len(w), np.int64)
            more = np.ones(len(w), np.int64)
            for k in range(longest - 1):
                more = more * link[k:k + len(w)]
                size += more
            # equal grams of the slice: same words, group and size
            code = np.zeros(len(w), _U)
            for s in range(1, longest + 1):
                own = np.flatnonzero(size == s)
                if len(own):
                    code[own] = gram_hashes(pieces.hash, s)[own] + _U(s)
            order = np.argsort(code, kind="stable")
            new = np.flatnonzero(np.concatenate(([True], code[order][1:] != code[order][:-1])))
            count = np.diff(np.append(new, len(order)))
            pos = order[new]
            data, start, end = w.data, w.start.tolist(), w.end.tolist()
            for p, s, n, g in zip(pos.tolist(), size[pos].tolist(), count.tolist(), pieces.group[pos].tolist()):
                gram = data[start[p]:end[p]] if s == 1 else b" ".join([data[start[p + k]:end[p + k]] for k in range(s)])
                key = (pieces.names[g], gram, s)
                held[key] = held.get(key, 0) + n
            if len(held) >= GRAMS_AT_ONCE:
                yield from flush()
        if held:
            yield from flush()

    found = rows.mapInArrow(run, "grp string, gram string, size int, n long")
    return found.groupBy("grp", "gram", "size").agg(F.sum("n").alias("n"))


def _part(size, first: bool):
    """The first or last ``size`` words of ``gram``."""
    return F.expr(f"substring_index(gram, ' ', {'' if first else '-'}({size}))")


def phrase_counts(docs: DataFrame, group_col: str = "lang", text_col: str = "text", *, longest: int = 5,
                  min_count: int = 100, max_filter_bits: int = 1 << 27) -> tuple[DataFrame, DataFrame]:
    """(grp, gram, size, f) of all phrases of up to ``longest`` words that occur ``min_count`` times, and
    (grp, total) with the number of words of each group. Both are stored tables."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit("und")).alias("grp"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # about a word pair in six bytes: a bucket then gathers a sixth of min_count from rare pairs
    bits = min(max(16, (n_bytes // max(min_count, 1)).bit_length()), max_filter_bits.bit_length() - 1)
    frequent = spark.sparkContext.broadcast(_frequent_pairs(rows, min_count, bits, parts))
    edges = stored(_grams(rows, longest, bits, frequent), "grams")
    totals = stored(edges.groupBy("grp").agg(F.sum("n").alias("total")), "totals")

    # the flow through the nodes, from the longest to single words
    level = edges.where(F.col("size") == longest).select("grp", "gram", "n")
    found = []
    for size in range(longest, 0, -1):
        found.append(level.where(F.col("n") >= min_count).select("grp", "gram", F.lit(size).alias("size"), F.col("n").alias("f")))
        if size > 1:
            inner = level.select("grp", _part(size - 1, True).alias("gram"), "n")
            ends = edges.where(F.col("size") == size - 1).select("grp", "gram", "n")
            level = inner.unionByName(ends).groupBy("grp", "gram").agg(F.sum("n").alias("n"))
            if size > 2:
                level = stored(level, f"nodes{size - 1}")
    counts = found[0]
    for f in found[1:]:
        counts = counts.unionByName(f)
    return stored(counts, "phrases"), totals


def compact_unary_paths(counts: DataFrame) -> DataFrame:
    """The phrases of two words or more that are not inside a unary path: none of their one-word
    extensions has their whole count."""
    longer = counts.where("size > 2")
    ends = longer.select("grp", F.explode(F.array(_part("size - 1", True), _part("size - 1", False))).alias("gram"), "f")
    ends = ends.groupBy("grp", "gram").agg(F.max("f").alias("longer_f"))
    return (counts.where("size > 1").join(ends, ["grp", "gram"], "left")
            .where(F.col("longer_f").isNull() | (F.col("longer_f") < F.col("f"))).drop("longer_f"))


def collocations(docs: DataFrame, group_col: str = "lang", text_col: str = "text", *, longest: int = 5,
                 min_count: int = 100, top: int = 2000, scale: int = 1000, max_filter_bits: int = 1 << 27) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each group."""
    counts, totals = phrase_counts(docs, group_col, text_col, longest=longest, min_count=min_count,
                                   max_filter_bits=max_filter_bits)
    # part counts are looked up under salts: one word may be part of a third of all phrases
    parts = counts.where(F.col("size") < longest).withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    parts = parts.select("grp", "gram", "salt", "f")
    cuts = compact_unary_paths(counts).select(
        "grp", "gram", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"), "size")
    cuts = cuts.select("grp", F.col("gram").alias("phrase"), "a", "k", _part("k", True).alias("head"),
                       _part("size - k", False).alias("tail"),
                       F.pmod(F.xxhash64("grp", "gram"), F.lit(SALTS)).cast("int").alias("salt"))
    for name, out in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(parts.withColumnsRenamed({"gram": name, "f": out}), ["grp", name, "salt"])
    whole = cuts.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "grp").withColumnRenamed("total", "n")
    exact = "cast({} as decimal(19, 0))"
    score = F.expr(f"(cast(cast({scale} as decimal(9, 0)) * {exact.format('a')} * cast(n as decimal(19, 0)) as decimal(38, 0)))"
                   f" div (cast({exact.format('l')} * {exact.format('r')} as decimal(38, 0)))")
    best = F.struct(score.alias("score"), "k", "l", "r")
    scored = whole.groupBy("grp", "phrase", "a", "n").agg(F.min(best).alias("cut"))
    scored = scored.select(F.col("grp").alias("lang"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
