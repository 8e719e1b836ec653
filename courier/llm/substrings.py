"""Substring dedup: word runs that stand elsewhere earlier, found in prefix-partitioned suffix trees.

A suffix is a text from one of its words on. Repeats of ``window`` words or more are the internal
nodes of the suffix tree at that depth or below; the tree of a whole corpus is cut into subtrees.

* **Variable-length prefixes.** The prefix label of a suffix is a function of its first ``window``
  words: the least hash among the grams (``window // 4`` words) of those words. Suffixes with equal
  prefixes have equal labels, and neighbouring suffixes mostly share one, so they travel together as
  one stretch of words instead of one copy of the prefix each. Labels are counted first. A label that
  occurs once has no internal node below it: its suffixes are dropped before anything is shuffled. A
  label with more than ``heavy`` stretches is lengthened to the whole ``window`` words.
* **Memory-sized groups.** Labels are dealt to as many groups as keep each at about
  ``group_suffixes`` suffixes; no label is larger than ``heavy`` stretches, so none outgrows a group.
* **Subtrees.** A group's suffixes are sorted, the longest common prefixes of neighbours are taken,
  and each maximal run with common prefixes of ``window`` words is a deep internal node; its leaves
  but the earliest are repeats. Below a lengthened prefix all leaves share the node at once, so only
  the earliest leaf is needed, a minimum that is aggregated before the shuffle.
* Consecutive repeated leaves of a text are one maximal span, and spans of a text are merged.

Position order: id (null first), then ``row key`` (a hash of id and text, for rows that repeat an id),
then place in the text.

Defined results: null and blank texts have no words; texts of fewer than ``window`` words keep all;
rows equal in id and text are one document and get the same result; of equal texts under different
ids the least id keeps its words; very long texts are one row each and are never cut (a stretch of
over ``STRETCH`` suffixes travels in parts); an empty table gives an empty result; other columns pass
through, and result names that clash with them raise ``ValueError``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import _slices, spare_name, stored
from .wordarrays import Words, gram_hashes, ranges, sliding

_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)
#: Suffixes of one stretch at most; repetitive texts share one label over any length.
STRETCH = 4096
#: Kinds of marks: words from lo to hi go; the window at lo is the earliest of its kind.
SPAN, FIRST = 0, 1


class _Labels:
    """Prefix labels of all suffixes with ``window`` words, for a slice of texts."""

    def __init__(self, texts: list[bytes], window: int):
        self.window, gram = window, max(1, window // 4)
        self.words = w = Words(texts)
        n, span = len(w), window - gram + 1
        self.size = max(n - window + 1, 0)  # suffixes, valid or not
        if not self.size:
            self.valid = np.zeros(0, bool)
            return
        grams = np.minimum(gram_hashes(w.hash, gram), _NONE - _U(1))
        grams[w.text[:len(grams)] != w.text[gram - 1:]] = _NONE
        self.grams = grams
        self.valid = w.text[:self.size] == w.text[window - 1:]
        self.label = sliding(grams, span)
        # a gram is chosen if it is the least of any valid suffix's prefix
        pad = np.zeros(span - 1, _U)
        most = sliding(np.concatenate((pad, np.where(self.valid, self.label, _U(0)), pad)), span, np.maximum)
        self.chosen = np.flatnonzero((most == grams) & (grams != _NONE))

    def stretches(self, wanted: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """First suffix and number of suffixes of the stretches whose label their text wants."""
        if not self.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = self.words.text[:self.size]
        new = np.ones(self.size, bool)
        new[1:] = (self.label[1:] != self.label[:-1]) | (text[1:] != text[:-1]) | (self.valid[1:] != self.valid[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, self.size))
        keep = self.valid[first].copy()
        lo = np.searchsorted(text[first], np.arange(len(wanted) + 1))
        for i, labels in enumerate(wanted):
            part = slice(lo[i], lo[i + 1])
            keep[part] &= np.isin(self.label[first[part]], labels)
        first, count = first[keep], count[keep]
        parts = -(-count // STRETCH)
        if len(parts) and parts.max() > 1:
            k = ranges(np.zeros(len(parts), np.int64), parts)
            first, count = np.repeat(first, parts) + k * STRETCH, np.minimum(np.repeat(count, parts) - k * STRETCH, STRETCH)
        return first, count

    def own(self, places: np.ndarray) -> np.ndarray:
        """Places among all words as places in the own text."""
        ends = np.cumsum(self.words.counts)
        return places - (ends - self.words.counts)[self.words.text[places]]


def _arrow_map(df: DataFrame, ddl: str | T.StructType, text: str, fn) -> DataFrame:
    """``fn(columns, texts) -> columns``, on slices of bounded text bytes; columns go by name."""
    schema = T._parse_datatype_string(ddl) if isinstance(ddl, str) else ddl
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for lo, hi in _slices(column):
                part = batch.slice(lo, hi - lo)
                texts = column.slice(lo, hi - lo).cast(pa.large_binary()).to_pylist()
                out = fn({n: part.column(i) for i, n in enumerate(part.schema.names)}, texts)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([a if isinstance(a, (pa.Array, pa.ChunkedArray)) and a.type == f.type
                                                      else pa.array(a, f.type) for a, f in zip(out, arrow)], schema=arrow)
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def _longs(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _lists(column) -> list[np.ndarray]:
    """Rows of an array<bigint> column as unsigned arrays; null is empty."""
    return [np.array(v or (), np.int64).view(_U) for v in column.to_pylist()]


def _count_labels(docs: DataFrame, window: int) -> DataFrame:
    """(oid, rid, label, n): how often the prefix labels of a text were chosen in it."""

    def fn(cols, texts):
        labels = _Labels(texts, window)
        if not labels.size or not len(labels.chosen):
            return None
        doc, value = labels.words.text[labels.chosen], labels.grams[labels.chosen]
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1]))))
        at = doc[first]
        return [_longs(cols["oid"])[at], _longs(cols["rid"])[at], value[first].view(np.int64),
                np.diff(np.append(first, len(doc)))]

    return _arrow_map(docs.select("oid", "rid", "text"), "oid long, rid long, label long, n long", "text", fn)


def _stretches(rows: DataFrame, window: int) -> DataFrame:
    """(label, oid, rid, start, words): the stretches of the light labels; words as 32-bit hashes."""

    def fn(cols, texts):
        labels = _Labels(texts, window)
        first, count = labels.stretches(_lists(cols["light"]))
        if not len(first):
            return None
        words = (labels.words.hash & _U(0xFFFFFFFF)).astype(np.uint32)[ranges(first, count + window - 1)]
        ends = np.concatenate(([0], np.cumsum(count + window - 1))) * 4
        body = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(words)])
        at = labels.words.text[first]
        return [labels.label[first].view(np.int64), _longs(cols["oid"])[at], _longs(cols["rid"])[at],
                labels.own(first), body]

    return _arrow_map(rows, "label long, oid long, rid long, start long, words binary", "text", fn)


def _subtree(window: int):
    """The repeated leaves of a group's suffixes as spans (oid, rid, kind, lo, hi)."""
    names = ["oid", "rid", "kind", "lo", "hi"]

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        del parts
        oid, rid, start = (_longs(t[c].combine_chunks()) for c in ("oid", "rid", "start"))
        order = np.lexsort((start, rid, oid))  # leaves are numbered by position
        oid, rid, start = oid[order], rid[order], start[order]
        t = t.select(["words"]).take(pa.array(order)).combine_chunks()
        body = t["words"].combine_chunks()
        body = body if isinstance(body, pa.Array) else body.chunk(0)
        offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset:body.offset + len(body) + 1]
        words = np.frombuffer(body.buffers()[2], np.uint32, (offsets[-1] - offsets[0]) // 4, offsets[0])
        size = np.diff(offsets) // 4
        leaves = size - window + 1
        at = (offsets[:-1] - offsets[0]) // 4
        suffix = ranges(at, leaves)
        row = np.repeat(np.arange(len(leaves)), leaves)
        place = start[row] + suffix - at[row]
        prefix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(words, window)[suffix])
        order = np.argsort(prefix.view(f"S{4 * window}").ravel(), kind="stable")
        # common prefix of neighbours in suffix order; a deep node is a run of full ones
        prefix = prefix[order]
        common = np.cumprod(prefix[1:] == prefix[:-1], axis=1, dtype=np.int8).sum(axis=1)
        del prefix
        node = np.cumsum(np.concatenate(([True], common < window))) - 1
        first = order[np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))][node]
        a, b = row[order], row[first]
        later = (oid[a] != oid[b]) | (rid[a] != rid[b]) | (place[order] != place[first])
        hit = np.zeros(len(order), bool)
        hit[order] = later
        # repeated leaves next to each other in a stretch are one span
        hits = np.flatnonzero(hit)
        if len(hits):
            new = np.concatenate(([True], (np.diff(hits) > 1) | (row[hits[1:]] != row[hits[:-1]])))
            lo = hits[new]
            hi = hits[np.append(np.flatnonzero(new)[1:] - 1, len(hits) - 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(oid[row[lo]]), pa.array(rid[row[lo]]), pa.array(np.full(len(lo), SPAN), pa.int64()),
                 pa.array(place[lo]), pa.array(place[hi] + window)], names=names)

    return run


def _heavy_windows(labels: _Labels, cols) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes below heavy labels: their place among all words, and their two 64-bit prefix hashes."""
    first, count = labels.stretches(_lists(cols["heavy"]))
    at = ranges(first, count)
    both = np.stack([gram_hashes(labels.words.hash, labels.window, k)[at] for k in (0, 1)], axis=1) if len(at) else np.zeros((0, 2), _U)
    return at, both


def _firsts(rows: DataFrame, window: int) -> DataFrame:
    """(oid, rid, kind, lo, hi): the earliest suffix of every whole prefix below a heavy label."""

    def fn(cols, texts):
        labels = _Labels(texts, window)
        at, both = _heavy_windows(labels, cols)
        if not len(at):
            return None
        text, place = labels.words.text[at], labels.own(at)
        oid, rid = _longs(cols["oid"])[text], _longs(cols["rid"])[text]
        order = np.lexsort((place, rid, oid, both[:, 1], both[:, 0]))
        b = both[order]
        first = order[np.concatenate(([True], (b[1:] != b[:-1]).any(axis=1)))]
        return [both[first, 0].view(np.int64), both[first, 1].view(np.int64), oid[first], rid[first], place[first]]

    found = _arrow_map(rows, "h1 long, h2 long, oid long, rid long, start long", "text", fn)
    least = found.groupBy("h1", "h2").agg(F.min(F.struct("oid", "rid", "start")).alias("p"))
    return least.select("p.oid", "p.rid", F.lit(FIRST).cast("long").alias("kind"),
                        F.col("p.start").alias("lo"), F.col("p.start").alias("hi"))


def _removed(n_words: int, spans, heavy: np.ndarray, firsts: np.ndarray, window: int) -> np.ndarray:
    """Which words of a text go: those in spans, and those of heavy suffixes that are not the first."""
    edge = np.zeros(n_words + 1, np.int64)
    for lo, hi in spans:
        edge[lo] += 1
        edge[hi] -= 1
    late = np.setdiff1d(heavy, firsts)
    np.add.at(edge, late, 1)
    np.add.at(edge, late + window, -1)
    return np.cumsum(edge[:-1]) > 0


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 20,
                 heavy: int = 4096, group_suffixes: int = 1 << 20) -> DataFrame:
    """All columns, and ``kept_text`` (the words that stay, single spaces), ``n_words``, ``n_removed``
    and ``spans`` (the merged [from, to) word ranges that went)."""
    new = ["kept_text", "n_words", "n_removed", "spans"]
    clash = {c.lower() for c in docs.columns} & set(new)
    if clash:
        raise ValueError(f"columns clash with results: {sorted(clash)}")
    if len({c.lower() for c in docs.columns}) < len(docs.columns):
        raise ValueError("columns of the table repeat a name")
    inner = {c: spare_name(["oid", "rid", "text", "light", "heavy", "marks"], f"c{i}") for i, c in enumerate(docs.columns)}
    spark = docs.sparkSession
    oid = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)).cast("long"))
    text = F.col(f"`{text_col}`").cast("string")
    src = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items() if c != text_col],
                      oid.alias("oid"), F.xxhash64(f"`{id_col}`", text).alias("rid"), text.alias("text"))

    counts = stored(_count_labels(src, window), "labels")
    total = counts.agg(F.sum("n")).first()[0] or 0
    repeated = stored(counts.groupBy("label").agg(F.sum("n").alias("total")).where("total > 1"), "repeated")
    # labels with a 1,024th of all stretches: at most 1,024 of them, so they can be broadcast
    most = max(2, total // 1024 + 1)
    hot = F.broadcast(repeated.where(F.col("total") >= most))
    spread = counts.join(hot.select("label"), "label", "left_anti").join(repeated.where(F.col("total") < most), "label")
    wanted = counts.join(hot, "label").unionByName(spread)
    is_heavy = F.col("total") > heavy
    wanted = (wanted.groupBy("oid", "rid")
              .agg(F.collect_list(F.when(~is_heavy, F.col("label"))).alias("light"),
                   F.collect_list(F.when(is_heavy, F.col("label"))).alias("heavy")))

    # one shuffle of the texts serves the three joins below
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = src.repartition(parts, "oid", "rid")
    rows = texts.join(wanted, ["oid", "rid"])
    light = repeated.where(~is_heavy).agg(F.sum("total")).first()[0] or 0
    per_label = max(1, window - max(1, window // 4) + 2) / 2
    groups = max(parts, -(-int(light * per_label) // group_suffixes))
    schema = "oid long, rid long, kind long, lo long, hi long"
    spans = _stretches(rows.where(F.size("light") > 0), window).repartition(groups, "label").mapInArrow(_subtree(window), schema)
    marks = spans.unionByName(_firsts(rows.where(F.size("heavy") > 0), window))
    marks = marks.groupBy("oid", "rid").agg(F.collect_list(F.struct("kind", "lo", "hi")).alias("marks"))
    joined = texts.join(wanted, ["oid", "rid"], "left").join(marks, ["oid", "rid"], "left")

    keep = [c for c in docs.columns if c != text_col]
    fields = [docs.schema[c] for c in keep]
    out = T.StructType([*[T.StructField(inner[c], f.dataType, True) for c, f in zip(keep, fields)],
                        *([T.StructField("text_out", T.StringType(), True)]),
                        *T._parse_datatype_string("kept_text string, n_words long, n_removed long, spans array<struct<lo:long,hi:long>>").fields])
    names = [inner[c] for c in keep]

    def fn(cols, texts):
        heavy_of = cols["heavy"].to_pylist()
        labels = _Labels(texts, window) if any(heavy_of) else None
        if labels is not None:
            at, _ = _heavy_windows(labels, cols)
            place, lo = labels.own(at), np.searchsorted(labels.words.text[at], np.arange(len(texts) + 1))
        kept, n_words, n_removed, gone = [], [], [], []
        for i, (b, found) in enumerate(zip(texts, cols["marks"].to_pylist())):
            words = (b or b"").split()
            mine = place[lo[i]:lo[i + 1]] if heavy_of[i] else np.zeros(0, np.int64)
            n_words.append(len(words))
            if found or len(mine):
                mask = _removed(len(words), [(m["lo"], m["hi"]) for m in found or () if m["kind"] == SPAN], mine,
                                np.array([m["lo"] for m in found or () if m["kind"] == FIRST], np.int64), window)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                kept.append(b" ".join([w for w, m in zip(words, mask.tolist()) if not m]))
                n_removed.append(int(mask.sum()))
                gone.append([{"lo": x, "hi": y} for x, y in edge.reshape(-1, 2).tolist()])
            else:
                kept.append(b" ".join(words))
                n_removed.append(0)
                gone.append([])
        utf8 = pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
        return [*[cols[n] for n in names], cols["text"].cast(pa.string()), utf8, n_words, n_removed, gone]

    result = _arrow_map(joined, out, "text", fn)
    back = {c: ("text_out" if c == text_col else inner[c]) for c in docs.columns}
    return result.select(*[F.col(n).alias(c) for c, n in back.items()], *new)
