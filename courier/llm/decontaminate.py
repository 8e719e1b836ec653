"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, scanned over whole texts.

A window is ``size`` consecutive words of a benchmark item (an item of fewer words is one window).
The windows are held in a hash table by their rolling hash over exact word numbers, and every hash
hit is verified word by word, so results hold no hash collisions.

The broadcast is bounded: windows are taken in chunks of at most ``chunk_windows``. A benchmark of one
chunk takes one scan without a shuffle. Beyond that, rows get a stored number and each chunk is a job
of its own that stores its hits and then frees its broadcast, so that a worker holds one chunk at any
time, whatever the benchmark's size; the hits meet by row number.

Defined results: null and empty texts have no words and are clean; an item without words gives no
window; windows of an item whose id is null mark words but name no item; repeated items and rows
count as they stand; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_of_words, map_text, spare_name, stored

#: Fixed by the word rule: ASCII letters are lower-cased, ASCII letters, digits and all characters
#: from U+0080 up make words, every other ASCII character separates them.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def normalised(b: bytes | None):
    """The words of a text, in lists of bounded size."""
    return chunks_of_words((b or b"").translate(_TABLE))


class Windows:
    """The windows of some benchmark items: word numbers, windows by length, items by window."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int):
        self.words: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words)) for part in normalised(text) for w in part]
            n = min(size, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                found.setdefault(tuple(ids[i:i + n]), set()).add(item)
        #: length → hash → (window's word numbers, its items); several windows may share a hash
        self.by_length: dict[int, dict[int, list]] = {}
        for n in sorted({len(k) for k in found}):
            windows = [k for k in found if len(k) == n]
            hashes = rolling(np.array(windows, np.int64).ravel(), n)[::n]
            table = self.by_length[n] = {}
            for h, k in zip(hashes.tolist(), windows):
                table.setdefault(h, []).append((k, sorted(i for i in found[k] if i is not None)))

    def scan(self, texts: list) -> list[tuple[int, list, list]]:
        """Per text: words, hit spans (start, end), items with a window in it."""
        ids, counts = [], []
        get = self.words.get
        for b in texts:
            parts = [np.fromiter(map(get, p, repeat(-1)), np.int64, len(p)) for p in normalised(b)]
            counts.append(sum(map(len, parts)))
            ids += [*parts, np.array([-1], np.int64)]  # no window reaches into the next text
        ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
        spans: list[list] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for n, table in self.by_length.items():
            if len(ids) < n:
                continue
            full = np.flatnonzero(known[n:] - known[:-n] == n)  # all n words are benchmark words
            if not len(full):
                continue
            for at, same in zip(full.tolist(), map(table.get, rolling(ids, n)[full].tolist())):
                for window, owners in same or ():
                    if window == tuple(ids[at:at + n].tolist()):
                        d = int(np.searchsorted(starts, at, side="right")) - 1
                        spans[d].append((int(at - starts[d]), int(at - starts[d] + n)))
                        items[d].update(owners)
                        break
        return [(c, merge(s), sorted(i)) for c, s, i in zip(counts, spans, items)]


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every n consecutive numbers, from running sums: the same work for any n."""
    v = (ids.astype(np.uint64) + np.uint64(1)) * _FACTOR
    v ^= v >> np.uint64(29)
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    # the factor is odd, so it has an inverse modulo 2^64
    down = np.cumprod(np.full(len(ids), pow(int(_FACTOR), -1, 1 << 64), np.uint64))
    up = np.cumprod(np.full(len(ids), _FACTOR))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * down)])
    return (sums[n:] - sums[:-n]) * up[n - 1:]


def merge(spans: list) -> list:
    """Sorted spans without overlaps; touching ones are joined."""
    out: list = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _chunks(benchmark: DataFrame, id_col: str, text_col: str, chunk_windows: int):
    """Benchmark items in lists with at most ``chunk_windows`` words (one item at least)."""
    chunk, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t"))
    for r in rows.toLocalIterator():
        n = len(r["t"] or b"") // 2 + 1
        if chunk and size + n > chunk_windows:
            yield chunk
            chunk, size = [], 0
        chunk.append((r["i"], bytes(r["t"] or b"")))
        size += n
    if chunk:
        yield chunk


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", *,
                       item_col: str = "item_id", item_text: str = "text", size: int = 10,
                       chunk_windows: int = 2_000_000, names: tuple = ("n_words", "spans", "items")) -> DataFrame:
    """``keep`` columns, ``n_words``, ``spans`` (hit words, array of [start, end)) and ``items`` per row.

    ``names`` gives the last three other names.
    """
    # one chunk at a time is in the driver's memory; a broadcast of it lies in a file
    chunks = _chunks(benchmark, item_col, item_text, chunk_windows)
    first, second = next(chunks, []), next(chunks, None)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(Windows(first, size))
        return _scan(docs, keep, text_col, shared, names)
    row, text = spare_name([*keep, *names], "row_no"), spare_name([*keep, *names, "row_no"], "text_in")
    own = stored(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(text))
                 .withColumn(row, F.monotonically_increasing_id()), "texts")
    hits = None
    for k, chunk in enumerate(chain([first, second], chunks)):
        shared = docs.sparkSession.sparkContext.broadcast(Windows(chunk, size))
        found = _scan(own, [row], text, shared, names)
        found = stored(found if k == 0 else found.where(F.size(names[1]) > 0), f"hits{k}")
        shared.destroy()
        hits = found if hits is None else hits.unionByName(found)
    together = hits.groupBy(row).agg(
        F.max(names[0]).alias(names[0]), F.flatten(F.collect_list(names[1])).alias(names[1]),
        F.array_distinct(F.flatten(F.collect_list(names[2]))).alias(names[2]))  # a row has one entry a chunk
    return own.drop(text).join(together, row).drop(row)


def _scan(docs: DataFrame, keep: list[str], text_col: str, shared, names: tuple) -> DataFrame:
    def fn(texts):
        found = shared.value.scan(texts)
        return [[f[0] for f in found], [f[1] for f in found], [f[2] for f in found]]

    return map_text(docs, keep, text_col, "`{}` long, `{}` array<array<int>>, `{}` array<string>".format(*names), fn)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", **options) -> DataFrame:
    """``keep`` columns, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` per row."""
    found = find_contamination(docs, benchmark, keep, text_col, **options)
    # spans of one scan are disjoint; those of several chunks may overlap
    ordered = F.array_sort("spans")
    covered = F.aggregate(
        ordered, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(x[1] - F.greatest(x[0], s["to"]), F.lit(0))).cast("long").alias("n"),
                              F.greatest(s["to"], x[1]).alias("to")), lambda s: s["n"])
    return found.select(*keep, "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", *, mode: str = "documents",
                  size: int = 10, **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``mode="spans"``) with the hit words cut out.

    A cut takes the text from the first to the last character of the hit words.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is 'documents' or 'spans'")
    columns = docs.columns
    words, spans, items = (spare_name(columns, f"hit_{n}") for n in ("words", "spans", "items"))
    found = find_contamination(docs, benchmark, columns, text_col, size=size, names=(words, spans, items), **options)
    if mode == "documents":
        return found.where(F.size(spans) == 0).select(*columns)
    cut = spare_name([*columns, spans], "cut_text")
    carried = found.select(*columns, F.to_json(spans).alias(spans))
    out = _cut(carried, columns, text_col, spans, cut)
    return out.select(*[F.col(cut).alias(c) if c == text_col else F.col(c) for c in columns])


def _cut(df: DataFrame, columns: list[str], text_col: str, spans: str, cut: str) -> DataFrame:
    import json

    # the spans travel in front of the text, so that one column carries both
    joined = spare_name([*columns, spans, cut], "spans_and_text")
    df = df.withColumn(joined, F.when(F.col(text_col).isNotNull(), F.concat(F.col(spans), F.lit("\n"), F.col(text_col))))

    def fn(texts):
        out = []
        for b in texts:
            if b is None:
                out.append(None)
                continue
            head, _, text = b.partition(b"\n")
            out.append(cut_words(text, json.loads(head)).decode("utf-8", "replace"))
        return [out]

    return map_text(df, columns, joined, f"`{cut}` string", fn)


def cut_words(text: bytes, spans: list) -> bytes:
    """``text`` without the words [start, end) of each span; the characters between those words go too."""
    if not spans:
        return text
    plain = np.frombuffer(text.translate(_TABLE), np.uint8) != 32
    edges = np.diff(plain.astype(np.int8), prepend=0, append=0)
    first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out, at = [], 0
    for lo, hi in merge(spans):
        out.append(text[at:first[lo]])
        at = end[hi - 1]
    return b"".join([*out, text[at:]])


def items_digest(items) -> str:
    """The digest of a list of item ids, as ``contamination`` gives it."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
