"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

An individual is a grouping: which pieces share a sequence (bin). Crossover injects whole
well-filled bins of one parent into the other, removes the bins that would hold a piece twice, and
best-fits the displaced pieces; mutation dissolves the emptiest bins. Pieces are dealt by a hash of
their row number into shards of bounded size. Each shard is searched by several islands, each a
Spark task with its own population; after an epoch every island sends its elite to the next island
of the ring. Shards that reach the lower bound (total length / capacity, rounded up) stop at once.
Of every shard the emptiest bins, up to a quarter of its items and at least one, are dissolved and
pooled for a next level of at most half the shards, until one shard holds what is left: the room that
shards could not fill ends up in that one. A level's shard holds at most ``shard_items`` items about, or
what two bins hold if that is more.

Defined results: a null or empty text is the end token alone; texts over the capacity, and only
they, are cut into pieces of the capacity; repeated rows are rows of their own; ids may be null; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import unicodedata
import zlib
from bisect import bisect_left, insort
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, stored
from .token_counts import byte_symbols

#: Pieces a worker remembers, about (a cache, results do not depend on it).
CACHE_PIECES = 500_000
#: Pieces whose ids are put together at a time.
BLOCK_PIECES = 1 << 18
#: Fixed pattern: this pre-tokenizer drops white space, so pieces between spaces are independent.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Byte (as a Latin-1 character) → the printable character that stands for it in byte-level vocabularies.
_BYTES = {b: c for b, c in enumerate(byte_symbols())}
#: Marks that end a piece and neither begin a special token nor a contraction.
_MARKS = ",.;:!?#*$%&"
#: First character behind the Latin letters.
_LATIN_END = "\u0250"


class Encoder:
    """Token ids (little-endian unsigned 32-bit, as bytes) of whole texts by a tokenizer file."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        added = spec.get("added_tokens", [])
        self.by_piece = (len(pre) == 2 and pre[0].get("type") == "Split" and pre[0]["pattern"].get("Regex") == _SPLIT
                         and pre[0].get("invert") and pre[0].get("behavior") == "Removed"
                         and pre[1].get("type") == "ByteLevel" and not pre[1].get("add_prefix_space")
                         and [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
                         == ["NFC", "Replace", "Lowercase"]
                         and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in added))
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.id_bytes = [i.to_bytes(4, "little") for i in range(top + 1)]
        self.known: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of one normalised word of letters, which is one pre-token: the merges alone."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        ids = self.id_bytes
        return b"".join([ids[t.id] for t in self.tokenizer.model.tokenize(word)])

    def _learn(self, pieces: list[str]) -> None:
        known, rest = self.known, []
        ends: dict[str, list] = {"": []}
        for p in pieces:
            core = p.rstrip(_MARKS)
            if core.isascii():
                word = core.lower()
                plain = word.isalpha()
            else:  # other scripts, and letters that fall to marks, are left to the library
                word = unicodedata.normalize("NFC", core).lower()
                plain = word.isalpha() and max(word) < _LATIN_END
            if not plain:
                rest.append(p)
                continue
            if word not in known:
                known[word] = self._word(word)
            if word != p:
                ends.setdefault(p[len(core):], []).append((p, word))
        for p, found in zip(rest, self._plain(rest)) if rest else ():
            known[p] = found
        # a run of marks behind the letters is a pre-token of its own
        for (_, own), end in zip(ends.items(), [b"", *self._plain(list(ends)[1:])]):
            for p, word in own:
                known[p] = known[word] + end

    def _ids(self, pieces: list[str]) -> list[bytes]:
        ids = list(map(self.known.get, pieces))
        missing = [p for p, i in zip(pieces, ids) if i is None]
        if missing:
            known = self.known
            if len(known) + len(missing) > CACHE_PIECES:
                # pieces met first are the common ones and stay; the rare ones since then go
                for p in list(islice(known, CACHE_PIECES // 2, None)):
                    del known[p]
            self._learn(missing)
            ids = [known[p] if i is None else i for p, i in zip(pieces, ids)]
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece or not texts:
            return self._plain(texts)
        # the tokenizer lower-cases; doing so first makes fewer pieces (not near special-token strings)
        column = pa.array([(t.lower() if t.isascii() and "<" not in t else t).replace("\n", " ") for t in texts],
                          pa.string())
        lists = pc.split_pattern(column, " ")
        coded = lists.flatten().dictionary_encode()  # every piece is looked up once a call
        pieces = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")
        ids = self._ids(pieces[0].as_py().split(" "))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        firsts = np.cumsum(sizes) - sizes
        table, number = np.frombuffer(b"".join(ids), "<u4"), coded.indices.to_numpy()
        out, ends = [], np.concatenate([[0], np.cumsum(sizes[number])])
        for lo in range(0, len(number), BLOCK_PIECES):
            block = number[lo:lo + BLOCK_PIECES]
            n = sizes[block]
            at = np.repeat(firsts[block] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out.append(table[at].tobytes())
        whole = b"".join(out)
        cuts = (4 * ends[lists.offsets.to_numpy()]).tolist()
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def cut(ids: bytes, capacity: int) -> list[dict]:
    """Pieces of one document's ids; only documents over ``capacity`` have several."""
    n, step = len(ids) // 4, 4 * capacity
    return [{"piece": k, "start": k * capacity, "length": min(capacity, n - k * capacity),
             "ids_crc32": zlib.crc32(ids[k * step:(k + 1) * step])} for k in range(max(1, math.ceil(n / capacity)))]


def pieces(docs: DataFrame, keep: list[str], vocabulary: str, text_col: str = "text", *, capacity: int = 4096,
           end_id: int = 1) -> DataFrame:
    """``keep`` columns, ``piece``, ``start``, ``length``, ``ids_crc32`` of every piece of every row."""
    end = np.array([end_id], "<u4").tobytes()

    def fn(texts):
        ids = encoder(vocabulary).encode([(b or b"").decode("utf-8", "replace") for b in texts])
        return [[cut(x + end, capacity) for x in ids]]

    kind = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
    return map_text(docs, keep, text_col, f"pieces_of {kind}", fn).select(*keep, F.inline("pieces_of"))


def lower_bound(lengths, capacity: int) -> int:
    """No grouping has fewer bins: total length, and pieces over half the capacity never share."""
    lengths = np.asarray(lengths, np.int64)
    return max(math.ceil(int(lengths.sum()) / capacity), int((2 * lengths > capacity).sum()))


def best_fit(order, lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Put the pieces ``order`` into the bin with the least room that suffices, or into a new one."""
    room = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            free, k = room.pop(at)
            bins[k].append(i)
        else:
            free, k = capacity, len(bins)
            bins.append([i])
        if free > lengths[i]:
            insort(room, (free - lengths[i], k))
    return bins


def fill(bins, lengths, capacity: int) -> list[int]:
    return [sum(lengths[i] for i in b) for b in bins]


def fitness(bins, lengths, capacity: int) -> tuple:
    """Fewer bins first, then fuller ones: the sum of squared fillings."""
    return -len(bins), sum(x * x for x in fill(bins, lengths, capacity))


def crossover(a, b, lengths, capacity: int, rng) -> list[list[int]]:
    """Whole well-filled bins of ``a`` injected into ``b``."""
    filled = fill(a, lengths, capacity)
    ranked = sorted(range(len(a)), key=lambda k: -filled[k])
    top = ranked[:max(1, len(a) // 2)]
    chosen = rng.choice(len(top), size=max(1, len(top) // 2), replace=False)
    injected = [list(a[top[k]]) for k in sorted(chosen)]
    inside = {i for x in injected for i in x}
    child, displaced = injected, []
    for x in b:
        if inside.isdisjoint(x):
            child.append(list(x))
        else:
            displaced += [i for i in x if i not in inside]
    displaced.sort(key=lambda i: -lengths[i])
    return best_fit(displaced, lengths, child, capacity)


def mutate(bins, lengths, capacity: int, rng) -> list[list[int]]:
    """Dissolve the emptiest bin and a few at random, best-fit their pieces in random order."""
    filled = fill(bins, lengths, capacity)
    gone = {int(np.argmin(filled)), *map(int, rng.integers(0, len(bins), size=min(len(bins), 3)))}
    loose = [i for k in gone for i in bins[k]]
    rng.shuffle(loose)
    return best_fit(loose, lengths, [list(x) for k, x in enumerate(bins) if k not in gone], capacity)


def first_individuals(lengths: list[int], capacity: int, size: int, rng) -> list:
    """Best-fit decreasing, then the same with lengths jittered so that the order differs."""
    keys = np.array(lengths, float)
    out = []
    for k in range(size):
        order = np.argsort(-(keys * (1 + 0.1 * rng.random(len(keys)) if k else keys)), kind="stable")
        out.append(best_fit([int(i) for i in order], lengths, [], capacity))
        if len(out[-1]) == lower_bound(lengths, capacity):
            break
    return out


def evolve(population: list, lengths: list[int], capacity: int, generations: int, size: int, rng) -> list:
    """Generations of one island; the best individual always stays. Best first."""
    least = lower_bound(lengths, capacity)
    score = lambda x: fitness(x, lengths, capacity)
    population = sorted(population, key=score, reverse=True)[:size]
    for _ in range(generations):
        if len(population[0]) <= least:
            break
        a, b = (population[min(rng.integers(0, len(population), 2))] for _ in range(2))
        child = crossover(a, b, lengths, capacity, rng)
        child = mutate(child, lengths, capacity, rng)
        population = sorted([*population, child], key=score, reverse=True)[:size]
    return population


def _flat(bins, n: int) -> list[int]:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tolist()


def _bins(flat) -> list[list[int]]:
    flat = np.asarray(flat, np.int64)
    order = np.argsort(flat, kind="stable")
    cuts = np.flatnonzero(np.diff(flat[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)] if len(flat) else []


def emptiest(bins, lengths, below: float, items: int) -> set[int]:
    """Numbers of the emptiest bins that are filled to less than ``below``: as many as hold ``items``
    items together, at least one."""
    filled = fill(bins, lengths, 0)
    out, n = set(), 0
    for k in sorted((k for k in range(len(bins)) if filled[k] < below), key=lambda k: filled[k]):
        n += len(bins[k])
        if out and n > items:
            break
        out.add(k)
    return out


_STATE = ("shard long, island int, uids array<long>, lengths array<int>, population array<array<int>>, open boolean")


def _level(items: DataFrame, shards: int, level: int, capacity: int, islands: int, epochs: int,
           generations: int, size: int, loose: float) -> DataFrame:
    """(uid, length, shard, bin, place, carried) of every item (uid, length)."""
    import pandas as pd

    def rng(shard, island, epoch):
        return np.random.default_rng([int(shard), int(island), epoch, level])

    def start(pdf):
        pdf = pdf.sort_values("uid")
        shard, lengths = int(pdf["shard"].iloc[0]), [int(x) for x in pdf["length"]]
        uids = pdf["uid"].tolist()
        rows = []
        for island in range(islands):
            population = first_individuals(lengths, capacity, size if island else 2, rng(shard, island, 0))
            best = min(population, key=len)
            open_ = len(best) > lower_bound(lengths, capacity)
            if not open_:
                rows, population = [], [best]
            rows.append((shard, 0 if not open_ else island, uids, lengths, [_flat(x, len(uids)) for x in population], open_))
            if not open_:
                break
        return pd.DataFrame(rows, columns=["shard", "island", "uids", "lengths", "population", "open"])

    def epoch_of(epoch):
        def run(pdf):
            own = pdf.iloc[0]
            if not own["open"]:
                return pdf
            shard, island, lengths = int(own["shard"]), int(own["island"]), [int(x) for x in own["lengths"]]
            population = [_bins(x) for part in pdf["population"] for x in part]
            population = evolve(population, lengths, capacity, generations, size, rng(shard, island, epoch))
            flat = [_flat(x, len(lengths)) for x in population]
            same = (shard, own["uids"], own["lengths"])
            # the elite goes round the ring
            rows = [(shard, island, *same[1:], flat, True), (shard, (island + 1) % islands, *same[1:], flat[:1], True)]
            return pd.DataFrame(rows, columns=["shard", "island", "uids", "lengths", "population", "open"])
        return run

    def best(pdf):
        individuals = [(x, r) for r, part in enumerate(pdf["population"]) for x in part]
        lengths = [int(x) for x in pdf["lengths"].iloc[0]]
        bins = max((_bins(x) for x, _ in individuals), key=lambda b: fitness(b, lengths, capacity))
        uids = pdf["uids"].iloc[0]
        gone = emptiest(bins, lengths, loose * capacity, len(uids) // 4) if shards > 1 else set()
        rows = []
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                rows.append((int(uids[i]), lengths[i], int(pdf["shard"].iloc[0]), k, at, k in gone))
                at += lengths[i]
        return pd.DataFrame(rows, columns=["uid", "length", "shard", "bin", "place", "carried"])

    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)).alias("shard"))
    state = dealt.groupBy("shard").applyInPandas(start, _STATE)
    for epoch in range(1, epochs + 1):
        state = state.groupBy("shard", "island").applyInPandas(epoch_of(epoch), _STATE)
    return state.groupBy("shard").applyInPandas(
        best, "uid long, length long, shard long, bin long, place long, carried boolean")


def pack(items: DataFrame, *, capacity: int = 4096, shard_items: int = 4096, islands: int = 3, epochs: int = 2,
         generations: int = 12, size: int = 5, loose: float = 0.99) -> DataFrame:
    """(uid, sequence_id, offset) of every item (uid, length); the uids are distinct.

    Only bins filled to less than ``loose`` of the capacity are pooled for the next level. The number
    of levels is at most the logarithm of the number of shards.
    """
    out, level, left, shards = None, 0, items.select("uid", "length"), None
    while True:
        least = max(1, math.ceil(left.count() / shard_items))
        shards = least if shards is None else min(least, math.ceil(shards / 2))
        placed = stored(_level(left, shards, level, capacity, islands, epochs, generations, size, loose), f"packed{level}")
        row = placed.where(~F.col("carried")).select(
            "uid", (F.lit(level << 58) + F.col("shard") * (1 << 20) + F.col("bin")).alias("sequence_id"),
            F.col("place").alias("offset"))
        out = row if out is None else out.unionByName(row)
        if shards == 1:
            return out
        left, level = placed.where("carried").select("uid", "length"), level + 1


def pack_documents(docs: DataFrame, keep: list[str], vocabulary: str, text_col: str = "text", *, capacity: int = 4096,
                   end_id: int = 1, **options) -> DataFrame:
    """One row per piece: ``keep`` columns, piece, start, length, ids_crc32, sequence_id, offset."""
    cut_up = pieces(docs, keep, vocabulary, text_col, capacity=capacity, end_id=end_id)
    own = stored(cut_up.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return own.join(pack(own, capacity=capacity, **options), "uid").drop("uid")
