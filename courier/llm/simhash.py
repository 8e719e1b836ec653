"""SimHash near-duplicates: fingerprints, and links found by the generalised pigeonhole principle.

Fingerprint: bit b of a text is set if more than half of its shingles' 64-bit hashes have it set.

Linking. The 64 bits are dealt into partitions of correlated bits (bits that move together share a
partition, so the partitions differ among each other). With partition thresholds t_1..t_m that sum
to ``distance - m + 1``, two fingerprints at most ``distance`` apart differ in at most t_i bits in
some partition i; t_i = -1 switches a partition off. Each fingerprint gets its own thresholds:
dynamic programming over the partitions takes those with the fewest estimated candidates, from the
counts of all fingerprints by partition value. Hot values (a partition that half of the corpus
shares) are thereby probed only by fingerprints that have no cheaper choice. The fingerprint probes
the values within t_i of its own, and each candidate is verified on all 64 bits.

Only distinct fingerprints are linked; documents with equal fingerprints meet in one row. Links
become components by alternating star contraction over checkpointed tables.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, stored

BITS = 64
#: Partition values are counted in sub-blocks of at most this many bits: a bounded histogram.
BLOCK_BITS = 11
#: A value that holds this share of all fingerprints is heavy and counted exactly: at most 1 / share.
HEAVY_SHARE = 1 / 1024
#: Estimated cost of one probe and of one verified candidate, relative to each other.
PROBE_COST, VERIFY_COST = 1.0, 0.1


def fingerprint(b: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of one text: lower-cased ASCII letters, words between white space, repeats count."""
    words = (b or b"").lower().split()
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h64(b" ".join(words), seed)
    counts = np.zeros(BITS, np.int64)
    total = len(words) - shingle + 1
    for lo in range(0, total, 1 << 16):
        hi = min(total, lo + (1 << 16))
        cols = [words[lo + k:hi + k] for k in range(shingle)]
        h = np.array([h64(s, seed) for s in map(b" ".join, zip(*cols))], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64) if len(h) < 256 else _column_sums(bits)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of 0/1 columns: 255 rows at a time in bytes, then in long integers."""
    whole = len(bits) // 255 * 255
    part = np.add.reduce(bits[:whole].reshape(-1, 255, BITS), axis=1, dtype=np.uint8)
    return part.sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", *, shingle: int = 3,
                 seed: int = 42) -> DataFrame:
    """``keep`` columns and ``fp`` (the 64 bits as a signed long) of every whole text."""

    def fn(texts):
        return [np.array([fingerprint(b, shingle, seed) for b in texts], np.uint64).view(np.int64)]

    return map_text(docs, keep, text_col, "fp long", fn)


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 × 64 counts of bits that are set together, over all rows: 4,096 sums reach the driver."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((BITS, BITS), np.float64)
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for lo in range(0, len(v), 65536):
                bits = np.unpackbits(v[lo:lo + 65536].view(np.uint8).reshape(-1, 8), axis=1,
                                     bitorder="little").astype(np.float32)
                total += bits.T @ bits
        if total.any():
            yield pa.RecordBatch.from_pydict({"cell": pa.array(range(BITS * BITS), pa.int32()),
                                              "n": pa.array(total.ravel().astype(np.int64), pa.int64())})

    rows = fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out.reshape(BITS, BITS)


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Deal the bits into ``parts`` groups of nearly equal size; correlated bits share a group.

    Greedy: a group starts with the bit that is most correlated with the bits still free, then takes
    the bit with the highest mean absolute correlation to its members until it is full.
    """
    p = np.diag(together) / max(n, 1)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    free = list(range(BITS))
    groups = []
    for g in range(parts):
        size = len(free) // (parts - g)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            nxt = max(free, key=lambda b: (corr[b, group].mean(), -b))
            group.append(nxt)
            free.remove(nxt)
        groups.append(sorted(group))
    return groups


def _part_values(v: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of ``group`` of each fingerprint, packed."""
    out = np.zeros(len(v), np.uint64)
    for k, b in enumerate(group):
        out |= ((v >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _ball(width: int, radius: int) -> np.ndarray:
    """XOR masks of all values within ``radius`` of a value of ``width`` bits."""
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << b for b in c) for c in combinations(range(width), r)]
    return np.array(masks, np.uint64)


def _blocks(width: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the sub-blocks of a partition."""
    n = math.ceil(width / BLOCK_BITS)
    cuts = [width * k // n for k in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def block_histograms(fps: DataFrame, groups: list[list[int]]) -> list[list[np.ndarray]]:
    """Counts of all fingerprints by value of each sub-block: a fixed number of sums."""
    plan = [(g, lo, w) for g, group in enumerate(groups) for lo, w in _blocks(len(group))]
    base = np.cumsum([0, *[1 << w for _, _, w in plan]])

    def run(batches):
        import pyarrow as pa

        total = np.zeros(base[-1], np.int64)
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for g, group in enumerate(groups):
                values = _part_values(v, group)
                for k, (h, lo, w) in enumerate(plan):
                    if h == g:
                        block = ((values >> np.uint64(lo)) & np.uint64((1 << w) - 1)).astype(np.int64)
                        total[base[k]:base[k + 1]] += np.bincount(block, minlength=1 << w)
        cells = np.flatnonzero(total)
        if len(cells):
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int32()), "n": pa.array(total[cells], pa.int64())})

    flat = np.zeros(base[-1])
    for r in fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        flat[r["cell"]] = r["n"]
    out: list[list[np.ndarray]] = [[] for _ in groups]
    for k, (g, _, _) in enumerate(plan):
        out[g].append(flat[base[k]:base[k + 1]])
    return out


def _by_distance(counts: np.ndarray, radius: int) -> np.ndarray:
    """Row e: how many fingerprints have a block value exactly e bits from each value."""
    width = int(math.log2(len(counts)))
    rows = np.zeros((radius + 1, len(counts)))
    rows[0] = counts
    ids = np.arange(len(counts))
    for b in range(width):  # bit by bit: a value agrees with its neighbour across bit b at one more bit
        flipped = rows[:, ids ^ (1 << b)]
        rows[1:] = rows[1:] + flipped[:-1]
    return rows


def candidate_tables(histograms, n: int, radius: int) -> list[list[np.ndarray]]:
    """Per partition and sub-block: share of fingerprints at each distance from each block value."""
    return [[_by_distance(h, radius) / max(n, 1) for h in part] for part in histograms]


def estimated(values: np.ndarray, width: int, tables: list[np.ndarray], n: int, radius: int) -> np.ndarray:
    """Column t: estimated fingerprints whose partition value lies within t bits, blocks taken as independent."""
    exact = None
    for (lo, w), table in zip(_blocks(width), tables):
        share = table[:, ((values >> np.uint64(lo)) & np.uint64((1 << w) - 1)).astype(np.int64)]
        if exact is None:
            exact = share
        else:
            exact = np.stack([sum(exact[a] * share[e - a] for a in range(e + 1)) for e in range(radius + 1)])
    return np.cumsum(exact, axis=0).T * n


def allocate(costs: np.ndarray, distance: int) -> np.ndarray:
    """Thresholds per fingerprint and partition with the least summed cost, by dynamic programming.

    ``costs[q, i, t]`` for t = 0..distance; an unused partition (t = -1) costs nothing. The
    thresholds of a fingerprint sum to ``distance - m + 1``, so that t_i + 1 sums to ``distance + 1``.
    """
    n, m, _ = costs.shape
    steps = distance + 1
    best = np.full((n, steps + 1), np.inf)
    best[:, 0] = 0
    chosen = np.zeros((m, n, steps + 1), np.int8)
    for i in range(m):
        new = np.full_like(best, np.inf)
        for u in range(steps + 1):
            extra = 0 if u == 0 else costs[:, i, u - 1][:, None]
            with_u = np.full_like(best, np.inf)
            with_u[:, u:] = best[:, :steps + 1 - u] + extra
            better = with_u < new
            new = np.where(better, with_u, new)
            chosen[i][better] = u
        best = new
    out = np.zeros((n, m), np.int64)
    left = np.full(n, steps)
    rows = np.arange(n)
    for i in range(m - 1, -1, -1):
        u = chosen[i][rows, left].astype(np.int64)
        out[:, i] = u - 1
        left = left - u
    return out


def choose_parts(n: int, distance: int) -> int:
    """Number of partitions with the least cost for evenly spread fingerprints."""

    def cost(m: int) -> float:
        width, spare = BITS // m, distance - m + 1
        total = 0.0
        for i in range(m):
            t = spare // m + (i < spare % m)
            probes = sum(math.comb(width, e) for e in range(t + 1)) if t >= 0 else 0
            total += probes * (PROBE_COST + VERIFY_COST * n / 2.0 ** width)
        return total

    return min(range(2, max(2, distance + 1) + 1), key=cost)


def _heavy_values(index: DataFrame, n: int, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Values that hold at least ``HEAVY_SHARE`` of all fingerprints, with their counts, by partition."""
    rows = index.groupBy("key").count().where(F.col("count") >= max(64, n * HEAVY_SHARE)).collect()
    out = []
    for i in range(parts):
        mine = [(r["key"] & 0xFFFFFFFF, r["count"]) for r in rows if r["key"] >> 32 == i]
        out.append((np.array([v for v, _ in mine], np.uint64), np.array([c for _, c in mine], float)))
    return out


def links(fps: DataFrame, distance: int = 3, parts: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in ``fps.fp`` at most ``distance`` bits apart.

    A pair may appear more than once, if several partitions find it.
    """
    n = fps.count()
    parts = parts or choose_parts(n, distance)
    groups = group_bits(bit_counts(fps), n, parts)
    widths = [len(g) for g in groups]
    if max(widths) > 32:
        raise ValueError("two partitions at least")
    tables = candidate_tables(block_histograms(fps, groups), n, distance)

    def index_rows(batches):
        import pyarrow as pa

        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            v = raw.view(np.uint64)
            for i, g in enumerate(groups):
                key = _part_values(v, g).astype(np.int64) | (i << 32)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key), "fp": pa.array(raw)})

    index = fps.select("fp").mapInArrow(index_rows, "key long, fp long")
    heavy = _heavy_values(index, n, parts)
    balls = [[_ball(w, t) if t <= 2 or w <= 24 else None for t in range(distance + 1)] for w in widths]

    def probe_rows(batches):
        import pyarrow as pa

        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(every), 4096):
                raw = every[lo:lo + 4096]
                v = raw.view(np.uint64)
                values = [_part_values(v, g) for g in groups]
                costs = np.zeros((len(v), parts, distance + 1))
                for i, w in enumerate(widths):
                    found = estimated(values[i], w, tables[i], n, distance)
                    for t in range(distance + 1):
                        near = found[:, t]
                        if len(heavy[i][0]):
                            apart = np.bitwise_count(values[i][:, None] ^ heavy[i][0][None, :])
                            near = np.maximum(near, (apart <= t) @ heavy[i][1])
                        if balls[i][t] is None:
                            costs[:, i, t] = np.inf
                        else:
                            costs[:, i, t] = len(balls[i][t]) * PROBE_COST + near * VERIFY_COST
                chosen = allocate(costs, distance)
                for i in range(parts):
                    for t in range(distance + 1):
                        rows = np.flatnonzero(chosen[:, i] == t)
                        step = max(1, (1 << 18) // len(balls[i][t])) if len(rows) else 1
                        for k in range(0, len(rows), step):
                            some = rows[k:k + step]
                            key = (values[i][some][:, None] ^ balls[i][t][None, :]).astype(np.int64) | (i << 32)
                            yield pa.RecordBatch.from_pydict({
                                "key": pa.array(key.ravel()),
                                "a": pa.array(np.repeat(raw[some], len(balls[i][t])))})

    probes = fps.select("fp").mapInArrow(probe_rows, "key long, a long")
    found = probes.join(index.withColumnRenamed("fp", "b"), "key").where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return found.select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, root), root the least node.

    Alternating large and small stars: each round links a node's neighbours to the least of them,
    until every node hangs on its root. Only minima are aggregated, so a node with very many links
    is combined before it is shuffled. Each round is a written table.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:  # neighbours above a node hang on the least of the node and its neighbours
            both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy(F.col("a").alias("u")).agg(F.min(F.least("a", "b")).alias("m"))
            out = both.join(least, F.col("a") == F.col("u")).where(F.col("b") > F.col("a"))
            out = out.select(F.col("m").alias("a"), "b")
        else:  # a node and its lesser neighbours hang on the least of them
            least = pairs.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
            out = pairs.join(least, F.col("b") == F.col("u"))
            out = out.select(F.col("m").alias("a"), F.inline(F.array(
                F.struct(F.col("a").alias("b")), F.struct(F.col("u").alias("b")))))
        return out.where(F.col("a") < F.col("b")).distinct()

    pairs = stored(edges.where(F.col("a") < F.col("b")).distinct(), "links")
    mark = None
    while True:
        now = pairs.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h")).first()
        if now == mark or not now["n"]:
            break
        mark = now
        pairs = stored(star(star(pairs, True), False), "stars")
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str, text_col: str = "text", *, shingle: int = 3,
                    distance: int = 3, seed: int = 42) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` of every row of ``docs``.

    ``component_id`` is the least id reachable over links of at most ``distance`` bits. Null and
    empty texts have fingerprint 0 and are linked like any other; null ids are passed over unless a
    component has no other id, whose component_id is then null; repeated rows are rows of their own.
    """
    own = stored(fingerprints(docs, [id_col], text_col, shingle=shingle, seed=seed), "fingerprints")
    found = members(own, id_col, distance).select(F.col("fp").alias("member_fp"), F.col("component_id").alias("component"))
    return own.join(found, F.col("fp") == F.col("member_fp")).select(
        id_col, "fp", F.col("component").alias("component_id"))


def members(own: DataFrame, id_col: str, distance: int = 3) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of ``own`` (``id_col``, fp).

    ``root`` is the least fingerprint (as a signed long) of the component."""
    distinct = stored(own.groupBy("fp").agg(F.min(id_col).alias("least_id")), "distinct")
    stars = components(links(distinct.select("fp"), distance))
    rooted = distinct.join(stars, distinct["fp"] == stars["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")
