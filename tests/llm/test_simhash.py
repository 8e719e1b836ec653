import random

import numpy as np
import pytest

import brute
SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
from courier.llm.queries import QUERIES
from courier.llm.simhash import (BITS, allocate, choose_parts, components, fingerprint, group_bits, links,
                                 near_duplicates)


def test_fingerprint_equals_brute_force():
    rng = random.Random(1)
    texts = ["", " \n", "One", "one TWO", "a b c", "É é A b\x1cc d", "x " * 400,
             *[" ".join(rng.choice("ab cd EF gh Ñj".split()) for _ in range(n)) for n in (3, 4, 50, 700)]]
    for t in texts:
        assert fingerprint(t.encode()) == brute.fingerprint(t), t[:20]
    assert fingerprint(None) == 0


def test_query_equals_brute_force(spark):
    import duckdb

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF01}/documents.parquet'").fetchall()
    fps = [(i, brute.fingerprint(t)) for i, t in docs]
    want = sorted((i, f"{fp:016x}", c) for (i, fp), c in zip(fps, brute.component_ids(fps)))
    got = sorted(tuple(r) for r in QUERIES["op3_simhash_near_dedup"](spark, SF01).collect())
    assert got == want


@pytest.mark.parametrize("parts", [2, 3, 4, None])
@pytest.mark.parametrize("distance", [1, 3, 4])
def test_links_lose_none(spark, parts, distance):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    fps = set(base)
    for f in base:  # near ones, all in one part of the word as well as spread
        for k in range(1, 7):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), k)))
            fps.add(f ^ sum(1 << b for b in rng.sample(range(12), k)))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {tuple(r) for r in links(df, distance, parts).collect()}
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i]
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}
    assert got == want


def test_allocation_is_the_cheapest_and_sums_up():
    rng = np.random.default_rng(3)
    costs = np.cumsum(rng.random((20, 3, 4)), axis=2)
    for row, t in zip(costs, allocate(costs, 3)):
        assert t.sum() == 3 - 3 + 1 and t.min() >= -1
        price = lambda ts: sum(row[i, x] for i, x in enumerate(ts) if x >= 0)
        every = [(a, b, 1 - a - b) for a in range(-1, 4) for b in range(-1, 4) if -1 <= 1 - a - b <= 3]
        assert abs(price(t) - min(map(price, every))) < 1e-12


def test_correlated_bits_share_a_group():
    rng = np.random.default_rng(0)
    half = rng.integers(0, 2, (500, 16))
    bits = np.repeat(half, 4, axis=1).astype(float)  # bits 4k..4k+3 always agree
    groups = group_bits(bits.T @ bits, 500, 4)
    assert sorted(b for g in groups for b in g) == list(range(BITS))
    assert all(len({b // 4 for b in g}) == 4 for g in groups)


def test_more_fingerprints_take_fewer_partitions():
    assert [choose_parts(n, 3) for n in (10 ** 4, 10 ** 7, 10 ** 10)] == [4, 3, 2]


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + \
            [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300)]
    rng.shuffle(edges)
    df = spark.createDataFrame([tuple(sorted(e)) for e in edges], "a long, b long")
    got = dict((r["node"], r["root"]) for r in components(df).collect())
    want = {i: 0 for i in range(1, 41)} | {100 + k: 100 for k in range(1, 30)} | {200 + k: 200 for k in range(1, 9)}
    assert got == want


def test_edge_cases(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (5, None), (3, ""), (None, None), (9, "q " * 300_000),
            (None, "lonely words stand here"), (11, "q " * 300_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = near_duplicates(df, "doc_id").collect()
    fps = [(i, brute.fingerprint(t)) for i, t in rows]
    want = sorted(zip([i for i, _ in rows], brute.component_ids(fps)), key=str)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == want
    assert near_duplicates(df.limit(0), "doc_id").count() == 0
