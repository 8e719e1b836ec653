import math
import random
import zlib
from collections import Counter as Count

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
from courier.llm import packing
from courier.llm.packing import encoder, lower_bound, pack, pack_documents
from courier.llm.queries import QUERIES
from courier.llm.quality_rules import default_rules, estimate, quality_rules, text_stats
from courier.llm.token_counts import counter, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "a  b", "a \n b", "a\n\n  b\t c ", " lead", "trail ", "x y 　z", "don't we'll I'M 'S", "\x1c a \x1f b",
       "naïve café ﬁ ½ ² Ⅷ", "日本語 テキスト", "😀👍🏽 é é J̌ Σας ΟΔΟΣ İ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>",
       "<|startoftext|>x", "1234 5,678.90 a1b2", "a" * 3000, "!?" * 500, " " * 700 + "x", "\r\n\r\nx \r\n", "word, word. Word; (word)",
       "​ zero ﻿ width", "a\u0085b  c", "ÀÉÎ Straße STRASSE ǅ", "\x00 nul \x00", "x́ ́y ,́"]


def documents(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()


def test_token_counts_equal_the_library():
    t = Tokenizer.from_file(BYTES)
    rng = random.Random(4)
    made = ["".join(rng.choice([*"ab ,.\n'0é日 ", "the ", "  ", "'s", "<|endoftext|>"]) for _ in range(rng.randint(1, 200)))
            for _ in range(400)]
    for x in ODD + made:
        assert counter(BYTES).count(x) == len(t.encode(x, add_special_tokens=False).ids), repr(x[:50])


def test_token_count_query(spark):
    t = Tokenizer.from_file(BYTES)
    docs = documents(SF01)
    n = [len(e.ids) for e in t.encode_batch([x or "" for _, x in docs], add_special_tokens=False)]
    want = sorted((i, len((x or "").encode()), k, k > 1024) for (i, x), k in zip(docs, n))
    assert sorted(tuple(r) for r in QUERIES["op10_token_counts"](spark, SF01).collect()) == want


def test_token_count_edge_cases(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "ab " * 400_000, 1), (3, "z" * 200_000, 1)],
                               "doc_id long, text string, n_tokens int")
    got = {(r["doc_id"], r["n_bytes"]): (r["n_tokens"], r["over_limit"]) for r in token_counts(df, BYTES, ["doc_id"]).collect()}
    t = Tokenizer.from_file(BYTES)
    assert got[None, 0] == got[1, 0] == (0, False)
    assert got[2, 1_200_000] == (len(t.encode("ab " * 400_000).ids), True)
    assert got[3, 200_000] == (len(t.encode("z" * 200_000).ids), True)
    assert token_counts(df.limit(0), BYTES, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        token_counts(df, BYTES, ["doc_id", "n_tokens"])


def test_base_statistics_equal_brute_force():
    rng = random.Random(9)
    texts = [*ODD, "a b c a b c", "a a a a", "x\n x\nx\n\n\nx", "a b\na b\n a b\n",
             *["".join(rng.choice(["a", "b", "é", " ", "\n", "#", "|", "\x0b", " "]) for _ in range(rng.randint(0, 300)))
               for _ in range(300)]]
    for t in texts:
        assert text_stats(t.encode())[:5] == brute.base_stats(t), repr(t[:60])
    assert text_stats(None)[:5] == (0, 0, 0, 0, 0)
    long = "lorem ipsum dolor\n" * 300_000
    assert text_stats(long.encode())[:5] == (900_000, 15 * 300_000, 0, 299_999, 900_000)


def test_quality_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op2_quality_rules"](spark, SF01).collect()}
    docs = documents(SF01)
    assert len(got) == len({i for i, _ in docs})
    for i, t in docs:
        n = brute.base_stats(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["kept"] and r["base_failed"])
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF01}/labels.parquet'").fetchall())
    rest = [(r["kept"], labels[i]) for i, r in got.items() if i in labels and not r["base_failed"]]
    assert sum(k for k, q in rest if q == 1) >= 0.98 * sum(q == 1 for _, q in rest)
    assert sum(not k for k, q in rest if q == 0) >= 0.8 * sum(q == 0 for _, q in rest)


def test_estimate_finds_the_accuracies():
    rng = np.random.default_rng(1)
    true = [0.95, 0.9, 0.8, 0.7, 0.85]
    good = rng.random(20_000) < 0.7
    votes = [np.where(rng.random(20_000) < 0.7, np.where((rng.random(20_000) < a) == good, 1, -1), 0) for a in true]
    acc, prior = estimate(Count(zip(*[v.tolist() for v in votes])), 5)
    assert abs(prior - 0.7) < 0.03 and all(abs(a - b) < 0.04 for a, b in zip(acc, true))
    assert estimate(Count(), 5)[1] == 0.7


def test_estimate_is_the_same_at_every_size():
    rng = random.Random(9)
    patterns = Count(tuple(rng.choice((-1, 0, 0, 1)) for _ in range(4)) for _ in range(500))
    few, many = estimate(patterns, 4), estimate(Count({k: 1000 * n for k, n in patterns.items()}), 4)
    assert np.allclose(many[0], few[0]) and abs(many[1] - few[1]) < 1e-9


def plain_estimate(rows, n_rules, rounds=200):
    """The same iteration row by row, without patterns or arrays."""
    accuracy, share = [0.85] * n_rules, 0.7
    for _ in range(rounds):
        right, voted, good_rows = [0.0] * n_rules, [0] * n_rules, 0.0
        for row in rows:
            yes, no = share, 1 - share
            for a, vote in zip(accuracy, row):
                if vote:
                    yes, no = yes * (a if vote > 0 else 1 - a), no * (1 - a if vote > 0 else a)
            good = yes / (yes + no)
            good_rows += good
            for j, vote in enumerate(row):
                if vote:
                    voted[j] += 1
                    right[j] += good if vote > 0 else 1 - good
        accuracy = [((r / n if n else 0.85) + 2 * 0.85) / 3 for r, n in zip(right, voted)]
        share = (good_rows / len(rows) + 0.7) / 2
    return accuracy, share


def test_estimate_equals_a_plain_version():
    rng = random.Random(5)
    rows = [tuple(rng.choice((0, 0, 1) if j > 2 else (-1, 0, 0, 0)) for j in range(5)) + (0,) for _ in range(400)]
    acc, prior = estimate(Count(rows), 6, belief=2, belief_good=1)
    plain_acc, plain_prior = plain_estimate(rows, 6)
    assert abs(prior - plain_prior) < 1e-6 and all(abs(a - b) < 1e-6 for a, b in zip(acc, plain_acc))
    assert acc[5] == pytest.approx(0.85)


def test_verdict_equals_a_plain_version(spark):
    """Posterior of every row of the table from the plain estimate over its votes."""
    from courier.llm.quality_rules import document_stats

    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    votes = {r[0]: tuple(r[1:]) for r in document_stats(docs, ["doc_id"]).select(
        "doc_id", *[c.cast("int").alias(f"v_{n}") for n, c in default_rules().items()]).collect()}
    accuracy, share = plain_estimate(list(votes.values()), 12, rounds=60)
    for r in quality_rules(docs, ["doc_id"]).select("doc_id", "p_good", "base_failed", "kept").collect():
        odds = share / (1 - share)
        for a, vote in zip(accuracy, votes[r["doc_id"]]):
            odds *= (a / (1 - a)) ** vote
        assert abs(r["p_good"] - odds / (1 + odds)) < 1e-6
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5)


def test_quality_edge_cases(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "word and more, " * 100_000), (3, "One good line. " * 3)],
                               "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS kept")
    out = quality_rules(df, ["doc_id"])
    assert out.count() == 5 and out.where("kept").count() == 0
    assert quality_rules(df.limit(0), ["doc_id"]).count() == 0
    assert len(default_rules()) == 12


def test_ids_equal_the_library():
    t = Tokenizer.from_file(WORDS)
    rng = random.Random(8)
    made = ["".join(rng.choice([*"ab ,.\n'0é日 ", "The ", "İ", "J̌", "<|endoftext|>", "Σ"]) for _ in range(rng.randint(1, 200)))
            for _ in range(400)]
    texts = [*ODD, *made, *[x for _, x in documents(SF001)]]
    assert encoder(WORDS).by_piece
    for x, ids in zip(texts, encoder(WORDS).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x[:60])


def check_packing(rows, docs, capacity=4096):
    """rows: pieces as returned; docs: (id, text) with distinct ids."""
    t = Tokenizer.from_file(WORDS)
    want = {}
    for (i, x), e in zip(docs, t.encode_batch([x or "" for _, x in docs], add_special_tokens=False)):
        ids = np.array([*e.ids, 1], "<u4")
        for k, lo in enumerate(range(0, len(ids), capacity)):
            part = ids[lo:lo + capacity]
            want[i, k] = (lo, len(part), zlib.crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert len(rows) == len(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    least = lower_bound([n for _, n, _ in want.values()], capacity)
    return len(bins), least


def test_packing_query(spark):
    n, least = check_packing(QUERIES["op5_packing"](spark, SF01).collect(), documents(SF01))
    assert n <= least + 1


def test_many_shards_lose_little(spark):
    rng = np.random.default_rng(2)
    lengths = np.minimum(4096, rng.lognormal(6.5, 1, 6000).astype(int) + 1).tolist()
    items = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    rows = pack(items, shard_items=500).collect()
    assert sorted(r["uid"] for r in rows) == list(range(6000))
    n = len({r["sequence_id"] for r in rows})
    assert n <= 1.002 * lower_bound(lengths, 4096) + 1


def test_pooling_goes_on_to_one_shard(spark):
    """Three pieces fill a sequence, none of them well: shards of any number lose at most one sequence together."""
    items = spark.range(6000).select(F.col("id").alias("uid"), (1200 + F.col("id") * 37 % 151).alias("length"))
    rows = pack(items, shard_items=256).collect()
    assert len(rows) == 6000 == len({r["uid"] for r in rows})
    assert len({r["sequence_id"] for r in rows}) <= 2001
    tiny = spark.range(1000).select(F.col("id").alias("uid"), F.lit(1).cast("long").alias("length"))
    rows = pack(tiny, shard_items=100).collect()
    assert sorted(r["offset"] for r in rows) == list(range(1000)) and len({r["sequence_id"] for r in rows}) == 1


def test_emptiest_bins():
    lengths = [5, 5, 9, 1, 2, 2, 2]
    assert packing.emptiest([[0, 1], [2], [3], [4, 5, 6]], lengths, 10, 3) == {2}
    assert packing.emptiest([[0, 1], [2], [3], [4, 5, 6]], lengths, 10, 4) == {2, 3}
    assert packing.emptiest([[0, 1]], lengths, 10, 4) == set()
    assert packing.emptiest([[4, 5, 6]], lengths, 10, 1) == {0}


def test_islands_improve_on_best_fit():
    # triples that fill a bin exactly: best-fit decreasing wastes bins
    rng = np.random.default_rng(5)
    lengths = []
    for _ in range(40):
        a = int(rng.integers(260, 450))
        b = int(rng.integers(250, 1000 - a - 250))
        lengths += [a, b, 1000 - a - b]
    first = packing.first_individuals(lengths, 1000, 5, rng)
    best = packing.evolve(first, lengths, 1000, 60, 5, rng)[0]
    assert sorted(i for b in best for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 1000 for b in best)
    assert packing.fitness(best, lengths, 1000) >= max(packing.fitness(x, lengths, 1000) for x in first)
    child = packing.crossover(first[0], first[1], lengths, 1000, rng)
    assert sorted(i for b in child for i in b) == list(range(len(lengths)))


def test_packing_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "word " * 4095), (4, "word " * 4096), (5, "word " * 30_000), (6, "a")]
    df = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, length int, uid int")
    rows = pack_documents(df, ["doc_id"], WORDS).collect()
    n, least = check_packing(rows, docs)
    assert n == least
    same = spark.createDataFrame([(None, "x y")] * 300, "doc_id long, text string")
    rows = pack_documents(same, ["doc_id"], WORDS, capacity=10).collect()
    assert len(rows) == 300 and len({r["sequence_id"] for r in rows}) == math.ceil(300 / 3)
    assert pack_documents(same.limit(0), ["doc_id"], WORDS).count() == 0


def test_pieces_with_marks_equal_the_library(monkeypatch):
    """Runs of marks behind words, special strings, contractions and other scripts, with a small cache."""
    monkeypatch.setattr(packing, "CACHE_PIECES", 200)
    monkeypatch.setattr(packing, "BLOCK_PIECES", 64)
    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.by_piece
    rng = random.Random(8)
    bits = [*"abcXYZ  éßİñ,.;:!?#*$%&'<>/|\n\t09中я", "\u0301", "\u200b", "'s", "don't", "<|endoftext|>", "<|startoftext|>,",
            "Word,", "É.", "e\u0301,", "ǅ", "ﬁ", "$$$", "..,", "  ", "the ", "of, "]
    texts = ["", " ", "\n", ",", "###", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000))]
    for lo in range(0, len(texts), 500):
        part = texts[lo:lo + 500]
        assert encoder.encode(part) == encoder._plain(part)
    assert encoder.encode([]) == []
