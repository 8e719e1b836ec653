import random
from itertools import product

import pytest

import brute
from courier.llm.conversations import END, audit, best_edits, damaged, node, repair_digests, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string"
FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def outcome(spark, rows):
    from pyspark.sql import functions as F
    out = repair_digests(damaged(spark.createDataFrame(rows, SCHEMA)), present=F.col("present")).collect()
    got = {r["conv"]: tuple(r[f] for f in FIELDS) for r in out}
    assert len(got) == len(out)
    return got


def test_every_short_signature_is_cheapest():
    for n in range(5):
        for signature in map("".join, product("suaoSUAOx", repeat=n)):
            stack = [END]
            for symbol in reversed(signature):
                stack.append(node(symbol, stack[-1]))
            rows = [({"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}[c.lower()], "", c == "x", c.isupper())
                    for c in signature]
            assert (stack[-1][0][0], audit(stack)) == brute.cheapest(rows)[:2], signature


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for conv in range(400):
        for turn in range(rnd.randrange(1, 12)):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "anna", "Über"])
            text = rnd.choice(["Yes.", "No!", "And", "Why? ", "a b\n", "", " \t", None, "Ende.\x0b", "中", "é?"])
            rows.append((conv, rnd.choice([turn] * 6 + [turn + 2, None, 0]), role, text))
    rows += [(None, t, r, "Hm.") for t, r in enumerate(["user", "assistant", "user"])]
    rows += [(1000, t, "user" if t % 2 else "assistant", f"text {t}." * 3) for t in range(1500)]
    assert outcome(spark, rows) == brute.repair(rows)


def test_whole_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    from pyspark.sql import functions as F
    got = {r["conv"]: tuple(r[f] for f in FIELDS) for r in repair_digests(damaged(t), present=F.col("present")).collect()}
    assert got == brute.repair([tuple(r) for r in t.select("conv_id", "turn", "role", "text").collect()])


def test_nodes_are_shared_across_partitionings(spark):
    rnd = random.Random(2)
    signatures = ["".join(rnd.choices("uaUAsox", k=rnd.randrange(30))) + rnd.choice(["", "uauauauaua"]) for _ in range(500)]
    df = spark.createDataFrame([(s,) for s in signatures], "signature string")
    want = {(r["signature"], r["cost"], r["audit"], r["n"]) for r in best_edits(df).collect()}
    assert len(want) == len(set(signatures)) and sum(r[3] for r in want) == 500
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 1)
        assert {(r["signature"], r["cost"], r["audit"], r["n"]) for r in best_edits(df).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_edge_cases(spark):
    assert outcome(spark, []) == {}
    import zlib
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = outcome(spark, [(gone, 0, "user", "x")])
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")
    long = [(2, 1, "user", "w " * 2_000_000 + "."), (2, 2, "assistant", "ok."), (2, None, None, None)]
    assert outcome(spark, long) == brute.repair(long)


def test_repaired_turns_and_other_columns(spark):
    rows = [("a", 1, "user", "Hi.", 1, "z"), ("a", 2, "user", "Hi.", 1, "z"), ("a", 3, "user", "Bye.", 1, "z"), (None, 1, "assistant", "Yes.", 0, "q")]
    df = spark.createDataFrame(rows, "c string, t int, r string, x string, kind int, conv string")
    out = repaired_turns(df, conv_col="c", turn_col="t", role_col="r", text_col="x")
    got = sorted(((r["conv"], r["place"], r["role"], r["text"], r["edit"]) for r in out.collect()), key=str)
    # at equal costs "IK" comes before "R" and "KDR" before "KDIK…"
    assert got == [("a", 0, "user", "Hi.", "K"), ("a", 1, "assistant", "Bye.", "R"), (None, 0, "user", "", "I"), (None, 1, "assistant", "Yes.", "K")]


@pytest.mark.parametrize("signature, want", [("", (0, "")), ("ua", (0, "KK")), ("u", (3, "KI")), ("s", (4, "D")), ("x", (4, "D")), ("au", (6, "IKKI"))])
def test_examples(spark, signature, want):
    got = best_edits(spark.createDataFrame([(signature,)], "signature string")).first()
    assert (got["cost"], got["audit"]) == want
