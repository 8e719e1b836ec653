import random

import pytest

from brute import collocations as brute
from courier.llm.phrases import collocations, phrase_counts

SCHEMA = "lang string, text string"


def corpus(seed, n=200):
    rnd = random.Random(seed)
    vocabulary = [a + b for a in "aäbcdefg中" for b in ("", "x", "Yz")]
    fixed = [" ".join(rnd.choices(vocabulary, k=rnd.randrange(2, 8))) for _ in range(6)]
    rows = []
    for _ in range(n):
        w = rnd.choices(vocabulary, k=rnd.randrange(40), weights=[1 / (i + 1) for i in range(len(vocabulary))])
        for _ in range(rnd.randrange(4)):
            w.insert(rnd.randrange(len(w) + 1), rnd.choice(fixed))
        text = "".join(x + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ", " ; "]) for x in w)
        rows.append((rnd.choice(["en", "en", "de", None, ""]), text))
    return rows


def outcome(spark, rows, **kw):
    return sorted(tuple(r) for r in collocations(spark.createDataFrame(rows, SCHEMA), **kw).collect())


@pytest.mark.parametrize("kw", [{"min_count": 1}, {"min_count": 3}, {"min_count": 8, "top": 5}, {"min_count": 4, "longest": 3},
                                {"min_count": 4, "max_filter_bits": 1 << 4}])
def test_equals_brute_force(spark, kw):
    rows = corpus(7)
    own = {k: v for k, v in kw.items() if k != "max_filter_bits"}
    assert outcome(spark, rows, **kw) == sorted(brute(rows, **own))


def test_flow_counts_every_phrase(spark):
    rows = corpus(3, 80)
    counts, totals = phrase_counts(spark.createDataFrame(rows, SCHEMA), min_count=2)
    got = {(r["grp"], r["gram"]): r["f"] for r in counts.collect()}
    want = {}
    import re
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    key = ("und" if lang is None else lang, " ".join(w[i:i + k]))
                    want[key] = want.get(key, 0) + 1
    assert got == {k: v for k, v in want.items() if v >= 2}
    assert {r["grp"]: r["total"] for r in totals.collect()} == {
        g: sum(v for k, v in want.items() if k[0] == g and " " not in k[1]) for g in {k[0] for k in want}}


def test_edge_cases(spark):
    rows = [(None, None), ("en", ""), ("en", " \n,.;"), ("de", "ja"), ("fr", "a b " * 20_000), (None, "x y\x0bx y\x0cx y\rx y"), ("en", "o p")] * 2
    assert outcome(spark, rows, min_count=2) == sorted(brute(rows, min_count=2))
    assert outcome(spark, []) == []
    df = spark.createDataFrame([("k", "a b", "en", "z")] * 3, "grp string, Text2 string, lang string, gram string")
    assert [r["phrase"] for r in collocations(df, text_col="Text2", min_count=3).collect()] == ["a b"]


def test_products_beyond_64_bits(spark):
    """Scores of counts whose products pass 64 bits are whole numbers, floored."""
    got = spark.range(1).selectExpr(
        "(cast(cast(1000 as decimal(9,0)) * cast(3000000000000 as decimal(19,0)) * cast(9000000000001 as decimal(19,0)) as decimal(38,0)))"
        " div (cast(cast(4000000000000 as decimal(19,0)) * cast(5000000000007 as decimal(19,0)) as decimal(38,0))) as s").first()["s"]
    assert got == 1000 * 3000000000000 * 9000000000001 // (4000000000000 * 5000000000007)
