import random

import pytest

from brute import repeats
from courier.llm.substrings import drop_repeats

SCHEMA = "doc_id long, text string"


def outcome(spark, rows, **kw):
    got = {(r["doc_id"], r["text"]): (r["kept_text"], r["n_words"], r["n_removed"])
           for r in drop_repeats(spark.createDataFrame(rows, SCHEMA), **kw).collect()}
    return [got[r] for r in rows]


def corpus(seed, n=60):
    """Texts over a few words, with copies, shared passages, periodic runs and near copies."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("ab cd e f g h i j k l m n".split()) + rnd.choice("xyz")
    passage = [[word() for _ in range(rnd.randrange(15, 60))] for _ in range(4)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(rnd.randrange(0, 80))]
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(w) + 1)
            w[at:at] = rnd.choice(passage)
        if rnd.random() < .2:
            w += [word()] * rnd.randrange(30) + "p q r".split() * rnd.randrange(12)
        if rows and rnd.random() < .3:
            w = rnd.choice(rows)[1].split()
            if w and rnd.random() < .5:
                w[rnd.randrange(len(w))] = word()
        rows.append((i, rnd.choice([" ", "  ", "\n", "\t"]).join(w)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("kw", [{}, {"heavy": 1}, {"heavy": 3, "group_suffixes": 50}, {"window": 7}, {"window": 2, "heavy": 5}])
def test_equals_brute_force(spark, seed, kw):
    rows = corpus(seed)
    assert outcome(spark, rows, **kw) == repeats(rows, kw.get("window", 20))


def test_edge_cases(spark):
    long = "w " * 30_000 + "end"
    rows = [(None, "a b c d e"), (3, None), (4, ""), (5, " \n\t "), (6, "a b c d e"), (None, "x a b c d e"), (7, long),
            (8, "été 中 b c d e"), (9, "q été 中 b c"), (7, "a b c d e tail"), (9, "a b c d e f g h")]
    want = repeats(rows, 5)
    got = outcome(spark, rows, window=5)
    both = [rows.index(r) for r in rows if r[0] is None]
    assert sum(got[i][2] for i in both) == 5
    assert [g for i, g in enumerate(got) if i not in both] == [w for i, w in enumerate(want) if i not in both]
    assert outcome(spark, [], window=5) == []


def test_equal_rows_are_one_document_and_other_columns_pass(spark):
    text = " ".join(map(str, range(30)))
    rows = [(1, text), (1, text), (2, text)]
    for heavy in (1, 100):
        df = spark.createDataFrame([(r[1], r[0], r[0], "k") for r in rows], "text string, rid long, doc_id long, oid string")
        out = drop_repeats(df, heavy=heavy)
        assert out.columns[:4] == ["text", "rid", "doc_id", "oid"]
        assert sorted((r["doc_id"], r["n_removed"], r["rid"], r["oid"], tuple(map(tuple, r["spans"]))) for r in out.collect()) == [
            (1, 0, 1, "k", ()), (1, 0, 1, "k", ()), (2, 30, 2, "k", ((0, 30),))]
    with pytest.raises(ValueError):
        drop_repeats(df.withColumnRenamed("oid", "Spans"))
