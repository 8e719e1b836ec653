"""Decontamination, line de-duplication and chat formatting: edge cases beyond the SQL oracles."""

import hashlib

import numpy as np

from courier.llm.chat import TEMPLATE, chat_digests, format_chats, read_chats
from courier.llm.decontaminate import contamination, cut_words, decontaminate, find_contamination, items_digest, merge, rolling
from courier.llm.line_dedup import drop_boilerplate

TEN = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def test_contamination_edge_cases(spark):
    bench = spark.createDataFrame([(1, TEN + " lambda"), (2, TEN), (2, TEN), (3, "two words"), (4, ""), (5, None), (None, "Éa zz")],
                                  "item_id long, text string")
    docs = [(1, f"x {TEN.upper()}! lambda y"), (2, "Two-words; TWO words two"), (3, None), (4, ""), (None, "éa zz Éa zz"),
            (6, TEN[:-6]), (6, TEN[:-6]), (7, "far " * 300_000 + TEN + " far" * 10)]
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, n_hit int, items string")
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
           for r in contamination(df, bench, ["doc_id"]).collect()}
    none = (0, 0, items_digest([]), False)
    assert got[1, 13] == (11, 2, items_digest([1, 2]), True)
    assert got[2, 5] == (4, 1, items_digest([3]), True)
    assert got[3, 0] == got[4, 0] == got[6, 9] == none
    # É is no ASCII letter: it is not lower-cased, so éa and Éa differ
    assert got[None, 4] == (2, 0, items_digest([]), True)
    assert got[7, 300_020] == (10, 2, items_digest([1, 2]), True)
    # the same with a scan per item
    chunked = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
               for r in contamination(df, bench, ["doc_id"], chunk_windows=1).collect()}
    assert chunked == got
    assert contamination(df.limit(0), bench, ["doc_id"]).count() == 0
    assert contamination(df, bench.limit(0), ["doc_id"]).where("contaminated").count() == 0


def test_documents_or_spans_go(spark):
    bench = spark.createDataFrame([(1, TEN)], "item_id long, text string")
    df = spark.createDataFrame([(1, f"Before, {TEN.title()}. After", "e"), (2, "clean text", "e"), (3, None, "e")],
                               "doc_id long, text string, spans string")
    left = decontaminate(df, bench)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3]
    cut = {r["doc_id"]: r["text"] for r in decontaminate(df, bench, mode="spans").collect()}
    assert cut == {1: "Before, . After", 2: "clean text", 3: None}


def test_spans():
    assert merge([(3, 5), (0, 2), (4, 9), (9, 10)]) == [[0, 2], [3, 10]]
    assert cut_words("a b-c d".encode(), [[1, 3]]) == b"a  d"
    assert cut_words(b"", []) == b""


def test_hit_words_span_windows(spark):
    bench = spark.createDataFrame([(1, TEN + " lambda mu")], "item_id long, text string")
    df = spark.createDataFrame([(1, f"{TEN} lambda mu nu {TEN}")], "doc_id long, text string")
    assert find_contamination(df, bench, ["doc_id"]).first()["spans"] == [[0, 12], [13, 23]]


def test_line_dedup_edge_cases(spark):
    rows = [(i, "a", f"Menu \nbody {i}\n\nmenu") for i in range(10)] + [(None, None, "Menu\nx"), (11, None, None), (12, "b", ""),
            (13, "a", " Menu\t\nMenu"), (13, "a", " Menu\t\nMenu"), (14, "b", "only " * 100_000 + "\n" + "y\n" * 50_000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, source string, text string, line_hash int")
    got = {}
    for r in drop_boilerplate(df, "source").collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["n_lines"], r["n_dropped"]))
    assert got[3] == [("body 3\n", 4, 2)]
    assert got[None] == [("Menu\nx", 2, 0)] and got[11] == [(None, 0, 0)] and got[12] == [("", 1, 0)]
    assert got[13] == [(" Menu\t\nMenu", 2, 0)] * 2  # nothing else would be left
    assert got[14][0][2] == 0
    assert drop_boilerplate(df.limit(0), "source").count() == 0


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")


def test_chat_round_trip(spark):
    nasty = ["", "\\", "\\\\", "### User: </turn>\n", "<\\/turn>", "#", "a\\#b", "</", "</turn", ": ", "line\n\n", "é😀", "\\\n", "$1 \\1", None]
    rows = [(i, t, role, text) for i, text in enumerate(nasty) for t, role in enumerate(["user", "assistant", "tool: #x", None, ""])]
    rows += [(99, 0, "user", "long " * 300_000), (99, 1, "assistant", "\\" * 100_001), (None, 0, "user", "u")]
    out = format_chats(chats(spark, rows)).cache()
    read = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in read_chats(out).collect()}
    for i, text in enumerate(nasty):
        # null turns do not occur here; a null role is an empty one
        assert read[i] == [("user", text or ""), ("assistant", text or ""), ("tool: #x", text or ""), ("", text or ""), ("", text or "")]
    assert read[99] == [("user", "long " * 300_000), ("assistant", "\\" * 100_001)]
    digest = {r["conv_id"]: r for r in chat_digests(out).collect()}
    assert digest[3]["loss_sha256"] == hashlib.sha256(nasty[3].encode()).hexdigest()
    assert digest[99]["loss_chars"] == 100_001
    assert digest[99]["formatted_chars"] == out.where("conv_id = 99").selectExpr("length(formatted) n").first()["n"]


def test_chat_machine(spark):
    orders = {1: (["user", "assistant"], None), 2: (["system", "user", "assistant", "user", "assistant"], None),
              3: (["assistant", "user"], 0), 4: (["user", "user", "assistant"], 1), 5: (["user", "assistant", "user"], "end"),
              6: (["system", "system"], 1), 7: (["user", "tool"], 1), 8: (["system"], "end")}
    rows = [(c, t, r, "x") for c, (roles, _) in orders.items() for t, r in enumerate(roles)]
    for r in format_chats(chats(spark, rows)).collect():
        want = orders[r["conv_id"]][1]
        assert r["valid"] == (want is None)
        assert r["bad_turn"] == (want if isinstance(want, int) else None)
        assert [s["loss"] for s in r["segments"]] == [f for role in orders[r["conv_id"]][0] for f in (False, role == "assistant", False)]


def test_chat_ties_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s")]
    out = read_chats(format_chats(chats(spark, rows))).first()["turns"]
    assert [(t["role"], t["text"]) for t in out] == [("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert chat_digests(format_chats(chats(spark, rows).limit(0))).count() == 0
    other = TEMPLATE | {"loss": ["user"], "headers": {"user": "Mensch"}}
    assert "### Mensch: a" in format_chats(chats(spark, rows), other).first()["formatted"]


def test_the_machine_runs_in_the_registered_query(spark):
    from courier.llm.queries import QUERIES

    out = QUERIES["op6_chat_formatting"](spark, "/root/testdata/sf0.01")
    assert "array_contains(" in out._jdf.queryExecution().optimizedPlan().toString() and {"valid", "bad_turn"} <= set(out.columns)
    rows = out.collect()
    assert all(r["valid"] <= (r["bad_turn"] < 0) for r in rows) and {r["valid"] for r in rows} == {True, False}
    assert next(r["valid"] for r in rows if r["conv_id"] == -7)


def test_rolling_hash_by_running_sums():
    ids = np.random.default_rng(1).integers(-1, 50, 500)
    plain = {}
    for n in (1, 2, 10, 500):
        got = rolling(ids, n).tolist()
        assert len(got) == 501 - n
        for i, h in enumerate(got):  # equal windows, equal hashes; other windows, other hashes
            assert plain.setdefault((n, *ids[i:i + n].tolist()), h) == h
        assert len(set(got)) == len({k for k in plain if len(k) == n + 1})
    assert len(rolling(ids, 501)) == 0 and len(rolling(ids[:0], 1)) == 0


def test_chunks_of_the_benchmark_change_nothing(spark):
    bench = spark.createDataFrame([(1, TEN), (2, TEN + " lambda mu"), (2, "other words"), (3, "two words"), (None, "two words")],
                                  "item_id long, text string")
    docs = [(1, f"x {TEN} lambda mu nu"), (1, f"x {TEN} lambda mu nu"), (2, "two words, other words"), (3, None), (None, ""), (4, "clean")]
    df = spark.createDataFrame([(*d, 7, "k") for d in docs], "doc_id long, text string, row_no int, Text_in string")
    for run in (lambda **o: contamination(df, bench, ["doc_id", "row_no", "Text_in"], **o),
                lambda **o: decontaminate(df, bench, **o), lambda **o: decontaminate(df, bench, mode="spans", **o)):
        whole, parts = run(), run(chunk_windows=1)
        assert whole.columns == parts.columns
        assert sorted(whole.collect(), key=str) == sorted(parts.collect(), key=str)
