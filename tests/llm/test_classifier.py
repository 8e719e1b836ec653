import zlib

import duckdb
import pytest

from courier.llm.classifier import features, fit, held_out, quality_scores, rule_column, simplified, tree_paths, with_features
from courier.llm.queries import QUERIES
from courier.llm.quality_rules import document_stats

SF01 = "/root/testdata/sf0.01"

DEBUG = """DecisionTreeClassificationModel: uid=x, depth=2
  If (feature 3 <= 0.5)
   If (feature 0 <= 1.0E-4)
    Predict: 0.0
   Else (feature 0 > 1.0E-4)
    Predict: 1.0
  Else (feature 3 > 0.5)
   Predict: 0.0
"""


def test_paths_are_conjunctions():
    assert tree_paths(DEBUG) == [((3, "<=", 0.5),), ((0, "<=", 1e-4), (3, "<=", 0.5)), ((0, ">", 1e-4), (3, "<=", 0.5)), ((3, ">", 0.5),)]
    assert simplified(((0, "<=", 3.0), (0, "<=", 2.0), (0, ">", 0.0), (0, ">", 1.0))) == ((0, "<=", 2.0), (0, ">", 1.0))


def test_query_on_held_out_rows(spark):
    got = QUERIES["op8_quality_classifier"](spark, SF01).toPandas()
    docs = duckdb.sql(f"SELECT doc_id FROM '{SF01}/documents.parquet'").fetchall()
    assert len(got) == len(docs) and got["score"].between(0, 1).all()
    out = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, in docs}
    assert all(out[i] == h for i, h in zip(got["doc_id"], got["held_out"]))
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF01}/labels.parquet'").fetchall())
    test = [(labels[i], p) for i, p, h in zip(got["doc_id"], got["predicted"], got["held_out"]) if h and i in labels]
    assert len(test) > 60 and sum(a == b for a, b in test) / len(test) > 0.95


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(400)
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    turned = labels.withColumn("quality", (labels["quality"] if False else 1 - labels["quality"]))
    mixed = labels.where(~held_out("doc_id")).unionByName(turned.where(held_out("doc_id")))
    options = {"trees": 4, "depth": 2}
    a = quality_scores(docs, labels.where(~held_out("doc_id")), **options).orderBy("doc_id").collect()
    b = quality_scores(docs, mixed, **options).orderBy("doc_id").collect()
    assert [(r["doc_id"], round(r["score"], 6)) for r in a] == [(r["doc_id"], round(r["score"], 6)) for r in b]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "w " * 300_000, 1)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_scores(docs, none).collect()
    assert len(rows) == 4 and {r["score"] for r in rows} == {0.5}
    ones = spark.createDataFrame([(1, 1), (1, None), (None, 0), (77, 1)], "doc_id long, quality int")
    assert all(r["score"] > 0.5 for r in quality_scores(docs, ones).collect())
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    assert quality_scores(docs.limit(0), ones).count() == 0


def test_rules_compile_to_columns(spark):
    stats = document_stats(spark.createDataFrame([(1, "A few words. Really!!"), (2, None)], "doc_id long, text string"), ["doc_id"])
    rows, names = with_features(stats)
    at = names.index("f_symbols")
    out = rows.select("doc_id", rule_column(((at, "<=", 0.5),), names).alias("r"), *names).collect()
    assert [r["r"] for r in out] == [True, True]
    assert all(r[n] is not None for r in out for n in names) and len(names) == len(features())


@pytest.mark.parametrize("flip", [False, True])
def test_fit_learns_either_direction(spark, flip):
    texts = [("good prose here. " * 30, 1) if i % 2 else ("BAD!! ### WORDS&&& " * 30, 0) for i in range(60)]
    df = spark.createDataFrame([(t, 1 - y if flip else y) for t, y in texts], "text string, label int")
    model = fit(document_stats(df, ["label"]), "label", trees=3, depth=2)
    assert model["rules"] and all(len(r) >= 1 for r, _ in model["rules"])
