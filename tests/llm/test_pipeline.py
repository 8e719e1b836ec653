"""The pipeline's stages, each against a plain version on its own input, and the whole run."""

import duckdb
import pytest

import brute
import corpus_pipeline as p
from courier.llm.common import stored
from courier.llm.oracles import DECONTAMINATION, LINES
from test_counts_rules_packing import check_packing

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    out = [docs]
    for name, stage in p.STAGES:
        out.append(stored(stage(spark, out[-1], SF01), name))
    return out


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def sql(df, query):
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF01}/benchmark.parquet'")
    return con.sql(query).fetchall()


def test_columns(outputs):
    for df in outputs[:-1]:
        assert df.columns == p.COLUMNS
    assert [n for n, _ in p.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_quality_keeps_rows_as_they_are(outputs):
    before, after = (set(rows(df, *p.COLUMNS)) for df in outputs[:2])
    assert after < before
    for i, text, *_ in before - after:
        assert text is not None
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF01}/labels.parquet'").fetchall())
    gone = {r[0] for r in before - after}
    long = {r[0] for r in before if brute.base_stats(r[1])[0] >= 50}
    assert not [i for i in gone & long if labels.get(i) == 1 and 2 * brute.base_stats(dict((r[0], r[1]) for r in before)[i])[4] <= brute.base_stats(dict((r[0], r[1]) for r in before)[i])[0]]
    assert sum(labels.get(r[0]) == 0 for r in after) <= 0.1 * sum(labels.get(r[0]) == 0 for r in before)


def test_lines_equal_sql(outputs):
    want = sorted((i, t) for i, t, *_ in sql(outputs[1], "SELECT doc_id, text FROM (" + LINES + ")"))
    assert sorted(rows(outputs[2], "doc_id", "text")) == want
    assert all(n == len(t) for t, n in rows(outputs[2], "text", "n_chars"))


def test_one_document_of_each_group_stays(outputs):
    before = rows(outputs[2], "doc_id", "text")
    fps = [(i, brute.fingerprint(t)) for i, t in before]
    keep = set(brute.component_ids(fps))
    assert sorted(rows(outputs[3], "doc_id", "text")) == sorted(r for r in before if r[0] in keep)


def test_contaminated_documents_go(outputs):
    bad = {i for i, _, n, *_ in sql(outputs[3], DECONTAMINATION) if n}
    assert bad
    assert sorted(rows(outputs[4], "doc_id", "text")) == sorted(r for r in rows(outputs[3], "doc_id", "text") if r[0] not in bad)


def test_packing(outputs, spark):
    n, least = check_packing(outputs[5].collect(), rows(outputs[4], "doc_id", "text"))
    assert n <= least + 1
    run = p.run(spark, SF01)
    assert run.columns == outputs[5].columns and run.count() == outputs[5].count()


def test_edge_cases(spark):
    text = " ".join(f"Word{chr(97 + i % 26)} some{i} thing{i * 7} other{i * 3} end{i}." for i in range(60)).translate(
        str.maketrans("0123456789", "abcdefghij"))
    odd = [(None, text, None, None, None), (None, text, None, None, None), (5, text, "en", "s", 1), (5, text, "en", "s", 1),
           (6, None, "en", "s", 0), (7, "", "en", "s", 0), (8, " ".join(reversed(text.split())) + " tail", "en", "s", 1)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in odd],
                               "doc_id long, text string, lang string, source string, n_chars long, fp int, n_words int, kept int")
    docs = df
    for name, stage in p.STAGES:
        empty = stage(spark, docs.limit(0), SF01)
        assert empty.count() == 0
        docs = stored(stage(spark, docs, SF01), name)
    assert {r["doc_id"] for r in docs.collect()} <= {5, 8} and docs.count()
    only_null = p.near_dedup_stage(spark, df.where("doc_id is null"), SF01)
    assert only_null.count() == 1


def test_the_survivor_of_a_repeated_id_is_repeatable(spark):
    text = "One line of words that stays the same whatever the case of its letters may be"
    odd = [(1, t, "en", "s", 1) for t in (text, text.lower(), text.upper(), text.title())]
    kept = set()
    for order in (odd, odd[::-1], odd[2:] + odd[:2]):
        df = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long")
        for parts in (1, 4):
            kept.add(tuple(rows(p.near_dedup_stage(spark, df.repartition(parts), SF01), "doc_id", "text")))
    assert len(kept) == 1 and len(kept.pop()) == 1
