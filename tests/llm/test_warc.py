import base64
import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from courier.llm.warc import (DICTIONARY_MAGIC, SEPARATOR, frames, page_records, parse, read_archives, record,
                              sha1_base32, skippable, train, write_archives)
from courier.llm import warc
from courier.session import work_dir

DATE = "2020-01-01T00:00:00Z"


def archive(records, dictionary=b"", wrap=False):
    packed = zstandard.ZstdCompressor().compress(dictionary) if wrap else dictionary
    options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    c = zstandard.ZstdCompressor(write_checksum=True, **options)
    return skippable(packed) + b"".join(c.compress(r) for r in records)


def records(n=40):
    return [record("response", i, f"http://h/{i}", b"payload %d " % i * 50, sha1_base32(b"payload %d " % i * 50), None, DATE)
            for i in range(n)]


def test_separator_is_an_empty_skippable_frame():
    assert struct.unpack("<II", SEPARATOR.encode()) == (0x184D2A50, 0)


@pytest.mark.parametrize("wrap", [False, True])
def test_dictionary_frame_and_one_frame_per_record(wrap):
    made = records()
    dictionary = train(made)
    assert dictionary
    whole = archive(made, dictionary, wrap)
    assert [r for _, r in frames(memoryview(whole))] == made
    offsets = [o for o, _ in frames(memoryview(whole))]
    assert len(set(offsets)) == 40 and struct.unpack_from("<I", whole)[0] == DICTIONARY_MAGIC


def test_any_reader_of_zstandard_passes_over_the_separators():
    made = records(3)
    whole = SEPARATOR.encode().join([skippable(b""), *[zstandard.compress(r) for r in made]]) + SEPARATOR.encode()
    assert [r for _, r in frames(memoryview(whole))] == made
    reader = zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True)
    assert reader.read() == b"".join(made)


def test_damage_is_found():
    made = records()
    d = train(made)
    whole = archive(made, d)
    for bad in (whole[:-3], whole[:-1] + b"?", whole + b"xy", whole + b"garbage!!", whole[8 + len(d):],
                skippable(b"no dictionary") + zstandard.compress(made[0]), whole + skippable(d)):
        with pytest.raises(ValueError):
            list(frames(memoryview(bad)))


def test_headers_and_lengths_are_validated():
    good = records(1)[0]
    assert parse(good)["payload"] == b"payload 0 " * 50
    for old, new in ((b"WARC/1.1", b"WARC/9"), (b"Content-Length: ", b"Content-Length: 1"), (b"WARC-Date: ", b"X: "),
                     (b"payload 0 ", b"payload 1 "), (b"\r\n\r\n", b"\r\n"), (b"WARC-Type: ", b"WARC Type "),
                     (b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: response")):
        with pytest.raises(ValueError):
            parse(good.replace(old, new))
    with pytest.raises(ValueError):
        parse(good + b"x")


def test_round_trip_with_edge_cases(spark):
    rows = [(3, "http://a/ b\r\nInjected: x", "same"), (1, None, "same"), (1, "http://a", "same"), (9, "u", ""), (8, "u", None),
            (None, "u", "same"), (None, "u", "alone"), (5, "é", "ü" * 300_000), (6, "u", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], "page_id long, url string, html string, digest string, payload int")
    path = work_dir(spark, "warc")
    write_archives(df.repartition(3), path)
    full = read_archives(spark, path).cache()
    bodies = {bytes(r["payload"]).decode() for r in full.where("headers['warc-type'] = 'response'").collect()}
    assert bodies == {r[2] or "" for r in rows}
    got = sorted((tuple(r) for r in page_records(full).collect()), key=str)
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    refers = [1, None, None, 8, None, 1, None, None, None]
    want = [(i, len((h or "").encode()), digest(h), "response" if to is None else "revisit", to)
            for (i, _, h), to in zip(rows, refers)]
    assert got == sorted(want, key=str)
    urls = {r["headers"].get("warc-target-uri") for r in full.collect()}
    assert "http://a/%20b%0D%0AInjected:%20x" in urls and None in urls


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    path = work_dir(spark, "warc")
    write_archives(df, path, min_payload_bytes=3)
    got = {r["page_id"]: r["refers_to"] for r in page_records(read_archives(spark, path)).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_empty_table_and_reported_damage(spark):
    df = spark.createDataFrame([(1, "u", "ab")] * 20, "page_id long, url string, html string")
    path = work_dir(spark, "warc")
    write_archives(df.limit(0), path)
    assert read_archives(spark, path).count() == 0
    import os

    folder = work_dir(spark, "warc").removeprefix("file:")
    os.makedirs(folder)
    with open(f"{folder}/x.warc.zst", "wb") as f:
        f.write(archive(records(3))[:-5])
    rows = read_archives(spark, folder, on_error="report").collect()
    assert [r["error"] is None for r in rows] == [True, True, False]
    with pytest.raises(Exception, match="truncated"):
        read_archives(spark, folder).collect()


def test_archives_end_at_their_rows_or_bytes(spark):
    import random

    rng = random.Random(3)
    body = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(2000))
    rows = [(i, "u", body()) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    for limits, least in (({"archive_rows": 50}, 7), ({"archive_bytes": 30_000}, 10), ({"archive_rows": 2}, 300)):
        path = work_dir(spark, "warc")
        write_archives(df, path, **limits)
        full = read_archives(spark, path).cache()
        assert sorted((r["page_id"], bytes(p["payload"]).decode()) for r, p in zip(page_records(full).collect(), full.collect())) \
            == [(i, h) for i, _, h in rows]
        sizes = [r["n"] for r in full.groupBy("archive").count().withColumnRenamed("count", "n").collect()]
        assert len(sizes) >= least and max(sizes) < limits.get("archive_rows", 40)
        lengths = [r["length"] for r in spark.read.format("binaryFile").load(path).select("length").collect()]
        assert max(lengths) < limits.get("archive_bytes", 1 << 20) + 8 * 16_384 + 40_000


def test_a_third_of_the_pages_equal(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", 4)
    rows = [(i, f"u{i}", "same page" if i % 3 == 0 else f"copy {i % 7}" if i % 5 == 0 else f"own {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    path = work_dir(spark, "warc")
    write_archives(df, path)
    least = {}
    for i, _, h in rows:
        least.setdefault(h, i)
    got = {r["page_id"]: r["refers_to"] for r in page_records(read_archives(spark, path)).collect()}
    assert got == {i: None if least[h] == i else least[h] for i, _, h in rows}


def test_hot_pages_are_dealt_by_id(spark, monkeypatch):
    """No task of the joined rows holds the third of the pages that are equal."""
    monkeypatch.setattr(warc, "HOT_SHARE", 4)
    df = spark.range(3000).selectExpr("id AS page_id", "concat('u', id) AS url",
                                      "encode(if(id % 3 = 0, 'same', concat('p', id)), 'UTF-8') AS payload",
                                      "sha1(encode(if(id % 3 = 0, 'same', concat('p', id)), 'UTF-8')) AS digest")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        found = warc._referred(df, 0)
        sizes = [r[0] for r in found.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*")).select("count(1)").collect()]
        assert sum(sizes) == 3000 and max(sizes) < 3000 / len(sizes) * 1.5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", True)
