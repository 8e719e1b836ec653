import random
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from courier.operators import transfer_progress
from courier.session import work_dir
from courier.streaming.progress import advance, stream_transfer_progress

SCHEMA = "job string, part long, start long, n long, total long"


def chunks_of(seed, jobs=4):
    rnd, rows = random.Random(seed), []
    for j in range(jobs):
        at, own = 0, []
        for part in range(rnd.randrange(1, 40)):
            n = rnd.choice([0, 1, 5, 50, 400])
            own.append((f"j{j}", part, at, n))
            at += n
        rows += [(*r, at) for r in own]
    return rows


@pytest.mark.parametrize("step", [10, 3, 100])
def test_any_order_gives_the_batch_milestones(step):
    rnd = random.Random(step)
    for seed in range(30):
        own = [r for r in chunks_of(seed, 1)]
        total = own[0][4]
        if not total:
            continue
        whole = [(c[2], e, p) for c, e, p in advance(0, total, [(r[2], r[3], r[1]) for r in own if r[3]], step)[2]]
        items = [(r[2], r[3], r[1]) for r in own if r[3]] * 2  # every chunk repeated
        rnd.shuffle(items)
        done, waiting, found = 0, [], []
        while items:
            cut = rnd.randrange(1, len(items) + 1)
            done, waiting, more = advance(done, total, waiting + items[:cut], step)
            found += [(c[2], e, p) for c, e, p in more]
            items = items[cut:]
        assert (done, waiting, found) == (total, [], whole)


def test_overlapping_chunks_count_once():
    assert advance(0, 100, [(0, 30, 1), (20, 30, 2), (45, 5, 3), (60, 40, 4)], 10) == (
        50, [(60, 40, 4)], [((0, 30, 1), 30, 30), ((20, 30, 2), 50, 50)])


def run(spark, folders, base, **kw):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folders)
    out = stream_transfer_progress(stream, ["job"], ["part"], start_col="start", n_col="n", total_col="total", **kw)
    return out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{base}/cp").option("path", f"{base}/out")


def test_stream_equals_batch_over_shuffled_batches_and_a_restart(spark):
    rows, base = chunks_of(11, 12), work_dir(spark, "progress")
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(tuple(r) for r in transfer_progress(df, ["job"], ["part"], "n").select("job", "part", "done", "pct").collect())
    random.Random(1).shuffle(rows)
    third = len(rows) // 3
    for i, part in enumerate((rows[:third], rows[third:2 * third], rows[2 * third:], rows[:third])):
        if i == 2:  # the query stops and starts again from its checkpoint
            q = run(spark, f"{base}/in", base).trigger(availableNow=True).start()
            q.awaitTermination()
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{base}/in/{i}")
    q = run(spark, f"{base}/in", base).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{base}/out")
    assert got.where("kind <> 'progress'").count() == 0
    assert sorted(tuple(r) for r in got.select("job", "part", "done", "pct").collect()) == want


def test_stalled_transfers_are_reported_once(spark):
    base = work_dir(spark, "stalled")
    spark.createDataFrame([("a", 0, 0, 40, 100), ("a", 2, 60, 40, 100), ("b", 0, 0, 7, 7), ("z", 0, 0, 0, 0)], SCHEMA).coalesce(1).write.parquet(f"{base}/in/0")
    q = run(spark, f"{base}/in", base, stall_s=1).trigger(processingTime="500 milliseconds").start()

    def rows_when(done, seconds=60):
        end = time.time() + seconds
        while True:
            try:
                rows = [(r["job"], r["part"], r["kind"], r["done"], r["pct"]) for r in spark.read.parquet(f"{base}/out").collect()]
            except AnalysisException:  # nothing written yet
                rows = []
            if done(rows) or time.time() > end or q.exception():
                return sorted(rows, key=str)
            time.sleep(.5)

    try:
        first = [("a", 0, "progress", 40, 40), ("a", None, "stalled", 40, 40), ("b", 0, "progress", 7, 100)]
        assert rows_when(lambda rows: any(r[2] == "stalled" for r in rows)) == first
        spark.createDataFrame([("a", 1, 40, 20, 100)], SCHEMA).coalesce(1).write.parquet(f"{base}/in/1")
        rows = rows_when(lambda rows: ("a", 2, "progress", 100, 100) in rows)
        assert rows == sorted([*first, ("a", 1, "progress", 60, 60), ("a", 2, "progress", 100, 100)], key=str)
    finally:
        q.stop()


def test_needs_rocksdb_and_free_names(spark):
    df = spark.createDataFrame([], SCHEMA).withColumn("done", F.lit(1))
    with pytest.raises(ValueError):
        stream_transfer_progress(df, ["job"], ["done"], start_col="start", n_col="n", total_col="total")
