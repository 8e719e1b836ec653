"""The query contracts: every operator run on the driver's tables, and the same result in SQL.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole tables. Queries that
write (objects, ledgers, streams) write into a fresh folder under the session's checkpoint folder
and read the result back. ``ORACLE`` holds the equivalent DuckDB SQL over the same Parquet files;
column names match one for one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as table_functions
from ..functions.sizes import human_bytes
from ..operators.editions import audit_sketches, editions, key_sketches, overlapping_editions
from ..operators.suffixes import find_archives, store_by_suffix
from ..operators.bundle import compact_objects
from ..operators.indexed import pack_indexed, read_members, restore_paths
from ..operators import (bundle_plan, delivery_keys, endpoint_inventory, exclude_paths, fetch_user_archive,
                         file_keys, folder_sizes, key_collisions, latest_delivery, layered_settings, list_objects,
                         missing_archives, nested_lookup, object_preview, pack_archives,
                         redact_presence, running_sum, settings_report, size_guard, size_report,
                         transfer_progress, tree_stats, unpack_archives)
from ..plans.restore import restore
from ..plans.publish import copy_collisions, copy_objects, publish
from ..session import local_path, materialise, work_dir
from ..sources import objects as objects_sink
from ..sources.frontier import frontier_inventory
from ..sources.tables import deliveries_from_events, documents_inventory, events_deliveries, table
from ..sources.tree import object_inventory
from ..streaming.ledger import read_ledger, stream_delivery_ledger
from ..streaming.observe import TransferMetrics, observed_stream, observed_transfer, read_transfer_metrics
from ..streaming.progress import ROCKSDB, stream_transfer_progress

PART_BYTES = 65536


def current_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: the current bundle of every owner in every course, and how big it is."""
    cols = ["key", "owner", "course", "delivery_id", "ts", "length"]
    latest = latest_delivery(events_deliveries(spark, d).select(*cols), ["key"])
    return latest.select(*cols, human_bytes("length").alias("human"))


def q_list_objects(spark, d):
    return list_objects(documents_inventory(spark, d), "src1/en/", 10).select("key", "length")


def q_object_preview(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return object_preview(docs, "text", 64).select("doc_id", "head")


def q_nested_lookup(spark, d):
    ev = table(spark, d, "events").withColumn("doc", F.concat(F.lit('{"outer":{"inner":'), "props", F.lit("}}")))
    return nested_lookup(ev, "doc", "outer.inner.k", "int", out="k").select("event_id", "k")


def q_binary_preview(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("body"))
    return object_preview(docs, "body", 61).select("doc_id", "head")


def _mode_keys(spark, d):
    """Keys in which junk names stand as folder, as file name, inside a name, and not at all."""
    inv = documents_inventory(spark, d)
    name = (F.when(F.col("doc_id") % 4 == 0, "__pycache__/f.txt").when(F.col("doc_id") % 4 == 1, "__pycache__")
            .when(F.col("doc_id") % 4 == 2, "my__pycache__file").otherwise("f.txt"))
    return inv.select("doc_id", F.concat("lang", F.lit("/"), name).alias("key"))


def _excluding(mode):
    return lambda spark, d: exclude_paths(_mode_keys(spark, d), "key", mode=mode)


def q_tree_stats(spark, d):
    inv = documents_inventory(spark, d)
    return tree_stats(inv, ["owner"], names=("es", "src3"), mode="directory")


def _lineitem_sizes(spark, d, ties: bool):
    li = table(spark, d, "lineitem")
    if ties:
        n = F.floor(F.col("l_quantity") * 256).cast("bigint") * F.col("l_linenumber")
    else:
        n = F.floor(F.col("l_extendedprice") * F.col("l_partkey") * F.col("l_quantity")).cast("bigint")
    return li.select("l_orderkey", "l_linenumber", n.alias("n"))


def q_human_bytes(spark, d):
    return _lineitem_sizes(spark, d, False).withColumn("human", human_bytes("n"))


def q_human_bytes_ties(spark, d):
    return _lineitem_sizes(spark, d, True).withColumn("human", human_bytes("n"))


def q_human_bytes_large(spark, d):
    """Halves of a tenth of a TB, and the whole numbers beside them, from 1.6 PB up."""
    li = table(spark, d, "lineitem")
    n = F.expr(f"((l_partkey * 2 + l_linenumber) * 2 + 33001) * {1 << 38} div 5 + l_orderkey % 3 - 1")
    return li.select("l_orderkey", "l_linenumber", n.alias("n")).withColumn("human", human_bytes("n"))


def q_size_report(spark, d):
    return size_report(_lineitem_sizes(spark, d, True), ["l_orderkey"], "n")


def q_size_guard(spark, d):
    return size_guard(events_deliveries(spark, d), ["user_id"], "length", 3, mode="filter")


def q_fetch_user_archive(spark, d):
    dl = events_deliveries(spark, d)
    owners = table(spark, d, "events").select(F.col("user_id").cast("string").alias("usr"))
    return fetch_user_archive(dl.select("key"), owners, prefix="click", match="suffix", owner_col="usr")


def q_missing_archives(spark, d):
    owners = table(spark, d, "customer").select("c_custkey")
    found = events_deliveries(spark, d).where(F.col("prefix") == "click")
    return missing_archives(owners, found, "c_custkey", "user_id")


def _bootstrap_layers(spark, d):
    """Per user: an override layer from signups and an environment layer from purchases."""
    ev = table(spark, d, "events")
    per_user = ev.groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") == "signup", F.col("value"))).alias("o_max"),
        F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("p_max"))
    uid = F.col("user_id").cast("string")
    override = F.when(F.col("o_max") > 100, F.concat(F.lit("override:"), uid)).otherwise(F.lit(""))
    env = (F.when(F.col("p_max") > 150, F.concat(F.lit("env:"), uid))
            .when(F.col("p_max") > 100, F.lit("")))
    return per_user.select(
        F.col("user_id").alias("scope"), F.lit("kafka_bootstrap").alias("name"),
        F.inline(F.array(F.struct(override.alias("value"), F.lit(0).alias("layer")),
                         F.struct(env.alias("value"), F.lit(1).alias("layer")))))


def q_layered_settings(spark, d):
    res = layered_settings(_bootstrap_layers(spark, d))
    return res.select(F.col("scope").alias("user_id"), "resolved", "effective")


def q_settings_report(spark, d):
    ev = table(spark, d, "events")
    secret = (ev.where(F.col("event_type") == "error").groupBy("user_id").agg(F.max("value").alias("m"))
              .where(F.col("m") > 300)
              .select(F.col("user_id").alias("scope"), F.lit("aws_secret_access_key").alias("name"),
                      F.concat(F.lit("tok-"), F.col("user_id").cast("string")).alias("value"),
                      F.lit(1).alias("layer")))
    res = layered_settings(_bootstrap_layers(spark, d).unionByName(secret))
    return settings_report(res).withColumnRenamed("scope", "user_id")


def q_key_collisions(spark, d):
    dl = events_deliveries(spark, d).drop("key", "file_name", "folder", "uri")
    branch = F.when(F.col("course").isin("click", "view"), F.lit("student")).otherwise(F.col("course"))
    dl = delivery_keys(dl, path_col="path", owner_col="owner", prefix=branch)
    return key_collisions(dl).select("key", "n_courses", "n_owners", "n_writes")


def q_transfer_progress(spark, d):
    ev = table(spark, d, "events").select("event_type", "event_id", "ts",
                                          F.floor(F.col("value") * 1024).cast("bigint").alias("n"))
    return transfer_progress(ev, ["event_type"], ["ts", "event_id"], "n").select("event_type", "event_id", "pct", "done")


def _ledger_view(df):
    return df.select(F.col("course").alias("event_type"), "user_id",
                     F.col("delivery_id").alias("event_id"), "ts")


def q_latest_delivery(spark, d):
    dl = events_deliveries(spark, d).select("key", "course", "user_id", "delivery_id", "ts")
    return _ledger_view(latest_delivery(dl, ["key"]))


def q_stream_delivery_ledger(spark, d):
    """The events as a folder of files that all span the whole time, one file per micro-batch: rows of
    every batch but the first are late for some keys."""
    events = table(spark, d, "events")
    base = work_dir(spark, "stream_ledger")
    events.repartition(4, "event_id").write.option("maxRecordsPerFile", 0).parquet(f"{base}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    q = stream_delivery_ledger(deliveries_from_events(stream), f"{base}/sink", f"{base}/checkpoint", compact_every=2)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return _ledger_view(read_ledger(spark, f"{base}/sink"))


def q_bundle_plan(spark, d):
    inv = documents_inventory(spark, d)
    plan = bundle_plan(inv, "owner", "key", "length", PART_BYTES)
    return plan.groupBy("owner", "part").agg(F.count(F.lit(1)).alias("n_files"),
                                             F.sum("length").cast("bigint").alias("bytes"))


def q_pack_roundtrip(spark, d):
    inv = documents_inventory(spark, d, content=True)
    members = unpack_archives(pack_archives(inv, "owner", max_part_bytes=PART_BYTES))
    return members.select(F.col("path").alias("key"), "length", F.md5("content").alias("digest"))


def q_pack_folders(spark, d):
    """Two folders per owner with the same file names, and junk folders that do not go in."""
    inv = documents_inventory(spark, d, content=True)
    inv = inv.withColumn("dir", F.concat(F.lit("/home/"), "lang")).withColumn("key", F.concat(
        F.when(F.col("doc_id") % 5 == 0, "__pycache__/").otherwise("sub/"), F.col("doc_id").cast("string")))
    packed = pack_archives(inv, "owner", path_col="dir", max_part_bytes=PART_BYTES)
    members = unpack_archives(packed)
    return members.select("owner", "folder", F.col("path").alias("key"), "length", F.md5("content").alias("digest"))


def _delivered(spark, d):
    """Two deliveries to one bucket, the second of some owners only, and one to another bucket."""
    from .deliver import deliver

    inv = documents_inventory(spark, d, content=True)
    store = work_dir(spark, "store")
    deliver(inv, store, "results", prefix="course", max_part_bytes=PART_BYTES, delivery_id=1)
    deliver(inv.where("owner = 'src1'").withColumn("key", F.concat(F.lit("new/"), "key")), store, "results",
            prefix="course", max_part_bytes=PART_BYTES, delivery_id=2)
    deliver(inv.where("owner = 'src2' AND doc_id % 2 = 0"), store, "users", prefix="course", delivery_id=3)
    return store, inv.select("owner").distinct()


def q_deliver_restore(spark, d):
    from .deliver import restore_bundles

    store, owners = _delivered(spark, d)
    members, _missing = restore_bundles(spark, store, owners, bucket="results", prefix="course")
    return members.select(F.col("path").alias("key"), "length", F.md5("content").alias("digest"))


def q_deliver_manifest(spark, d):
    from .deliver import current_bundles as current_archives

    store, _owners = _delivered(spark, d)
    return (current_archives(spark, store).groupBy("bucket", "key", "delivery_id")
            .agg(F.count(F.lit(1)).alias("n_archives"), F.sum("n_files").alias("n_files"), F.sum("bytes").alias("bytes")))


def q_restore_shared_slug(spark, d):
    """Owners whose slugs agree: each gets back the own files only."""
    inv = documents_inventory(spark, d, content=True)
    side = F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit("."), "owner")).otherwise(F.concat("lang", F.lit("_"), "owner"))
    inv = inv.withColumn("owner", side)
    bundles = pack_archives(inv, "owner", max_part_bytes=PART_BYTES).withColumn("key", F.concat(F.lit("c/"), "name"))
    owners = inv.where("doc_id % 2 = 0").select("owner").distinct()
    members, _ = restore(bundles, owners, prefix="c")
    return members.select("owner", F.col("path").alias("key"), F.md5("content").alias("digest"))


def q_copy_collisions(spark, d):
    inv = documents_inventory(spark, d).withColumn("key", F.concat("lang", F.lit("/"), (F.col("doc_id") % 7).cast("string"), F.lit(".txt")))
    return copy_collisions(inv, prefix="p").select("key", "n_objects")


def q_endpoint_inventory(spark, d):
    return endpoint_inventory(table(spark, d, "pages"), "url", 443, url=True)


def q_file_keys(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"),
                                            F.when(F.col("page_id") % 3 == 0, "").otherwise(
                                                F.concat(F.lit("u."), (F.col("page_id") % 50).cast("string"))).alias("owner"))
    return file_keys(pages, name_col="path", owner_col="owner", prefix="").select("page_id", "key")


def q_redact_presence(spark, d):
    cust = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return redact_presence(cust, ["c_name"], rename={"c_name": "has_name", "c_mktsegment": "segment"})


def q_delivery_keys(spark, d):
    return events_deliveries(spark, d).select(F.col("delivery_id").alias("event_id"), "key")


def q_object_inventory(spark, d):
    root = work_dir(spark, "tree")
    objects_sink.register(spark)
    (documents_inventory(spark, d, content=True).select("key", "content")
        .write.format("courier_objects").mode("append").save(root))
    return object_inventory(spark, root if root.startswith("file:") else f"file:{root}").select("key", "length")


def q_copy_objects(spark, d):
    inv = documents_inventory(spark, d, content=True)
    inv = inv.withColumn("branch", F.concat_ws("/", "owner", "lang"))
    root = work_dir(spark, "copy")
    copy_objects(inv, root, name_col="key", owner_col="owner", prefix=None, branch_col="branch")
    back = object_inventory(spark, root, content=True)
    return back.select("key", "length", F.md5("content").alias("digest"))


def q_publish(spark, d):
    """Every delivery goes into the ledger, in two writes; reading resolves them."""
    dl = events_deliveries(spark, d)
    target = work_dir(spark, "ledger")
    publish(dl.where("delivery_id % 2 = 0"), target, mode="ledger")
    cur = publish(dl.where("delivery_id % 2 = 1"), target, mode="ledger")
    return cur.select("key", F.col("delivery_id").alias("event_id"))


def q_publish_replace(spark, d):
    """Later writes replace earlier ones by (bucket, key); a bucket of its own per weekday parity."""
    bucket = F.when(F.dayofweek("ts") % 2 == 0, "a").otherwise("b")
    dl = events_deliveries(spark, d).withColumn("bucket", bucket)
    target = work_dir(spark, "current")
    publish(dl.where("delivery_id % 3 = 0"), target, mode="replace")
    cur = publish(dl.where("delivery_id % 3 > 0"), target, mode="replace")
    return cur.select("bucket", "key", F.col("delivery_id").alias("event_id"))


def q_frontier_inventory(spark, d):
    """A tree with hidden and underscored folders, one of which holds a third of all files."""
    inv = documents_inventory(spark, d, content=True)
    top = F.when(F.col("doc_id") % 3 == 0, ".hot").otherwise(F.concat(F.lit("_"), "owner"))
    key = F.concat_ws("/", top, F.floor(F.col("doc_id") / 20).cast("string"), F.concat(F.lit("_doc"), F.col("doc_id").cast("string")))
    root = work_dir(spark, "frontier")
    objects_sink.register(spark)
    inv.select(key.alias("key"), "content").write.format("courier_objects").mode("append").save(root)
    return frontier_inventory(spark, root).select("key", "length")


def _indexed(spark, d):
    inv = documents_inventory(spark, d, content=True)
    return materialise(pack_indexed(inv, local_path(work_dir(spark, "indexed")), max_part_bytes=8 * PART_BYTES, block_bytes=16384), "index")


def q_restore_paths(spark, d):
    """Every tenth file, each read from its own blocks of the archive that holds it."""
    wanted = documents_inventory(spark, d).where("doc_id % 10 = 3").select("owner", F.col("key").alias("path"))
    return restore_paths(_indexed(spark, d), wanted).select(F.col("path").alias("key"), "length", F.md5("content").alias("digest"))


def q_archive_ranges(spark, d):
    """Forty bytes from byte 100 on of every file in the archives."""
    return read_members(_indexed(spark, d), start=100, size=40).select(F.col("path").alias("key"), F.hex("content").alias("bytes"))


def _branch_deliveries(spark, d):
    """Deliveries under keys that several courses share."""
    dl = events_deliveries(spark, d).drop("key", "file_name", "folder", "uri")
    branch = F.when(F.col("course").isin("click", "view"), F.lit("student")).otherwise(F.lit("staff"))
    return delivery_keys(dl, path_col="path", owner_col="owner", prefix=branch)


def q_overlapping_editions(spark, d):
    return overlapping_editions(editions(_branch_deliveries(spark, d))).select("key", "course", "n_writes", "until", "overlaps")


def q_audit_sketches(spark, d):
    """The audit from sketches of single days, merged; there are few courses, so the counts are exact."""
    daily = materialise(key_sketches(_branch_deliveries(spark, d)), "sketches")
    return audit_sketches(daily).select("key", "n_course", "n_owner", "n_writes")


def q_unpack_lateral(spark, d):
    """Archives opened in SQL, once as a lateral call and once over a partitioned table."""
    table_functions.register(spark)
    bundles = materialise(pack_archives(documents_inventory(spark, d, content=True), "owner", max_part_bytes=PART_BYTES), "bundles")
    each = spark.sql("SELECT b.owner, m.path AS key, m.length, md5(m.content) AS digest FROM {b} b, LATERAL unpack_archive(b.archive) m", b=bundles)
    parted = spark.sql("SELECT owner, path AS key, length AS n FROM unpack_archives(TABLE(SELECT * FROM {b}) PARTITION BY (owner, part))", b=bundles)
    return each.join(parted, ["owner", "key"]).where("n = length").select("owner", "key", "length", "digest")


def q_find_archives(spark, d):
    """The archives of sixty users, looked up by how their keys end in an inventory in that order."""
    inv = events_deliveries(spark, d).select("key").distinct()
    path = work_dir(spark, "by_suffix")
    store_by_suffix(inv, path)
    owners = table(spark, d, "events").select(F.concat(F.lit("user."), F.col("user_id").cast("string")).alias("usr")).where("usr LIKE '%7'")
    return find_archives(spark, path, owners, owner_col="usr")


def q_stream_transfer_totals(spark, d):
    """Totals of a stream's batches, kept by a listener; the query stops and starts again half-way."""
    inv = documents_inventory(spark, d).select("doc_id", "key", "length")
    base = work_dir(spark, "totals")
    metrics = TransferMetrics(spark, f"{base}/metrics")
    spark.streams.addListener(metrics)
    try:
        for half in (0, 1):
            inv.where(F.col("doc_id") % 2 == half).repartition(2).write.mode("append").parquet(f"{base}/in")
            stream = spark.readStream.schema(inv.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
            q = (observed_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint")
                 .option("path", f"{base}/out").trigger(availableNow=True).start())
            q.awaitTermination()
            if q.exception():
                raise q.exception()
            metrics.catch_up(q)
    finally:
        spark.streams.removeListener(metrics)
    rows = read_transfer_metrics(spark, f"{base}/metrics")
    return rows.agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"))


def q_compact_objects(spark, d):
    inv = documents_inventory(spark, d, content=True)
    return compact_objects(inv, work_dir(spark, "compact"), target_bytes=16 * PART_BYTES).select(
        "owner", "key", "length", F.md5("content").alias("digest"))


def q_publish_merge(spark, d):
    """Three publishes of a table of sorted runs; the second also deletes every seventh user's keys."""
    dl = events_deliveries(spark, d).withColumn("bucket", F.when(F.dayofweek("ts") % 2 == 0, "a").otherwise("b"))
    target = work_dir(spark, "runs")
    publish(dl.where("delivery_id % 3 = 0"), target, mode="merge")
    publish(dl.where("delivery_id % 3 = 1 AND user_id % 7 <> 0"), target, mode="merge",
            deletes=dl.where("user_id % 7 = 0").select("bucket", "key"))
    cur = publish(dl.where("delivery_id % 3 = 2 AND user_id % 2 = 0"), target, mode="merge")
    return cur.select("bucket", "key", F.col("delivery_id").alias("event_id"))


def q_folder_sizes(spark, d):
    """Every folder of a tree four levels deep per language; files of ``src3`` folders are junk."""
    inv = documents_inventory(spark, d)
    deep = F.concat_ws("/", "owner", (F.col("doc_id") % 10).cast("string"), F.floor(F.col("doc_id") / 50).cast("string"),
                       F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    return folder_sizes(inv.withColumn("key", deep), ["lang"], names=("src3",))


def q_stream_progress(spark, d):
    """The chunks of five transfers in four files, each spread over the whole time, one per micro-batch."""
    ev = table(spark, d, "events").select("event_type", "event_id", "ts", F.floor(F.col("value") * 1024).cast("bigint").alias("n"))
    chunks = running_sum(ev, ["event_type"], ["ts", "event_id"], "n", "done", total="total")
    base = work_dir(spark, "stream_progress")
    (chunks.select("event_type", "event_id", (F.col("done") - F.col("n")).alias("start"), "n", "total")
     .repartition(4, "event_id").write.option("maxRecordsPerFile", 0).parquet(f"{base}/in"))
    stream = spark.readStream.schema("event_type string, event_id long, start long, n long, total long").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKSDB)
    try:
        out = stream_transfer_progress(stream, ["event_type"], ["event_id"], start_col="start", n_col="n", total_col="total")
        q = (out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{base}/checkpoint")
             .option("path", f"{base}/out").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    if q.exception():
        raise q.exception()
    return spark.read.schema(out.schema).parquet(f"{base}/out").select("event_type", "event_id", "pct", "done")


def q_observed_transfer(spark, d):
    inv = documents_inventory(spark, d, content=True)
    out, obs = observed_transfer(inv, "length")
    out.write.mode("overwrite").parquet(work_dir(spark, "transfer"))
    m = obs.get
    return spark.createDataFrame([(int(m["bytes"]), int(m["files"]))], "bytes bigint, files bigint")


QUERIES = {
    "current_bundles": current_bundles,
    "list_objects": q_list_objects,
    "object_preview": q_object_preview,
    "binary_preview": q_binary_preview,
    "nested_lookup": q_nested_lookup,
    "exclude_component": _excluding("component"),
    "exclude_directory": _excluding("directory"),
    "exclude_substring": _excluding("substring"),
    "tree_stats": q_tree_stats,
    "human_bytes": q_human_bytes,
    "human_bytes_ties": q_human_bytes_ties,
    "human_bytes_large": q_human_bytes_large,
    "size_report": q_size_report,
    "size_guard": q_size_guard,
    "fetch_user_archive": q_fetch_user_archive,
    "missing_archives": q_missing_archives,
    "layered_settings": q_layered_settings,
    "settings_report": q_settings_report,
    "key_collisions": q_key_collisions,
    "transfer_progress": q_transfer_progress,
    "latest_delivery": q_latest_delivery,
    "stream_delivery_ledger": q_stream_delivery_ledger,
    "bundle_plan": q_bundle_plan,
    "pack_roundtrip": q_pack_roundtrip,
    "pack_folders": q_pack_folders,
    "deliver_restore": q_deliver_restore,
    "deliver_manifest": q_deliver_manifest,
    "restore_shared_slug": q_restore_shared_slug,
    "copy_collisions": q_copy_collisions,
    "endpoint_inventory": q_endpoint_inventory,
    "file_keys": q_file_keys,
    "redact_presence": q_redact_presence,
    "delivery_keys": q_delivery_keys,
    "object_inventory": q_object_inventory,
    "copy_objects": q_copy_objects,
    "publish": q_publish,
    "publish_replace": q_publish_replace,
    "publish_merge": q_publish_merge,
    "compact_objects": q_compact_objects,
    "unpack_lateral": q_unpack_lateral,
    "find_archives": q_find_archives,
    "stream_transfer_totals": q_stream_transfer_totals,
    "frontier_inventory": q_frontier_inventory,
    "restore_paths": q_restore_paths,
    "archive_ranges": q_archive_ranges,
    "overlapping_editions": q_overlapping_editions,
    "audit_sketches": q_audit_sketches,
    "folder_sizes": q_folder_sizes,
    "stream_progress": q_stream_progress,
    "observed_transfer": q_observed_transfer,
}


# ---------------------------------------------------------------------------------------------
# DuckDB oracles
# ---------------------------------------------------------------------------------------------

def _human_sql(n: str) -> str:
    return (f"CASE WHEN abs({n}) < 1024 THEN CAST({n} AS VARCHAR) || ' B' "
            f"WHEN abs({n}) < 1048576 THEN printf('%.1f KB', {n} / 1024.0) "
            f"WHEN abs({n}) < 1073741824 THEN printf('%.1f MB', {n} / 1048576.0) "
            f"WHEN abs({n}) < 1099511627776 THEN printf('%.1f GB', {n} / 1073741824.0) "
            f"ELSE printf('%.1f TB', {n} / 1099511627776.0) END")


INV = ("inv AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS key, "
       "CAST(strlen(text) AS BIGINT) AS length, source, lang, doc_id, text FROM documents)")

DELIV = ("dl AS (SELECT event_type AS prefix, event_type AS course, 'user.' || user_id AS owner, "
         "event_type || '/materials_' || replace('user.' || user_id, '.', '_') || '.tar.gz' AS key, "
         "CAST(floor(value * 1024) AS BIGINT) AS length, ts, event_id AS delivery_id, user_id FROM events)")

SIZES = "CAST(floor(l_extendedprice * l_partkey * l_quantity) AS BIGINT)"
TIES = "CAST(floor(l_quantity * 256) AS BIGINT) * l_linenumber"
EXT = r"^(\.*[^.].*?|\.*)(\.[^.]*)?$"

MODE_KEYS = """WITH k AS (SELECT doc_id, lang || '/' || CASE doc_id % 4 WHEN 0 THEN '__pycache__/f.txt'
        WHEN 1 THEN '__pycache__' WHEN 2 THEN 'my__pycache__file' ELSE 'f.txt' END AS key FROM documents)
        SELECT doc_id, key FROM k WHERE doc_id % 4"""
# exact in HUGEINT: tenths with halves to even
LARGE = f"""SELECT l_orderkey, l_linenumber, n, (t // 10) || '.' || (t % 10) || ' TB' AS human FROM (
        SELECT *, q + CASE WHEN r * 2 > {1 << 40} OR (r * 2 = {1 << 40} AND q % 2 = 1) THEN 1 ELSE 0 END AS t FROM (
        SELECT *, CAST(n AS HUGEINT) * 10 // {1 << 40} AS q, CAST(n AS HUGEINT) * 10 % {1 << 40} AS r FROM (
        SELECT l_orderkey, l_linenumber,
          ((l_partkey * 2 + l_linenumber) * 2 + 33001) * {1 << 38} // 5 + l_orderkey % 3 - 1 AS n FROM lineitem)))"""

ORACLE = {
    "current_bundles": f"""WITH {DELIV}
        SELECT key, owner, course, delivery_id, ts, length, {_human_sql('length')} AS human FROM dl
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, delivery_id DESC) = 1""",
    "list_objects": f"""WITH {INV} SELECT key, length FROM inv WHERE starts_with(key, 'src1/en/')
        ORDER BY key LIMIT 10""",
    "object_preview": """SELECT doc_id, left(text, list_max(list_filter(range(0, 65),
        lambda n: strlen(left(text, n)) <= 64))) AS head FROM documents""",
    "binary_preview": """SELECT doc_id, left(text, list_max(list_filter(range(0, 62),
        lambda n: strlen(left(text, n)) <= 61))) AS head FROM documents""",
    "exclude_component": f"{MODE_KEYS} IN (2, 3)",
    "exclude_directory": f"{MODE_KEYS} IN (1, 2, 3)",
    "exclude_substring": f"{MODE_KEYS} = 3",
    "nested_lookup": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "tree_stats": f"""WITH {INV} SELECT source AS owner, CAST(sum(length) AS BIGINT) AS total_bytes,
        count(*) AS n_files FROM inv
        WHERE NOT list_has_any(list_slice(string_split(key, '/'), 1, len(string_split(key, '/')) - 1), ['es', 'src3'])
        GROUP BY source""",
    "human_bytes": f"""SELECT l_orderkey, l_linenumber, n, {_human_sql('n')} AS human
        FROM (SELECT l_orderkey, l_linenumber, {SIZES} AS n FROM lineitem)""",
    "human_bytes_ties": f"""SELECT l_orderkey, l_linenumber, n, {_human_sql('n')} AS human
        FROM (SELECT l_orderkey, l_linenumber, {TIES} AS n FROM lineitem)""",
    "human_bytes_large": LARGE,
    "size_report": f"""SELECT l_orderkey, total_bytes, n_files, {_human_sql('total_bytes')} AS human
        FROM (SELECT l_orderkey, CAST(sum({TIES}) AS BIGINT) AS total_bytes, count(*) AS n_files
              FROM lineitem GROUP BY l_orderkey)""",
    "size_guard": """SELECT user_id, CAST(sum(CAST(floor(value * 1024) AS BIGINT)) AS BIGINT) AS total_bytes
        FROM events GROUP BY user_id HAVING sum(CAST(floor(value * 1024) AS BIGINT)) > 3 * 1024 * 1024""",
    "fetch_user_archive": """WITH k AS (SELECT DISTINCT event_type || '/materials_user_' || user_id || '.tar.gz' AS key
        FROM events), u AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS usr FROM events)
        SELECT usr, min(key) AS key FROM u JOIN k ON starts_with(key, 'click/')
        AND ends_with(key, usr || '.tar.gz') GROUP BY usr""",
    "missing_archives": """SELECT c_custkey FROM customer WHERE NOT EXISTS
        (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'click')""",
    "layered_settings": """WITH o AS (SELECT user_id, CASE WHEN max(value) FILTER (WHERE event_type = 'signup') > 100
        THEN 'override:' || user_id ELSE '' END AS v FROM events GROUP BY user_id),
        e AS (SELECT user_id, CASE WHEN max(value) > 150 THEN 'env:' || user_id WHEN max(value) > 100 THEN '' END AS v
        FROM events WHERE event_type = 'purchase' GROUP BY user_id)
        SELECT o.user_id, coalesce(nullif(o.v, ''), e.v, 'localhost:9092') AS resolved,
        coalesce(nullif(o.v, ''), nullif(e.v, ''), 'localhost:9092') AS effective
        FROM o LEFT JOIN e ON o.user_id = e.user_id""",
    "settings_report": """WITH o AS (SELECT user_id, CASE WHEN max(value) FILTER (WHERE event_type = 'signup') > 100
        THEN 'override:' || user_id ELSE '' END AS v FROM events GROUP BY user_id),
        e AS (SELECT user_id, CASE WHEN max(value) > 150 THEN 'env:' || user_id WHEN max(value) > 100 THEN '' END AS v
        FROM events WHERE event_type = 'purchase' GROUP BY user_id),
        s AS (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY user_id HAVING max(value) > 300)
        SELECT o.user_id, coalesce(nullif(o.v, ''), nullif(e.v, ''), 'localhost:9092') AS kafka_bootstrap,
        CAST(NULL AS VARCHAR) AS schema_registry_url, CAST(NULL AS VARCHAR) AS flink_rest_url,
        CAST(NULL AS VARCHAR) AS kafka_sasl_username, false AS has_kafka_sasl_password,
        CAST(NULL AS VARCHAR) AS jupyterhub_user, CAST(NULL AS VARCHAR) AS course,
        CAST(NULL AS VARCHAR) AS github_branch, CAST(NULL AS VARCHAR) AS github_repo,
        CAST(NULL AS VARCHAR) AS aws_region, false AS has_aws_access_key_id,
        s.user_id IS NOT NULL AS has_aws_secret_access_key, 'default-chain' AS credentials
        FROM o LEFT JOIN e ON o.user_id = e.user_id LEFT JOIN s ON o.user_id = s.user_id""",
    "key_collisions": """SELECT (CASE WHEN event_type IN ('click', 'view') THEN 'student' ELSE event_type END)
        || '/materials_user_' || user_id || '.tar.gz' AS key, count(DISTINCT event_type) AS n_courses,
        count(DISTINCT user_id) AS n_owners, count(*) AS n_writes FROM events GROUP BY 1
        HAVING count(DISTINCT event_type) > 1 OR count(DISTINCT user_id) > 1""",
    "transfer_progress": """WITH e AS (SELECT event_type, event_id, ts, CAST(floor(value * 1024) AS BIGINT) AS n FROM events),
        r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS done,
              sum(n) OVER (PARTITION BY event_type) AS total FROM e),
        p AS (SELECT *, (done * 100) // total AS pct FROM r WHERE total > 0),
        l AS (SELECT *, coalesce(lag(pct // 10) OVER (PARTITION BY event_type ORDER BY ts, event_id), 0) AS pd FROM p)
        SELECT event_type, event_id, CAST(pct AS BIGINT) AS pct, CAST(done AS BIGINT) AS done FROM l
        WHERE pct // 10 > pd""",
    "latest_delivery": """SELECT event_type, user_id, event_id, ts FROM events
        QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "stream_delivery_ledger": """SELECT event_type, user_id, event_id, ts FROM events
        QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "bundle_plan": f"""WITH {INV} SELECT owner, part, count(*) AS n_files, CAST(sum(length) AS BIGINT) AS bytes
        FROM (SELECT source AS owner, length, CAST((sum(length) OVER (PARTITION BY source ORDER BY key
              ROWS UNBOUNDED PRECEDING) - length) // {PART_BYTES} AS BIGINT) AS part FROM inv)
        GROUP BY owner, part""",
    "pack_roundtrip": f"WITH {INV} SELECT key, length, md5(text) AS digest FROM inv",
    "pack_folders": """SELECT source AS owner, lang AS folder, 'sub/' || doc_id AS key, strlen(text) AS length, md5(text) AS digest
        FROM documents WHERE doc_id % 5 <> 0""",
    "deliver_restore": f"""WITH {INV} SELECT CASE WHEN source = 'src1' THEN 'new/' || key ELSE key END AS key, length,
        md5(text) AS digest FROM inv""",
    "deliver_manifest": f"""WITH {INV}, t AS (SELECT source, doc_id, 'results' AS bucket,
        CASE WHEN source = 'src1' THEN 2 ELSE 1 END AS delivery_id, key, length FROM inv
        UNION ALL SELECT source, doc_id, 'users', 3, key, length FROM inv WHERE source = 'src2' AND doc_id % 2 = 0),
        p AS (SELECT *, (sum(length) OVER (PARTITION BY bucket, source ORDER BY key ROWS UNBOUNDED PRECEDING) - length)
              // CASE WHEN delivery_id = 3 THEN {64 * 1024 * 1024} ELSE {PART_BYTES} END AS part FROM t)
        SELECT bucket, 'course/materials_' || source || '.tar.gz' AS key, CAST(delivery_id AS BIGINT) AS delivery_id,
        count(DISTINCT part) AS n_archives, count(*) AS n_files, CAST(sum(length) AS BIGINT) AS bytes FROM p GROUP BY ALL""",
    "restore_shared_slug": f"""WITH {INV} SELECT lang || '.' || source AS owner, key, md5(text) AS digest FROM inv
        WHERE doc_id % 2 = 0""",
    "copy_collisions": """SELECT 'p/' || doc_id % 7 || '_' || source || '.txt' AS key, count(*) AS n_objects
        FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "endpoint_inventory": """WITH a AS (SELECT regexp_replace(regexp_extract(url,
        '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '') AS auth FROM pages)
        SELECT split_part(auth, ':', 1) AS host,
        CASE WHEN strpos(auth, ':') = 0 OR substr(auth, strpos(auth, ':') + 1) = '' THEN 443
             ELSE TRY_CAST(substr(auth, strpos(auth, ':') + 1) AS INTEGER) END AS port,
        count(*) AS n FROM a WHERE auth <> '' GROUP BY 1, 2""",
    "file_keys": f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN b ELSE
        regexp_replace(b, '{EXT}', '\\1') || '_u_' || page_id % 50 || regexp_extract(b, '{EXT}', 2) END AS key
        FROM (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS b FROM pages)""",
    "redact_presence": """SELECT c_custkey, (c_name IS NOT NULL AND c_name <> '') AS has_name,
        nullif(c_mktsegment, '') AS segment FROM customer""",
    "delivery_keys": f"WITH {DELIV} SELECT delivery_id AS event_id, key FROM dl",
    "object_inventory": f"WITH {INV} SELECT key, length FROM inv",
    "copy_objects": f"""WITH {INV} SELECT source || '/' || lang || '/doc_' || doc_id || '_' || replace(source, '.', '_')
        || '.txt' AS key, length, md5(text) AS digest FROM inv""",
    "publish": f"""WITH {DELIV} SELECT key, delivery_id AS event_id FROM dl
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, delivery_id DESC) = 1""",
    "publish_replace": f"""WITH {DELIV}, b AS (SELECT *, CASE WHEN dayofweek(ts) % 2 = 1 THEN 'a' ELSE 'b' END AS bkt FROM dl)
        SELECT bkt AS bucket, key, delivery_id AS event_id FROM b
        QUALIFY row_number() OVER (PARTITION BY bkt, key
        ORDER BY delivery_id % 3 > 0 DESC, ts DESC, delivery_id DESC) = 1""",
    "frontier_inventory": """SELECT CASE WHEN doc_id % 3 = 0 THEN '.hot' ELSE '_' || source END || '/' || doc_id // 20 || '/_doc' || doc_id AS key,
        CAST(strlen(text) AS BIGINT) AS length FROM documents""",
    "restore_paths": f"WITH {INV} SELECT key, length, md5(text) AS digest FROM inv WHERE doc_id % 10 = 3",
    "archive_ranges": f"WITH {INV} SELECT key, substr(hex(text), 201, 80) AS bytes FROM inv",
    "overlapping_editions": """WITH e AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'student' ELSE 'staff' END
          || '/materials_user_' || user_id || '.tar.gz' AS key, event_type AS course, min(ts) AS first_ts, max(ts) AS last_ts,
          count(*) AS n_writes FROM events GROUP BY ALL),
        u AS (SELECT *, max(last_ts) OVER (PARTITION BY key ORDER BY first_ts, course ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM e)
        SELECT key, course, n_writes, until, coalesce(first_ts <= until, false) AS overlaps FROM u""",
    "audit_sketches": """SELECT CASE WHEN event_type IN ('click', 'view') THEN 'student' ELSE 'staff' END
          || '/materials_user_' || user_id || '.tar.gz' AS key, count(DISTINCT event_type) AS n_course,
          count(DISTINCT user_id) AS n_owner, count(*) AS n_writes FROM events GROUP BY 1
        HAVING count(DISTINCT event_type) > 1 OR count(DISTINCT user_id) > 1""",
    "compact_objects": f"WITH {INV} SELECT source AS owner, key, length, md5(text) AS digest FROM inv",
    "unpack_lateral": f"WITH {INV} SELECT source AS owner, key, length, md5(text) AS digest FROM inv",
    "find_archives": """WITH k AS (SELECT DISTINCT event_type || '/materials_user_' || user_id || '.tar.gz' AS key FROM events),
        u AS (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 7)
        SELECT 'user.' || user_id AS usr, min(key) AS key FROM u JOIN k ON ends_with(key, 'user_' || user_id || '.tar.gz') GROUP BY 1""",
    "stream_transfer_totals": "SELECT CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS files FROM documents",
    "publish_merge": f"""WITH {DELIV}, b AS (SELECT *, CASE WHEN dayofweek(ts) % 2 = 1 THEN 'a' ELSE 'b' END AS bkt,
          delivery_id % 3 AS step FROM dl),
        w AS (SELECT bkt, key, step, ts, delivery_id FROM b
              WHERE step = 0 OR (step = 1 AND user_id % 7 <> 0) OR (step = 2 AND user_id % 2 = 0)),
        gone AS (SELECT DISTINCT bkt, key FROM b WHERE user_id % 7 = 0)
        SELECT bkt AS bucket, key, delivery_id AS event_id FROM w
        WHERE step > 0 OR NOT EXISTS (SELECT 1 FROM gone g WHERE g.bkt = w.bkt AND g.key = w.key)
        QUALIFY row_number() OVER (PARTITION BY bkt, key ORDER BY step DESC, ts DESC, delivery_id DESC) = 1""",
    "folder_sizes": """WITH RECURSIVE f AS (SELECT lang, strlen(text) AS n,
          [source, CAST(doc_id % 10 AS VARCHAR), CAST(doc_id // 50 AS VARCHAR)] AS dirs FROM documents WHERE source <> 'src3'),
        up AS (SELECT lang, dirs, sum(n) AS total_bytes, count(*) AS n_files FROM f GROUP BY ALL
          UNION ALL SELECT lang, dirs[1:len(dirs) - 1], total_bytes, n_files FROM up WHERE len(dirs) > 0)
        SELECT lang, array_to_string(dirs, '/') AS folder, len(dirs) AS depth, CAST(sum(total_bytes) AS BIGINT) AS total_bytes,
        CAST(sum(n_files) AS BIGINT) AS n_files FROM up GROUP BY lang, dirs""",
    "observed_transfer": "SELECT CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS files FROM documents",
}
ORACLE["stream_progress"] = ORACLE["transfer_progress"]
