"""Session helpers: sensible defaults for a local session and the shared work folder.

Operators never create a session themselves; they take one (or a DataFrame) as an argument.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults for a local session (tests, bench). On a cluster the submitter's conf wins.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # stream state on local disk, not in the heap: a ledger keeps one row per key for ever
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # bodies travel to Python workers in Arrow batches of bounded bytes, not only bounded rows
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "courier",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _context(spark: SparkSession):
    """The SparkContext of a classic session; ``None`` under Spark Connect."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions have no SparkContext
        return None


def _master(spark: SparkSession) -> str:
    sc = _context(spark)
    return sc.master if sc is not None else spark.conf.get("spark.master", "")


def work_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The folder is read from the session (``spark.checkpoint.dir``). Only a local master may fall
    back to a folder of its own, because there every task runs on this machine.
    """
    sc = _context(spark)
    base = (sc.getCheckpointDir() if sc is not None else None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if sc is None or not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="courier-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    path = "/".join([base.rstrip("/"), *parts, uuid.uuid4().hex])
    return path


def scheme_of(uri: str) -> str:
    """``s3a://b/x`` → ``s3a``; a plain path has none."""
    head, colon, _ = uri.partition(":")
    return head.lower() if colon and head.isascii() and head.replace("+", "").replace("-", "").replace(".", "").isalnum() else ""


def local_path(uri: str) -> str:
    """``file:/x`` → ``/x`` for the Python workers that open files themselves. Any other scheme
    raises: such a path would name a relative folder on each worker's own disk."""
    if scheme_of(uri) not in ("", "file"):
        raise ValueError(f"{uri}: only file: paths on a mount that every worker sees can be served here")
    if uri.startswith("file://"):
        return uri[len("file://"):]
    if uri.startswith("file:"):
        return uri[len("file:"):]
    return uri


def ensure_dir(path: str) -> str:
    os.makedirs(local_path(path), exist_ok=True)
    return path


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``courier`` importable in Python workers (needed by the Python Data Sources, whose
    classes are pickled by reference).

    On a cluster the package is deployed with the job (``--py-files`` or installed on the image);
    on a local master, when running from a source checkout, it is zipped into the session's
    checkpoint folder and added with ``addPyFile`` once per application.
    """
    sc = _context(spark)
    if sc is None:
        return
    app = sc.applicationId
    if app in _shipped or not sc.master.startswith("local"):
        return
    import shutil

    import courier

    pkg_dir = os.path.dirname(os.path.abspath(courier.__file__))
    # the driver serves the file to the executors; only a local master comes here
    shared = work_dir(spark, "pyfiles")
    dest = local_path(shared) if scheme_of(shared) in ("", "file") else tempfile.mkdtemp(prefix="courier-")
    os.makedirs(dest, exist_ok=True)
    archive = shutil.make_archive(os.path.join(dest, "courier"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="courier")
    sc.addPyFile(archive)
    _shipped.add(app)


def materialise(df, name: str):
    """Write ``df`` as a table under the shared checkpoint folder and read it back. What later jobs
    compute from it agrees, whatever plan they get and whatever executors are lost."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
