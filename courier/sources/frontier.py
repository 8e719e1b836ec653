"""Complete listing of a tree, level by level, each level one Spark job.

A job takes the folders of a level as rows and lists each in the task that has it; the folders it
finds, stored and dealt anew to all tasks, are the next level. However the tree is shaped, no task
gets a subtree: a home that holds a third of all files is as many rows as it has folders. Listing
only reads names and kinds; what has to be asked of each entry (size, mode, time, link) is asked in a
last job over all entries, dealt anew as well, so one flat folder of any size costs one task its names
alone. The driver sees the number of folders per level, never a name.

Folders are read with ``os.scandir`` on a mount, and with ``pyarrow.fs`` on other stores (``s3:``,
``gs:``, ``hdfs:`` …; ``lister="arrow"`` for mounts too), where the listing itself brings the sizes.
Names beginning with ``.`` or ``_`` are kept. On a mount links are entries of their own; ``pyarrow``
follows links to files and reports them as such, and links to folders are not descended.

Defined results: a missing root has no entries; folders and files that vanish while listing are left
out; a folder that may not be read raises; names that are no UTF-8 raise; empty folders are rows with
``folders=True``; an empty tree gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import _context, local_path, materialise, scheme_of, ship_package
from .tree import STAGING

_FOUND = "key string, is_dir boolean, n_entries long, length long, is_link boolean, modified timestamp_ntz"
_ENTRY = "key string, length long, is_link boolean, link_target string, is_dir boolean, mode int, modified timestamp_ntz"
#: Rows of a listing that are handed back at once.
ROWS = 10_000


def _scan_local(root: str):
    import os

    def entries(rel: str):
        try:
            with os.scandir(os.path.join(root, rel) if rel else root) as it:
                for e in it:
                    e.name.encode()  # no UTF-8: raise here, not somewhere behind
                    yield e.name, e.is_dir(follow_symlinks=False), None, None, None
        except (FileNotFoundError, NotADirectoryError):
            return

    return entries


def _scan_arrow(uri: str):
    def entries(rel: str):
        import os

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        path = f"{base.rstrip('/')}/{rel}" if rel else base
        for e in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            folder = e.type == fs.FileType.Directory
            if folder and isinstance(store, fs.LocalFileSystem) and os.path.islink(e.path):
                continue
            if folder or e.type == fs.FileType.File:
                time = e.mtime.replace(tzinfo=None) if e.mtime is not None else None
                yield e.base_name, folder, None if folder else e.size, False, time

    return entries


def _lister(entries, prune: tuple, prefix: str):
    """Folder rows → their entries; a last row says how many entries the folder has."""
    from .tree import _could_match

    def run(batches):
        import pandas as pd

        columns = ["key", "is_dir", "n_entries", "length", "is_link", "modified"]

        def frame(rows):
            out = pd.DataFrame(rows, columns=columns)
            out["modified"] = pd.to_datetime(out["modified"])
            return out.astype({"n_entries": "Int64", "length": "Int64", "is_link": "boolean"})

        rows = []
        for pdf in batches:
            for folder in pdf["key"]:
                n = 0
                for name, is_dir, length, is_link, modified in entries(folder):
                    key = f"{folder}/{name}" if folder else name
                    n += 1
                    if is_dir and (name in prune or key == STAGING or not _could_match(key, prefix)):
                        continue
                    if is_dir or key.startswith(prefix):
                        rows.append((key, is_dir, None, length, is_link, modified))
                    if len(rows) >= ROWS:
                        yield frame(rows)
                        rows = []
                rows.append((folder, True, n, None, None, None))
        if rows:
            yield frame(rows)

    return run


def _stat(root: str):
    def run(batches):
        import datetime
        import os
        import stat

        import pandas as pd

        columns = ["key", "length", "is_link", "link_target", "is_dir", "mode", "modified"]
        for pdf in batches:
            rows = []
            for key in pdf["key"]:
                path = os.path.join(root, key)
                try:
                    st = os.lstat(path)
                    link = stat.S_ISLNK(st.st_mode)
                    target = os.readlink(path) if link else None
                except FileNotFoundError:  # gone meanwhile
                    continue
                folder = stat.S_ISDIR(st.st_mode)
                if link or folder or stat.S_ISREG(st.st_mode):
                    rows.append((key, 0 if folder else st.st_size, link, target, folder, stat.S_IMODE(st.st_mode),
                                 datetime.datetime.fromtimestamp(st.st_mtime, datetime.timezone.utc).replace(tzinfo=None)))
            out = pd.DataFrame(rows, columns=columns)
            out["modified"] = pd.to_datetime(out["modified"])
            yield out

    return run


def frontier_inventory(spark: SparkSession, root: str, *, prefix: str = "", prune=(), folders: bool = False,
                       partitions: int | None = None, lister: str | None = None) -> DataFrame:
    """``key`` (relative to ``root``), ``length``, ``is_link``, ``link_target``, ``is_dir``, ``mode`` and
    ``modified`` of every file below ``root`` whose key starts with ``prefix``; folders named in
    ``prune`` are not descended. Other stores than mounts have no mode and no link target."""
    ship_package(spark)
    sc = _context(spark)
    n = partitions or 2 * max(1, sc.defaultParallelism if sc is not None else 8)
    mount = scheme_of(root) in ("", "file")
    kind = lister or ("local" if mount else "arrow")
    if kind not in ("local", "arrow") or kind == "local" and not mount:
        raise ValueError(f"{root}: lister must be 'arrow', or 'local' for a mount")
    base = local_path(root).rstrip("/") or "/" if mount else root.rstrip("/")
    entries = _scan_local(base) if kind == "local" else _scan_arrow(f"file://{base}" if mount else base)
    run = _lister(entries, tuple(prune), prefix)
    frontier, found = spark.createDataFrame([("",)], "key string"), []
    while True:
        level = materialise(frontier.mapInPandas(run, _FOUND), "listing")
        found.append(level)
        below = level.where("is_dir AND n_entries IS NULL").select("key")
        if below.isEmpty():
            break
        frontier = below.repartition(n)
    rows = reduce(DataFrame.unionByName, found)
    files = rows.where(~F.col("is_dir"))
    if folders:  # the rows that count a folder's entries
        files = files.unionByName(rows.where("is_dir AND n_entries = 0 AND key <> ''"))
    if kind == "local":
        return files.select("key").repartition(n).mapInPandas(_stat(base), _ENTRY)
    return files.where(F.col("key").startswith(prefix)).select(
        "key", F.coalesce("length", F.lit(0)).alias("length"), F.lit(False).alias("is_link"), F.lit(None).cast("string").alias("link_target"),
        "is_dir", F.lit(None).cast("int").alias("mode"), "modified")
