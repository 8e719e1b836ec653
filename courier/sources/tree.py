"""``courier_tree``: a Python Data Source that lists a directory tree as an inventory.

Spark's own file listing (``binaryFile``) hides names that start with ``.`` or ``_`` and follows
symbolic links; an inventory of a home folder must keep ``.bashrc`` and ``__init__.py`` and must
not count links. The driver reads at most ``plan_entries`` directory entries to split the tree; what
it has not read is dealt to all tasks by a hash of the entry names, so one flat folder, however
large, spreads over all of them. Options:

* ``path`` – root folder on a mount that every executor sees (a plain or ``file:`` path);
* ``content`` – ``true`` to read bodies; one that cannot be read gives a row with ``_error``;
* ``max_bytes`` – read only so much of each body, into ``head``; ``content`` stays empty;
* ``folders`` – ``true`` to list empty folders too (``is_dir``);
* ``prefix`` – only keys that start with it (directories that cannot match are not walked);
* ``suffix`` – only keys that end with it (other files are neither asked for their size nor opened);
* ``prune`` – comma-separated directory names not to descend (the size-up rule);
* ``partitions`` – number of tasks;
* ``plan_entries`` – how many directory entries the driver may read to split the tree.

Filters on ``key`` that Spark pushes down (starts with, ends with, equals) become ``prefix`` and
``suffix``.
"""

from __future__ import annotations

import datetime as _dt
import os
import stat as _stat
import zlib
from collections import deque

from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, InputPartition, StringEndsWith,
                                    StringStartsWith)

SCHEMA = ("key string, length bigint, is_link boolean, link_target string, is_dir boolean, mode int, "
          "modified timestamp_ntz, content binary, head binary, _error string")

#: Folder under a target where objects are staged; it holds no objects.
STAGING = ".courier-staging"

#: An Arrow batch of the listing ends at so many rows or bytes of bodies.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


class _Shard(InputPartition):
    def __init__(self, index: int, of: int, flat: list[str], shared: list[str]):
        super().__init__(index)
        self.index, self.of = index, of
        self.flat = flat  # directories whose own files this task lists
        self.shared = shared  # directories of which this task takes the entries that hash to it


class TreeDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "courier_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return TreeBatches(dict(self.options))


def _could_match(rel: str, prefix: str) -> bool:
    """Can a key under directory ``rel`` start with ``prefix``?"""
    if not prefix:
        return True
    d = rel + "/"
    return d.startswith(prefix) or prefix.startswith(d)


def _join(rel: str, name: str) -> str:
    return f"{rel}/{name}" if rel else name


def _true(options: dict, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        from ..session import local_path

        root = options.get("path") or options.get("root")
        if not root:
            raise ValueError("courier_tree needs a path")
        self.root = local_path(root).rstrip("/") or "/"
        self.content, self.folders = _true(options, "content"), _true(options, "folders")
        self.max_bytes = int(options.get("max_bytes", "-1"))
        self.prefix, self.suffix, self.nothing = options.get("prefix", ""), options.get("suffix", ""), False
        self.prune = tuple(p for p in options.get("prune", "").split(",") if p)
        self.n = max(1, int(options.get("partitions", "8")))
        self.plan_entries = int(options.get("plan_entries", str(256 * self.n)))

    def pushFilters(self, filters):
        """Takes what narrows the listing; all else stays with Spark."""
        for f in filters:
            of_key = getattr(f, "attribute", None) == ("key",)
            if of_key and isinstance(f, (StringStartsWith, EqualTo)) and isinstance(f.value, str):
                long, short = (f.value, self.prefix) if len(f.value) >= len(self.prefix) else (self.prefix, f.value)
                self.prefix, self.nothing = long, self.nothing or not long.startswith(short)
            if of_key and isinstance(f, (StringEndsWith, EqualTo)) and isinstance(f.value, str):
                long, short = (f.value, self.suffix) if len(f.value) >= len(self.suffix) else (self.suffix, f.value)
                self.suffix, self.nothing = long, self.nothing or not long.endswith(short)
            if not (of_key and isinstance(f, (StringStartsWith, StringEndsWith))):
                yield f

    def _descends(self, entry, rel: str) -> bool:
        return (entry.is_dir(follow_symlinks=False) and entry.name not in self.prune
                and rel != STAGING and _could_match(rel, self.prefix))

    def partitions(self):
        """Directories read whole within the budget go to one task each; the others to all tasks."""
        if self.nothing or not os.path.isdir(self.root):
            return [_Shard(0, 1, [], [])]
        flat, shared, queue, left = [], [], deque([""]), self.plan_entries
        while queue:
            rel = queue.popleft()
            children, whole = [], left > 0
            if whole:
                with os.scandir(os.path.join(self.root, rel)) as it:
                    for e in it:
                        left -= 1
                        if left < 0:
                            whole = False  # too large to read here
                            break
                        if self._descends(e, _join(rel, e.name)):
                            children.append(_join(rel, e.name))
            (flat if whole else shared).append(rel)
            if whole:
                queue.extend(children)
        deal = [flat[i::self.n] for i in range(self.n)]
        return [_Shard(i, self.n, deal[i], shared) for i in range(self.n) if deal[i] or shared]

    def _row(self, entry, rel: str):
        st = entry.stat(follow_symlinks=False)  # cached by scandir where the OS allows
        mod = _dt.datetime.fromtimestamp(st.st_mtime, _dt.timezone.utc).replace(tzinfo=None)
        mode = _stat.S_IMODE(st.st_mode)
        if _stat.S_ISDIR(st.st_mode):
            return (rel, 0, False, None, True, mode, mod, None, None, None)
        if _stat.S_ISLNK(st.st_mode):
            return (rel, int(st.st_size), True, os.readlink(entry.path), False, mode, mod, None, None, None)
        if not _stat.S_ISREG(st.st_mode):
            return None
        body = head = error = None
        if self.content or self.max_bytes >= 0:
            try:
                with open(entry.path, "rb") as f:
                    if self.max_bytes >= 0:
                        head = f.read(self.max_bytes)
                    else:
                        body = f.read()
            except OSError as e:
                error = f"{rel}: {e.strerror or e}"
        return (rel, int(st.st_size), False, None, False, mode, mod, body, head, error)

    def _entries(self, rel: str):
        """Entries of a directory as they come; one that is gone meanwhile has none."""
        try:
            with os.scandir(os.path.join(self.root, rel)) as it:
                yield from it
        except FileNotFoundError:
            return

    def _files(self, entries, rel: str):
        for e in entries:
            key = _join(rel, e.name)
            folder = e.is_dir(follow_symlinks=False)
            if not key.startswith(self.prefix) or not key.endswith(self.suffix) or (folder and not self._is_empty(key)):
                continue
            try:
                row = self._row(e, key)
            except FileNotFoundError:  # removed while listing
                continue
            if row is not None:
                yield row

    def _is_empty(self, rel: str) -> bool:
        return self.folders and rel != STAGING and next(self._entries(rel), None) is None

    def _walk(self, top: str):
        stack = [top]
        while stack:
            rel = stack.pop()
            yield from self._files(self._entries(rel), rel)
            stack.extend(_join(rel, e.name) for e in self._entries(rel) if self._descends(e, _join(rel, e.name)))

    def read(self, partition: _Shard):
        mine = lambda e: zlib.crc32(os.fsencode(e.name)) % partition.of == partition.index
        for rel in partition.flat:
            yield from self._files(self._entries(rel), rel)
        for rel in partition.shared:
            yield from self._files(filter(mine, self._entries(rel)), rel)
            for e in filter(mine, self._entries(rel)):
                if self._descends(e, _join(rel, e.name)):
                    yield from self._walk(_join(rel, e.name))


class TreeBatches(TreeReader):
    """The rows as Spark gets them: in Arrow batches that bodies fill up too. Tuples it would gather by
    number alone, ten thousand bodies at a time."""

    def read(self, partition: _Shard):
        rows, size = [], 0
        for row in super().read(partition):
            rows.append(row)
            size += len(row[7] or b"") + len(row[8] or b"")
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list):
    import pyarrow as pa

    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(),
             "timestamp_ntz": pa.timestamp("us")}
    fields = [f.split() for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)],
                                      names=[n for n, _ in fields])


def register(spark) -> None:
    from ..session import ship_package

    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off by default; a source that takes filters needs it
    spark.dataSource.register(TreeDataSource)


def object_inventory(spark, root: str, *, content: bool = False, prefix: str = "", folders: bool = False,
                     prune=(), partitions: int | None = None, max_bytes: int = -1):
    """Inventory of a tree: ``key`` (relative to ``root``), ``length``, ``is_link``, ``link_target``,
    ``is_dir`` (empty folders, with ``folders=True``), ``mode``, ``modified``; with ``content=True``
    the body and ``_error`` (why it could not be read), with ``max_bytes`` its first bytes as ``head``.
    A missing root gives no rows.

    A plain or ``file:`` root is listed by the tasks themselves, so it must be a mount that every
    executor sees. Any other scheme goes through the Hadoop file system (:func:`binary_inventory`).
    """
    from ..session import _context, scheme_of

    if scheme_of(root) not in ("", "file"):
        if folders or max_bytes >= 0:
            raise ValueError(f"{root}: folders and max_bytes need a plain or file: path")
        from pyspark.sql import functions as F

        df = binary_inventory(spark, root, content=content).where(F.col("key").startswith(prefix))
        for name in prune:
            df = df.where(~F.array_contains(F.slice(F.split("key", "/"), 1, F.size(F.split("key", "/")) - 1), name))
        return df
    register(spark)
    sc = _context(spark)
    n = partitions or 2 * max(1, sc.defaultParallelism if sc is not None else 8)
    reader = (spark.read.format("courier_tree").option("content", str(content).lower())
              .option("prefix", prefix).option("prune", ",".join(prune)).option("folders", str(folders).lower())
              .option("partitions", str(n)).option("max_bytes", str(max_bytes)))
    unused = ([] if folders else ["is_dir"]) + ([] if max_bytes >= 0 else ["head"]) + (
        [] if content or max_bytes >= 0 else ["_error"]) + ([] if content and max_bytes < 0 else ["content"])
    return reader.load(root).drop(*unused)


def binary_inventory(spark, root: str, *, content: bool = False):
    """Inventory through Spark's ``binaryFile`` source, for every store that Hadoop opens (``s3a:``,
    ``hdfs:``, ``file:`` …). That source leaves out names that begin with ``.`` or ``_`` and follows
    links. Without ``content`` the bodies are not read. A scheme that Hadoop cannot open raises."""
    from pyspark.sql import functions as F

    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/") + "/"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    cols = [F.substring("path", len(base) + 1, 1 << 30).alias("key"), F.col("length"), F.lit(False).alias("is_link"),
            F.col("modificationTime").cast("timestamp_ntz").alias("modified")]
    if content:
        cols.append(F.col("content"))
    return df.select(*cols)
