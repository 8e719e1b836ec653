"""Bundling: plan bounded archives per owner and folder, pack them (tar.gz) and unpack them again."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import archive_name, basename, col_or_lit, slug
from ..schema import BUNDLES, MEMBERS, STAGED
from ..session import local_path, materialise
from .inventory import DEFAULT_EXCLUDE, exclude_paths
from .scan import running_sum

DEFAULT_PART_BYTES = 64 * 1024 * 1024
# Python workers hand back about this many bytes per Arrow batch, or one archive.
OUT_BYTES = 32 * 1024 * 1024


class BundleError(RuntimeError):
    """The objects cannot be bundled without losing or mixing up some of them."""


def bundle_plan(objects: DataFrame, owner_col: str = "owner", key_col: str = "key",
                length_col: str = "length", max_part_bytes: int = DEFAULT_PART_BYTES, *,
                folder_col: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``part`` = ``(bytes before this file in key order) div max_part_bytes`` per owner (and
    folder).

    Exact over the owner's whole key order; computed by the skew-safe running sum, so an owner with
    a third of all files still spreads over many tasks.
    """
    by = [owner_col] if folder_col is None else [owner_col, folder_col]
    r = running_sum(objects, by, [key_col], length_col, "_cum", partitions=partitions)
    part = F.expr(f"(_cum - coalesce({length_col}, 0)) div {int(max_part_bytes)}")
    return r.withColumn("part", part.cast("bigint")).drop("_cum")


def whole_body(df: DataFrame, content_col: str = "content"):
    """The body column; a row whose body could not be read (``_error``) fails the job that needs it."""
    if "_error" not in df.columns:
        return F.col(content_col)
    return F.when(F.col("_error").isNotNull(), F.raise_error(F.concat(F.lit("unreadable object: "), F.col("_error")))
                  ).otherwise(F.col(content_col))


def _writer(root: str | None):
    """A function that adds one member to an open tar: its body from the row, or streamed from the
    file ``root``/key."""
    import io
    import os
    import tarfile

    def add(tar, name, row):
        info = tarfile.TarInfo(name=f"{name}/{row['key']}")
        info.mtime = int(row["_mtime"] or 0)
        info.mode = int(row["_mode"])
        if row["_target"] is not None:
            info.type, info.linkname = tarfile.SYMTYPE, row["_target"]
            tar.addfile(info)
            return 0
        if row["_dir"]:
            info.type = tarfile.DIRTYPE
            tar.addfile(info)
            return 0
        if root is not None:
            with open(os.path.join(root, row["key"]), "rb") as f:
                info.size = os.fstat(f.fileno()).st_size
                tar.addfile(info, f)
            return info.size
        body = row["content"]
        if body is None:
            raise ValueError(f"no body for {row['key']!r} of {row['owner']!r}")
        if row["_len"] == row["_len"] and int(row["_len"]) != len(body):  # not null
            raise ValueError(f"the body of {row['key']!r} has {len(body)} of {int(row['_len'])} bytes")
        info.size = len(body)
        tar.addfile(info, io.BytesIO(bytes(body)))
        return len(body)

    return add


def _packer(level: int, root: str | None = None, stage: str | None = None):
    """Rows sorted by (owner, folder, part, key) → one archive per part, written as the rows pass: into
    memory, or into a file of its own in the folder ``stage``."""
    def pack(batches):
        import gzip
        import io
        import os
        import tarfile
        import uuid

        import pandas as pd

        add, done, held, now = _writer(root), [], 0, None
        columns = ["owner", "folder", "part", "name", "archive", "n_files", "bytes"]
        if stage is not None:
            os.makedirs(stage, exist_ok=True)
            columns = ["owner", "folder", "part", "name", "staged", "compressed", "n_files", "bytes"]

        def begin(row):
            path = os.path.join(stage, uuid.uuid4().hex) if stage is not None else None
            out = open(path, "wb") if path else io.BytesIO()
            gz = gzip.GzipFile(filename="", fileobj=out, mode="wb", mtime=0, compresslevel=level)
            return {"at": (row["owner"], row["_folder"], row["part"]), "name": row["_name"], "out": out, "path": path,
                    "gz": gz, "tar": tarfile.open(fileobj=gz, mode="w", format=tarfile.PAX_FORMAT), "n": 0, "bytes": 0}

        def end(a):
            a["tar"].close()
            a["gz"].close()
            owner, folder, part = a["at"]
            if a["path"]:
                a["out"].close()
                archive = [a["path"], os.path.getsize(a["path"])]
            else:
                archive = [a["out"].getvalue()]
            return (owner, folder, int(part), a["name"], *archive, a["n"], a["bytes"])

        for pdf in batches:
            for row in pdf.to_dict("records"):
                if now is None or now["at"] != (row["owner"], row["_folder"], row["part"]):
                    if now is not None:
                        done.append(end(now))
                        held += len(done[-1][4])
                        if held >= OUT_BYTES:
                            yield pd.DataFrame(done, columns=columns)
                            done, held = [], 0
                    now = begin(row)
                now["bytes"] += add(now["tar"], now["name"], row)
                now["n"] += 1
        if now is not None:
            done.append(end(now))
        if done:
            yield pd.DataFrame(done, columns=columns)

    return pack


def pack_archives(objects: DataFrame, owner_col: str = "owner", *, compresslevel: int = 6, **options) -> DataFrame:
    """Bundle every owner's files into ``tar.gz`` archives, one series of parts per (owner, folder):
    ``(owner, folder, part, name, archive, n_files, bytes)``. ``part`` is the :func:`bundle_plan` part
    of the files, so an archive holds less than ``max_part_bytes`` plus one file. ``options`` are those
    of :func:`part_rows`.

    Members sit under a root directory named like the archive, ``<folder>_<slug>.tar.gz``, sorted,
    with their mode (``mode`` column, else 644), gzip mtime 0 and a fixed ``compresslevel``: a bundle
    is reproducible. Links (``is_link`` and ``link_target``) and empty folders (``is_dir``) are stored
    as such.
    """
    rows, root = part_rows(objects, owner_col, **options)
    return rows.mapInPandas(_packer(compresslevel, root), BUNDLES)


def stage_archives(objects: DataFrame, stage: str, owner_col: str = "owner", *, compresslevel: int = 6,
                   **options) -> DataFrame:
    """The same archives, each written by its task as a file in the folder ``stage``: ``(owner, folder,
    part, name, staged, compressed, n_files, bytes)``. With ``source_root`` files of any size go in."""
    rows, root = part_rows(objects, owner_col, **options)
    return rows.mapInPandas(_packer(compresslevel, root, stage), STAGED)


def part_rows(objects: DataFrame, owner_col: str = "owner", *, key_col: str = "key", content_col: str = "content",
              folder=None, path_col: str | None = None, length_col: str | None = None,
              max_part_bytes: int = DEFAULT_PART_BYTES, exclude: Sequence[str] = DEFAULT_EXCLUDE,
              partitions: int | None = None, source_root: str | None = None) -> tuple[DataFrame, str | None]:
    """The members with their part, where and in the order in which a packer needs them.

    The parts come from keys and lengths alone (``length_col``, by default a column ``length`` if there
    is one; bodies are not read for it). With ``source_root`` the objects are files under that folder
    (a mount every executor sees), opened by the task that packs them: no body is ever shuffled.
    Without it bodies are joined to their part on the whole key, so every join key is one row, and meet
    by (owner, folder, part), whose bytes are bounded.

    Junk path components (``exclude``) are left out. An object without a key, a key twice in one bundle,
    a file without its body or with a part of it only, and a link without its target raise
    :class:`BundleError` or fail the job: nothing is left out silently.
    """
    keyless = objects.where(F.col(key_col).isNull())  # must not vanish in the filter
    df = exclude_paths(objects, key_col, exclude, "component").unionByName(keyless) if exclude else objects
    fold = basename(F.col(path_col)) if path_col is not None else col_or_lit(
        folder if folder is not None else "materials")
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    have = set(df.columns)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(False)
    mtime = F.coalesce(F.unix_seconds(F.col("modified").cast("timestamp")), F.lit(0)) if "modified" in have else F.lit(0)
    length = length_col or ("length" if "length" in have else None)
    size = F.col(length) if length else F.octet_length(content_col)
    plain = ~flag("is_link") & ~flag("is_dir")
    target = F.when(flag("is_link"), F.coalesce(F.col("link_target"), F.lit("")) if "link_target" in have else F.lit(""))
    member = [owner.alias("owner"), fold.alias("_folder"), F.col(key_col).alias("key"),
              archive_name(fold, slug(owner)).alias("_name"), mtime.cast("bigint").alias("_mtime"),
              (F.coalesce(F.col("mode"), F.lit(0o644)) if "mode" in have else F.lit(0o644)).cast("int").alias("_mode"),
              target.alias("_target"), flag("is_dir").alias("_dir"), F.when(plain, size.cast("bigint")).alias("_len")]
    at = ["owner", "_folder", "key"]
    by_path = source_root is not None
    narrow = df.select(*member).withColumn("_size", F.coalesce("_len", F.lit(0)))
    plan = materialise(bundle_plan(narrow if by_path else narrow.select(*at, "_target", "_size"), "owner", "key", "_size",
                                   max_part_bytes, folder_col="_folder", partitions=partitions), "bundle_plan")
    bad = plan.where(F.col("key").isNull() | (F.col("_target") == "")).select("owner", "key").limit(5).collect()
    if bad:
        raise BundleError("objects without a key or links without a target: "
                          + ", ".join(f"{r.owner}: {r.key}" for r in bad))
    twice = plan.groupBy(*at).count().where("count > 1").limit(5).collect()
    if twice:
        raise BundleError("keys twice in one bundle: " + ", ".join(f"{r.owner}/{r._folder}: {r.key}" for r in twice))
    rows = plan if by_path else df.select(*member, whole_body(df, content_col).alias("content")).join(
        plan.select(*at, "part"), at)
    width = [partitions] if partitions else []
    sorted_rows = rows.repartition(*width, "owner", "_folder", "part").sortWithinPartitions("owner", "_folder", "part", "key")
    return sorted_rows, local_path(source_root) if by_path else None


def compact_objects(objects: DataFrame, target: str, *, key_col: str = "key", content_col: str = "content",
                    length_col: str = "length", target_bytes: int = 128 * 1024 * 1024, codec: str = "zstd") -> DataFrame:
    """The analytics form of bundling: many small objects in few Parquet files of about ``target_bytes``
    of bodies each, in key order, compressed with ``codec`` (``zstd``, ``gzip``, ``snappy``, ``none`` …).

    Which file an object goes to is planned from the running sum of the lengths over the keys, and rows
    are sent to the planned partition by its number, so no file is larger than planned by more than one
    object, whatever the keys. Writes to ``target``, which must not exist, and returns it read back, with
    all columns of ``objects``. Keys must be there and differ; a body that could not be read fails the job.
    """
    spark = objects.sparkSession
    clash = {c.lower() for c in objects.columns} & {"_part", "_size"}
    if clash:
        raise ValueError(f"columns clash with the plan's: {sorted(clash)}")
    body = whole_body(objects, content_col)
    sizes = objects.select(key_col, F.coalesce(F.col(length_col).cast("bigint"), F.lit(0)).alias("_size"))
    plan = materialise(running_sum(sizes, [], [key_col], "_size", "_cum").select(
        key_col, F.expr(f"(_cum - _size) div {int(target_bytes)}").cast("int").alias("_part")), "compaction_plan")
    n, twice, files = plan.agg(F.count(F.lit(1)), F.count(F.lit(1)) - F.count_distinct(key_col), F.max("_part")).first()
    if twice:
        raise BundleError(f"{twice} of {n} objects have no key of their own")
    rows = objects.withColumn(content_col, body).join(plan, key_col)
    dealt = rows.repartitionById((files or 0) + 1, F.col("_part")).sortWithinPartitions("_part", key_col)
    dealt.select(*objects.columns).write.option("compression", codec).parquet(target)
    return spark.read.schema(objects.schema).parquet(target)


def _unpacker(source_col, by_path, names, strip_root, batch_rows=1024, batch_bytes=32 * 1024 * 1024):
    def unpack(batches):
        import gzip
        import io
        import posixpath
        import tarfile

        import pandas as pd

        columns = ["owner", "folder", "part", "path", "content", "length", "kind", "mode", "link_target", "_error"]
        rows, held = [], 0

        def inside(path):
            norm = posixpath.normpath(path) if path else ""
            return bool(path) and not path.startswith("/") and norm == path and norm.split("/")[0] != ".."

        for pdf in batches:
            for owner, folder, part, source in zip(*[pdf[c].tolist() for c in ("owner", "folder", "part", source_col)]):
                at = (owner, folder, part)
                if source is None:
                    rows.append((*at, None, None, None, None, None, None, "missing archive"))
                    continue
                try:
                    opened = {"name": source} if by_path else {"fileobj": io.BytesIO(bytes(source))}
                    with tarfile.open(mode="r:*", **opened) as tar:
                        files = {}
                        for m in tar:
                            # a hard link stands for the file in front of it that it names
                            at_name = posixpath.normpath(m.name)
                            file = m if m.isreg() else files.get(posixpath.normpath(m.linkname)) if m.islnk() else None
                            if file is not None:
                                files[at_name] = file
                            else:
                                files.pop(at_name, None)
                            if any(n in m.name for n in names):
                                continue
                            if file is None and not (m.issym() or m.isdir()):
                                error = "hard link without a file" if m.islnk() else "member type is not restored"
                                rows.append((*at, m.name, None, None, None, None, None, error))
                                continue
                            path = m.name.rstrip("/")
                            if strip_root:
                                path = path.split("/", 1)[1] if "/" in path else ""
                                if not path and m.isdir():
                                    continue
                            to = m.linkname if m.issym() else None
                            # a link may point anywhere below the root of its bundle, nowhere else
                            safe = inside(path) and (to is None or not to.startswith("/") and inside(
                                posixpath.normpath(posixpath.join(posixpath.dirname(path), to))))
                            if not safe:
                                rows.append((*at, m.name, None, None, None, None, None, "unsafe member path"))
                                continue
                            body = tar.extractfile(file).read() if file is not None else None
                            kind = "file" if file is not None else "link" if to is not None else "folder"
                            rows.append((*at, path, body, len(body or b""), kind, m.mode, to, None))
                            held += len(body or b"")
                            if len(rows) >= batch_rows or held >= batch_bytes:
                                yield pd.DataFrame(rows, columns=columns)
                                rows, held = [], 0
                except (tarfile.TarError, OSError, EOFError, gzip.BadGzipFile) as e:
                    rows.append((*at, None, None, None, None, None, None, f"corrupt archive: {e}"))
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return unpack


def unpack_archives(bundles: DataFrame, *, archive_col: str = "archive", path_col: str | None = None,
                    exclude: Sequence[str] = (".ipynb_checkpoints",), strip_root: bool = True) -> DataFrame:
    """One row per member of every archive: ``(owner, folder, part, path, content, length, kind, mode,
    link_target, _error)``; ``kind`` is ``file``, ``link`` or ``folder``.

    The archive is the column ``archive_col``, or the file that ``path_col`` names, opened by the task
    that unpacks it. The archive's root directory is stripped; members whose name contains an excluded
    text are left out (the restore rule keeps ``__pycache__``). Hard links are files with the body of the
    file they name. Absolute or ``..`` paths, links out of the bundle, hard links without a file, members
    of other types (devices, pipes) and corrupt archives come back as rows with ``_error`` set, never as
    files. Archive by archive, no shuffle.
    """
    source = path_col or archive_col
    df = bundles
    for c, t in (("owner", "string"), ("folder", "string"), ("part", "bigint")):
        df = df.withColumn(c, F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t))
    df = df.select("owner", "folder", "part", F.col(source))
    return df.mapInPandas(_unpacker(source, path_col is not None, tuple(exclude), strip_root), MEMBERS)
