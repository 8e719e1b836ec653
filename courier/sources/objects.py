"""``courier_objects``: write one object (file) per row, under ``<path>/<key>``, all of a job or none.

A Python Data Source writer in two phases. Tasks *stage*: each writes its objects under a hidden folder
of the target and a journal that says which staged file belongs under which key. When all tasks are
done, ``commit`` first stores which journals count (those of the attempts that Spark accepted; repeated
and speculative tasks leave others) and then renames what they list into place, journals side by side.
Until then the target is untouched, so a job that fails or is aborted leaves every old object as it was.
A commit that dies half-way is finished by :func:`recover_objects`: renames are repeated safely.

Every single object appears whole or not at all, and a later write of a key replaces it (the per-object
semantics of an object store). Only counts and journal names travel back to the driver. Keys must be
relative and must not climb out of the target. Optional columns: ``mode``, ``kind`` (``file``, ``link``,
``folder``) and ``link_target``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage

from .tree import STAGING


@dataclass
class _Written(WriterCommitMessage):
    objects: int
    bytes: int
    journal: str


#: Name of the file that lists the journals of a commit, in its staging folder.
COMMIT = "COMMIT"
#: Journals that are put in place at once.
RENAMERS = 16


def safe_key(key: str) -> bool:
    import posixpath

    if not key or key.startswith("/") or "\x00" in key:
        return False
    norm = posixpath.normpath(key)
    return norm == key and norm.split("/")[0] not in ("..", STAGING)


class ObjectsDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "courier_objects"

    def schema(self) -> str:
        return "key string, content binary, src string"

    def writer(self, schema, overwrite: bool):
        return ArrowObjectsWriter(dict(self.options))


def put(root: str, stage: str, key: str, *, body=None, source=None, mode=None, link_target=None, folder=False) -> int:
    """Write one object under ``root``: staged under ``stage``, then renamed into place."""
    import os
    import uuid

    dest = os.path.join(root, key)
    os.makedirs(os.path.dirname(dest), exist_ok=True)
    if folder:
        os.makedirs(dest, exist_ok=True)
        return 0
    tmp = os.path.join(stage, uuid.uuid4().hex)
    size = stage_object(tmp, body=body, source=source, mode=mode, link_target=link_target)
    os.replace(tmp, dest)
    return size


def stage_object(tmp: str, *, body=None, source=None, mode=None, link_target=None) -> int:
    """Write one object to ``tmp``; its bytes."""
    import os
    import shutil

    os.makedirs(os.path.dirname(tmp), exist_ok=True)
    if link_target is not None:
        os.symlink(link_target, tmp)
        size = 0
    elif source is not None:
        shutil.copyfile(source, tmp)  # streamed, any size
        size = os.path.getsize(tmp)
    else:
        with open(tmp, "wb") as f:
            f.write(body)
        size = len(body)
    if mode is not None and link_target is None:
        os.chmod(tmp, int(mode))
    return size


def _put_journal(root: str, stage: str, journal: str) -> None:
    """Rename the objects of one journal into place; those that are there already stay."""
    import json
    import os

    with open(os.path.join(stage, "journals", journal), encoding="utf-8") as lines:
        for line in lines:
            name, key = json.loads(line)
            dest, tmp = os.path.join(root, key), os.path.join(stage, "files", journal, name)
            if not name:
                os.makedirs(dest, exist_ok=True)
                continue
            os.makedirs(os.path.dirname(dest), exist_ok=True)
            if os.path.lexists(tmp):
                os.replace(tmp, dest)
            elif not os.path.lexists(dest):
                raise FileNotFoundError(f"{dest}: its staged object is gone")


def _finish(root: str, stage: str) -> None:
    """Put the objects of a commit in place, then delete its staging folder."""
    import json
    import os
    from concurrent.futures import ThreadPoolExecutor

    with open(os.path.join(stage, COMMIT), encoding="utf-8") as f:
        journals = json.load(f)
    with ThreadPoolExecutor(RENAMERS) as pool:
        for done in [pool.submit(_put_journal, root, stage, j) for j in journals]:
            done.result()
    clear_stage(stage)


def recover_objects(target: str) -> int:
    """Finish the commits that died half-way under ``target``; returns how many there were. Staged
    objects without a commit stay: their job may be running."""
    import os

    from ..session import local_path

    root = local_path(target).rstrip("/")
    base = os.path.join(root, STAGING)
    found = [d for d in sorted(os.listdir(base)) if os.path.isfile(os.path.join(base, d, COMMIT))] if os.path.isdir(base) else []
    for d in found:
        _finish(root, os.path.join(base, d))
    return len(found)


def clear_stage(stage: str) -> None:
    """Delete a staging folder, and the one that holds them unless another write is staging."""
    import os
    import shutil

    shutil.rmtree(stage, ignore_errors=True)
    try:
        os.rmdir(os.path.dirname(stage))
    except OSError:
        pass


class ObjectsWriter(DataSourceWriter):
    def __init__(self, options: dict):
        import os
        import uuid

        from ..session import local_path

        self.root = local_path(options["path"]).rstrip("/")
        self.stage = os.path.join(self.root, STAGING, uuid.uuid4().hex)
        self.key_col = options.get("key_col", "key")
        self.content_col = options.get("content_col", "content")
        # copy by path: rows carry ``src`` (relative to ``source_root``) instead of a body
        self.source_root = local_path(options["source_root"]) if options.get("source_root") else None
        self.totals = (0, 0)

    def write(self, iterator):
        import json
        import os
        import uuid

        n, nbytes, journal = 0, 0, uuid.uuid4().hex
        files = os.path.join(self.stage, "files", journal)
        os.makedirs(os.path.join(self.stage, "journals"), exist_ok=True)
        with open(os.path.join(self.stage, "journals", journal), "w", encoding="utf-8") as lines:
            for row in iterator:
                have = row.asDict()
                key, kind = row[self.key_col], have.get("kind") or "file"
                if not safe_key(key):
                    raise ValueError(f"unsafe object key: {key!r}")
                options = {"mode": have.get("mode")}
                if kind == "link":
                    options["link_target"] = row["link_target"]
                elif kind == "file" and self.source_root is not None:
                    if not safe_key(row["src"]):
                        raise ValueError(f"unsafe source path: {row['src']!r}")
                    options["source"] = os.path.join(self.source_root, row["src"])
                elif kind == "file":
                    if row[self.content_col] is None:
                        raise ValueError(f"no body for object {key!r}")
                    options["body"] = bytes(row[self.content_col])
                name = "" if kind == "folder" else str(n)
                if name:
                    nbytes += stage_object(os.path.join(files, name), **options)
                lines.write(json.dumps([name, key]) + "\n")
                n += 1
        return _Written(n, nbytes, journal)

    def commit(self, messages):
        import json
        import os

        done = [m for m in messages if m]
        self.totals = (sum(m.objects for m in done), sum(m.bytes for m in done))
        os.makedirs(self.stage, exist_ok=True)
        path = os.path.join(self.stage, COMMIT)
        with open(f"{path}.new", "w", encoding="utf-8") as f:
            json.dump([m.journal for m in done], f)
        os.replace(f"{path}.new", path)  # from here on the write has happened, whoever finishes it
        _finish(self.root, self.stage)

    def abort(self, messages):
        import os

        if not os.path.exists(os.path.join(self.stage, COMMIT)):
            clear_stage(self.stage)


class ArrowObjectsWriter(ObjectsWriter, DataSourceArrowWriter):
    """The writer as Spark calls it: with Arrow batches, of which one row at a time becomes Python objects.
    A writer of rows would get the bodies of a whole batch as a list first."""

    def write(self, iterator):
        return super().write(_rows(iterator))


def _rows(batches):
    from pyspark.sql import Row

    for batch in batches:
        row = Row(*batch.schema.names)
        for values in zip(*batch.columns):
            yield row(*[v.as_py() for v in values])


def register(spark) -> None:
    from ..session import ship_package

    ship_package(spark)
    spark.dataSource.register(ObjectsDataSource)
