"""Restoring: find every owner's current bundle and unpack it, then write the files."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bundle import unpack_archives
from ..operators.ledger import fetch_user_archive, missing_archives
from ..session import local_path, materialise, ship_package
from ..sources.objects import clear_stage
from ..sources.tree import STAGING


def restore(bundles: DataFrame, owners: DataFrame, *, prefix: str | None = None, match: str = "owner",
            owner_col: str = "owner", exclude=(".ipynb_checkpoints",)) -> tuple[DataFrame, DataFrame]:
    """``bundles``: ``(owner, key, part, archive)`` rows. Returns the restored members ``(owner, path,
    content, length, …, _error)`` of every owner's bundle, and the owners that have none.

    A bundle goes to an owner only if it is found under that owner's key; with ``match="owner"`` it
    must be the owner's own row too, so that owners whose slugs agree never get each other's files.
    Write the members with :func:`write_restored`.
    """
    found = fetch_user_archive(bundles.select(owner_col, "key"), owners, prefix=prefix, match=match,
                               owner_col=owner_col)
    wanted = found.select(F.col("key").alias("_k"), F.col(owner_col).alias("_req"))
    same = F.col("key") == F.col("_k")
    if match == "owner":
        same = same & (F.col(owner_col) == F.col("_req"))
    chosen = bundles.join(wanted, same, "inner")
    folder = [F.col("folder")] if "folder" in bundles.columns else []
    members = unpack_archives(chosen.select(F.col("_req").alias("owner"), *folder, "part", "archive"), exclude=exclude)
    return members, missing_archives(owners, found, owner_col)


class RestoreError(RuntimeError):
    """Some members could not be restored (corrupt archive, unsafe path, two members of one name)."""


_DONE = "owner string, part bigint, files bigint, bytes bigint, errors array<string>"


def _write_members(stage: str, per_owner: bool):
    def run(batches):
        import os

        import pandas as pd

        from courier.sources.objects import put, safe_key

        rows = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                part = None if r.part != r.part else r.part
                at = rows.setdefault((r.owner, part), [0, 0, []])
                key = f"{r.owner}/{r.path}" if per_owner else r.path
                if r.error_text is not None:
                    at[2] = [*at[2], f"{r.error_text} ({r.path})"][:5]
                    continue
                if not safe_key(key):
                    at[2] = [*at[2], f"unsafe member path ({key})"][:5]
                    continue
                dest = os.path.join(stage, "files", key)
                if os.path.lexists(dest) and not os.path.isdir(dest) and _differs(dest, r):
                    at[2] = [*at[2], f"two members of one name ({key})"][:5]
                    continue
                at[1] += put(os.path.join(stage, "files"), os.path.join(stage, "tmp"), key,
                             body=bytes(r.content) if r.kind == "file" else None, folder=r.kind == "folder",
                             mode=None if r.mode != r.mode else r.mode, link_target=r.link_target if r.kind == "link" else None)
                at[0] += r.kind == "file"
        yield pd.DataFrame([(o, p, n, b, e) for (o, p), (n, b, e) in rows.items()],
                           columns=["owner", "part", "files", "bytes", "errors"])

    return run


def _differs(dest: str, r) -> bool:
    """A repeated task meets its own files; anything else under that name is another member."""
    import os

    if r.kind == "link":
        return not os.path.islink(dest) or os.readlink(dest) != r.link_target
    if os.path.islink(dest) or os.path.getsize(dest) != len(r.content):
        return True
    with open(dest, "rb") as f:
        return f.read() != bytes(r.content)


def write_restored(members: DataFrame, target: str, *, per_owner: bool = True) -> DataFrame:
    """Write restored members under ``target`` (``<owner>/<path>`` with ``per_owner``), which they
    replace; returns ``(owner, files, bytes)``.

    The archives are unpacked once: the members go into a new folder beside the files, and rows with
    ``_error`` raise :class:`RestoreError` before anything that is there has changed. Then the new
    folder of each restored owner (or the whole target) takes the place of the old one, so files
    deleted since the backup are gone, and a failed restore never loses what was there.
    """
    import os

    spark = members.sparkSession
    ship_package(spark)
    root = local_path(target).rstrip("/")
    stage = f"{root}/{STAGING}/{time.time_ns()}"
    try:
        rows = members.select("owner", "part", "path", "content", "kind", "mode", "link_target", F.col("_error").alias("error_text"))
        done = materialise(rows.mapInPandas(_write_members(stage, per_owner), _DONE), "restored")
        bad = done.where(F.size("errors") > 0).select("owner", F.col("errors")[0].alias("e")).limit(5).collect()
        if bad:
            raise RestoreError("; ".join(f"{r.owner}: {r.e}" for r in bad))
        new = f"{stage}/files"
        os.makedirs(new, exist_ok=True)
        if per_owner:
            swaps = done.select("owner").distinct().where(F.col("owner").isNotNull())
            swaps.mapInPandas(_swap_owners(root, stage), "n bigint").agg(F.sum("n")).first()
        else:
            _swap(root, new, f"{stage}/old", skip=STAGING)
    finally:
        clear_stage(stage)
    return done.groupBy("owner").agg(F.sum("files").alias("files"), F.sum("bytes").cast("bigint").alias("bytes"))


def _swap_owners(root: str, stage: str):
    def run(batches):
        import os

        import pandas as pd

        for pdf in batches:
            for owner in pdf["owner"]:
                new, old, now = f"{stage}/files/{owner}", f"{stage}/old/{owner}", f"{root}/{owner}"
                if not os.path.lexists(new):  # a repeated task: already swapped
                    continue
                os.makedirs(os.path.dirname(old), exist_ok=True)
                if os.path.lexists(now) and not os.path.lexists(old):
                    os.rename(now, old)
                os.rename(new, now)
            yield pd.DataFrame({"n": [len(pdf)]})

    return run


def _swap(root: str, new: str, old: str, skip: str) -> None:
    """Move the entries of ``root`` aside, then those of ``new`` in."""
    import os

    os.makedirs(old, exist_ok=True)
    for name in os.listdir(root):
        if name != skip:
            os.rename(os.path.join(root, name), os.path.join(old, name))
    for name in os.listdir(new):
        os.rename(os.path.join(new, name), os.path.join(root, name))
