"""Path and key expressions: last segment, owner slug, extension split, prefixed key, URI."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# os.path.splitext on a base name: leading dots belong to the stem, only the last extension splits.
_SPLIT_EXT = r"^(\.*[^.].*?|\.*)(\.[^.]*)?$"


def col_or_lit(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.lit(x)


def basename(path) -> Column:
    """Last path segment, trailing slashes ignored (``a/b/`` → ``b``, ``/`` → ``''``)."""
    p = col_or_lit(path) if not isinstance(path, str) else F.col(path)
    return F.regexp_extract(F.regexp_replace(p, "/+$", ""), r"([^/]*)$", 1)


def last_segment(path) -> Column:
    """Text after the last ``/`` (``a/b/`` → ``''``), like ``os.path.basename``."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(p, r"([^/]*)$", 1)


def slug(owner) -> Column:
    """Owner as it appears in a key: every ``.`` becomes ``_``."""
    o = F.col(owner) if isinstance(owner, str) else owner
    return F.replace(o, F.lit("."), F.lit("_"))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, _SPLIT_EXT, "$1")


def extension(name: Column) -> Column:
    return F.regexp_extract(name, _SPLIT_EXT, 2)


def join_key(prefix: Column, name: Column) -> Column:
    """``prefix/name``, or just ``name`` when the prefix is empty or NULL."""
    return F.when(F.coalesce(prefix, F.lit("")) == "", name).otherwise(F.concat(prefix, F.lit("/"), name))


def s3_uri(bucket: Column, key: Column) -> Column:
    return F.concat(F.lit("s3://"), bucket, F.lit("/"), key)


def archive_name(folder: Column, owner_slug: Column) -> Column:
    """``<folder>_<slug>.tar.gz``; an empty owner leaves the trailing underscore."""
    return F.concat(folder, F.lit("_"), owner_slug, F.lit(".tar.gz"))


def file_name_for_owner(base: Column, owner_slug: Column) -> Column:
    """``<stem>_<slug><ext>``; with an empty owner the base name is kept as is."""
    return F.when(F.coalesce(owner_slug, F.lit("")) == "", base).otherwise(
        F.concat(stem(base), F.lit("_"), owner_slug, extension(base)))


def path_components(key: Column) -> Column:
    return F.split(key, "/")
