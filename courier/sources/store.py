"""Small steps on any Hadoop file system, with every result checked: a step that did not happen raises.

Only metadata passes here (pointers, folder names); data is written and read by Spark jobs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class StoreError(OSError):
    """The file system did not do what was asked."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, path = _fs(spark, folder), _path(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def folder_bytes(spark: SparkSession, folder: str) -> int:
    return int(_fs(spark, folder).getContentSummary(_path(spark, folder)).getLength())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; none there is fine, one that stays raises."""
    fs, p = _fs(spark, path), _path(spark, path)
    if not fs.delete(p, True) and fs.exists(p):
        raise StoreError(f"{path}: could not be deleted")


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Rename; raises if the file system says no, or if the target is there already."""
    fs = _fs(spark, source)
    if fs.exists(_path(spark, target)):
        raise StoreError(f"{target}: exists")
    if not fs.rename(_path(spark, source), _path(spark, target)):
        raise StoreError(f"{source}: could not be renamed to {target}")


def read_text(spark: SparkSession, path: str) -> str:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file at ``path`` whole or not at all; ``False`` if there is one already.

    The text is written under a name of its own and renamed without overwriting, which HDFS and local
    file systems decide atomically. On an object store use one whose rename does not overwrite.
    """
    jvm = spark._jvm
    folder, _, name = path.rpartition("/")
    made = f"{folder}/.{name}.{uuid.uuid4().hex}"
    fs = _fs(spark, folder)
    fs.mkdirs(_path(spark, folder))
    out = fs.create(_path(spark, made), False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    from py4j.protocol import Py4JJavaError

    try:
        context.rename(fs.makeQualified(_path(spark, made)), fs.makeQualified(_path(spark, path)), options)
        return True
    except Py4JJavaError as e:
        if not fs.exists(_path(spark, path)):
            raise StoreError(f"{path}: {e.java_exception.getMessage()}") from None
        return False
    finally:
        fs.delete(_path(spark, made), False)


def folders(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    """Folders in a folder, with the time (seconds) they were last written."""
    fs, path = _fs(spark, folder), _path(spark, folder)
    if not fs.exists(path):
        return []
    return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(path) if s.isDirectory()]
