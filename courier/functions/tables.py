"""Table functions for SQL: archives opened in a query.

``register(spark)`` adds to the session

* ``unpack_archive(archive)`` – the members of one archive, for ``LATERAL``:
  ``SELECT b.owner, m.path FROM bundles b, LATERAL unpack_archive(b.archive) m``
* ``unpack_archives(TABLE(bundles) PARTITION BY owner ORDER BY part)`` – the members of every archive of a
  partition's rows, which need columns ``owner``, ``folder``, ``part`` and ``archive``. Partition by what
  spreads: without ``PARTITION BY`` Spark brings the whole table to one task.

Members are those of :func:`courier.operators.unpack_archives`: the same paths, kinds and error rows.
"""

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult
from pyspark.sql import types as T

MEMBER = T.StructType([T.StructField(n, t) for n, t in [
    ("path", T.StringType()), ("content", T.BinaryType()), ("length", T.LongType()), ("kind", T.StringType()),
    ("mode", T.IntegerType()), ("link_target", T.StringType()), ("error", T.StringType())]])
ARCHIVE = [T.StructField("owner", T.StringType()), T.StructField("folder", T.StringType()), T.StructField("part", T.LongType())]
EXCLUDE = (".ipynb_checkpoints",)


def members(owner, folder, part, archive, exclude=EXCLUDE):
    """Rows (path, content, length, kind, mode, link_target, error) of one archive."""
    import pandas as pd

    from courier.operators.bundle import _unpacker

    row = pd.DataFrame({"owner": [owner], "folder": [folder], "part": [part], "archive": [archive]}, dtype=object)
    for pdf in _unpacker("archive", False, exclude, True)([row]):
        for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
            yield (r.path, None if r.content is None else bytes(r.content), None if r.length is None else int(r.length), r.kind,
                   None if r.mode is None else int(r.mode), r.link_target, r[-1])


@udtf(returnType=MEMBER)
class UnpackArchive:
    def eval(self, archive: bytes):
        yield from members(None, None, None, archive)


class UnpackArchives:
    @staticmethod
    def analyze(bundles: AnalyzeArgument) -> AnalyzeResult:
        if not bundles.isTable:
            raise ValueError("unpack_archives takes a table: unpack_archives(TABLE(...) PARTITION BY owner)")
        missing = {"owner", "folder", "part", "archive"} - {f.name for f in bundles.dataType.fields}
        if missing:
            raise ValueError(f"unpack_archives: the table has no column {', '.join(sorted(missing))}")
        return AnalyzeResult(T.StructType([*ARCHIVE, *MEMBER.fields]))

    def eval(self, row):
        for m in members(row["owner"], row["folder"], row["part"], row["archive"]):
            yield (row["owner"], row["folder"], row["part"], *m)


def register(spark: SparkSession) -> None:
    from ..session import ship_package

    ship_package(spark)
    spark.udtf.register("unpack_archive", UnpackArchive)
    spark.udtf.register("unpack_archives", udtf(UnpackArchives))
