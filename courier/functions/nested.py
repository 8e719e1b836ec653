"""Lookups in nested documents by dotted path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_path(dotted: str) -> str:
    """``a.b`` → ``$['a']['b']``: split on every dot, names kept literal."""
    parts = dotted.split(".")
    return "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in parts)


def lookup(doc, dotted: str, type_: str = "variant", *, strict: bool = False) -> Column:
    d = F.col(doc) if isinstance(doc, str) else doc
    v = F.try_parse_json(d)
    path = json_path(dotted)
    value = F.try_variant_get(v, path, type_)
    if not strict:
        return value
    # the error names the path only: a document may hold secrets
    present = F.try_variant_get(v, path, "variant").isNotNull()
    missing = F.raise_error(F.lit(f"missing key {dotted!r} in the document"))
    wrong = F.raise_error(F.lit(f"the value at {dotted!r} is no {type_}"))
    null = F.coalesce(F.is_variant_null(F.try_variant_get(v, path, "variant")), F.lit(False))
    return F.when(~present, missing).when(value.isNull() & ~null, wrong).otherwise(value)
