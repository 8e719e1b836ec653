"""Byte-bounded text heads: the first N bytes of a text or a body, decoded with errors ignored."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _is_lead(b: Column, pos: int) -> Column:
    """True when byte ``pos`` (1-based) of ``b`` starts a UTF-8 character (not 10xxxxxx)."""
    return ~F.substring(F.hex(F.substring(b, pos, 1)), 1, 1).isin("8", "9", "A", "B")


def utf8_head(text, size: int) -> Column:
    """Longest prefix of a (valid UTF-8) text whose encoding fits in ``size`` bytes.

    Equal to ``text.encode()[:size].decode(errors="ignore")``. Only the first ``size`` characters
    are encoded, so a long text costs no more than a short one.
    """
    t = F.col(text) if isinstance(text, str) else text
    b = F.encode(F.substring(t, 1, size), "UTF-8")
    n = F.octet_length(b)
    cut = (F.when(n <= size, n)
           .when(_is_lead(b, size + 1), F.lit(size))
           .when(_is_lead(b, size), F.lit(size - 1))
           .when(_is_lead(b, size - 1), F.lit(size - 2))
           .otherwise(F.lit(size - 3)))
    return F.decode(F.substring(b, F.lit(1), cut), "UTF-8")


def binary_head(content, size: int) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.substring(c, 1, size)


def decode_ignore(b: Column) -> Column:
    """UTF-8 decode that drops invalid sequences, like ``bytes.decode(errors="ignore")``.

    Valid input is cast directly; invalid input is repaired with ``make_valid_utf8`` and the
    replacement characters it inserted are removed. A genuine U+FFFD in an otherwise invalid body is
    rare; only those rows are handed to a vectorized Python fallback (Spark evaluates a Python UDF
    for every row even inside a CASE branch, so every other row reaches it as NULL).
    """
    s = b.cast("string")
    valid = F.is_valid_utf8(s)
    repaired = F.regexp_replace(F.make_valid_utf8(s), "\ufffd", "")
    ambiguous = ~valid & (F.instr(s, "\ufffd") > 0)
    return (F.when(valid, s)
            .when(~ambiguous, repaired)
            .otherwise(_decode_ignore_udf(F.when(ambiguous, b))))


def _decode_ignore_udf(b: Column) -> Column:
    import pandas as pd

    @F.pandas_udf("string")
    def dec(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else bytes(x).decode("utf-8", errors="ignore"))

    return dec(b)
