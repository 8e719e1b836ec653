"""Helpers the training-data operators share."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialise as stored  # noqa: F401

#: Bytes of text handed to one call of a batch function: bounds a Python worker's memory.
SLICE_BYTES = 2 * 1024 * 1024

#: The white space between words: space, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` and ``bytes.strip()`` without arguments use exactly these.
BLANKS = b" \t\n\x0b\x0c\r"


def spare_name(taken, name: str) -> str:
    """``name``, lengthened until no column of ``taken`` has it (compared as Spark does, without case)."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = "_" + name
    return name


def _slices(column):
    """(start, end) of consecutive rows with about ``SLICE_BYTES`` of text, one row at least."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
        if i > start and size + n > SLICE_BYTES:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(column):
        yield start, len(column)


def map_text(df: DataFrame, keep: list[str], text_col: str, fields: str, fn) -> DataFrame:
    """``keep`` columns plus the columns ``fields`` (DDL) that ``fn`` computes from the whole texts.

    ``fn`` takes a list of UTF-8 ``bytes`` (``None`` for null) and returns one list or array per
    field. Text crosses to Python once, in Arrow batches; each call sees a slice of bounded bytes,
    or one text if that alone is longer.
    """
    new = T._parse_datatype_string(fields)
    text = text_col if text_col in keep else spare_name([*keep, *new.names], "text_in")
    clash = {c.lower() for c in keep} & {c.lower() for c in new.names}
    if clash:
        raise ValueError(f"kept columns clash with results: {sorted(clash)}")
    src = df.select(*[F.col(f"`{c}`") for c in keep],
                    *([] if text in keep else [F.col(f"`{text_col}`").cast("string").alias(text)]))
    schema = T.StructType([*[src.schema[c] for c in keep], *new.fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for lo, hi in _slices(column):
                # only the slice is copied, not the batch
                out = fn(column.slice(lo, hi - lo).cast(pa.large_binary()).to_pylist())
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(kept, arrow)]
                arrays += [pa.array(v, type=arrow.field(len(keep) + i).type) for i, v in enumerate(out)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
            pa.default_memory_pool().release_unused()

    return src.mapInArrow(run, schema)


def code_points(b: bytes) -> int:
    """Characters of a UTF-8 text."""
    return len(b) if b.isascii() else len(b.decode("utf-8", "replace"))


def chunks_of_words(b: bytes, size: int = 1 << 22):
    """The words of ``b`` as lists; texts over ``size`` bytes in several lists, cut at white space."""
    if len(b) <= size:
        yield b.split()
        return
    start = 0
    while start < len(b):
        end = start + size
        while end < len(b) and b[end] not in BLANKS:
            end += 1
        yield b[start:end].split()
        start = end

