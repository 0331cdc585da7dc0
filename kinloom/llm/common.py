"""What the corpus operators share: column intake, whitespace and case rules."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: The white space of the contracts and the ASCII letters.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Texts are handed to numpy in groups of about this many bytes.
GROUP_BYTES = 1 << 20


def intake(df: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """The wanted columns as ``_w0``, ``_w1`` ... and all others packed in ``_rest``.

    Columns are taken by position, so names that clash with an operator's own
    columns, or with each other in all but case, do no harm.  The second value
    lists the packed names for :func:`outgo`.
    """
    names = df.columns
    at = [names.index(w) for w in wanted]
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    other = [i for i in range(len(names)) if i not in at]
    fields = [F.col(f"_c{i}").alias(f"_r{k}") for k, i in enumerate(other)]
    rest = F.struct(*(fields or [F.lit(None).cast("int").alias("_none")]))
    return flat.select(rest.alias("_rest"), *[F.col(f"_c{i}").alias(f"_w{k}") for k, i in enumerate(at)]), [names[i] for i in other]


def outgo(df: DataFrame, names: list[str], outputs: dict[str, Column]) -> DataFrame:
    """The packed columns again, then the outputs, which replace columns of the same name."""
    taken = {n.lower() for n in outputs}
    kept = [F.col(f"_rest._r{k}").alias(n) for k, n in enumerate(names) if n.lower() not in taken]
    return df.select(*kept, *[c.alias(n) for n, c in outputs.items()])


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")


def text_groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) in groups of about GROUP_BYTES; a null is an empty text."""
    texts = batch.column(column).cast(pa.binary())
    first, group, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.as_py() or b""
        group.append(raw)
        size += len(raw)
        if size >= GROUP_BYTES:
            yield first, group
            first, group, size = i + 1, [], 0
    if group:
        yield first, group


def release_memory() -> None:
    """Hand what numpy has freed back to the system, as a Python worker outlives its task."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
