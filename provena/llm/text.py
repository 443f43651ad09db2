"""Shared helpers of the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds (null: the empty text's)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def unit_hash(*keys: Column, seed: int = 0) -> Column:
    """A hashed place in [0, 1), for samples that reruns repeat."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


def chunks(batch: pa.RecordBatch, column: str, chars: int = 1 << 18, most: int = 1 << 12) -> Iterator[tuple[int, list[str | None]]]:
    """Rows of a batch in runs of about ``chars`` characters and at most ``most`` rows; a longer text is a run of its own."""
    values = batch.column(batch.schema.get_field_index(column))
    start, run, size = 0, [], 0
    for i in range(len(values)):
        text = values[i].as_py()
        n = len(text) if text else 0
        if run and (size + n > chars or len(run) >= most):
            yield start, run
            start, run, size = i, [], 0
        run.append(text)
        size += n
    if run:
        yield start, run


_held: dict[str, Callable[[], None]] = {}


def only_caches_of(operator: str, clear: Callable[[], None]) -> None:
    """Called by an operator's function in a worker, before its rows: workers are used again, and caches of other operators go.

    So a worker holds the caches of one operator at a time, however many a session runs.
    """
    others = [name for name in _held if name != operator]
    for name in others:
        _held.pop(name)()
    _held[operator] = clear
    if others:
        pa.default_memory_pool().release_unused()
        try:  # glibc gives freed memory back only when asked
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            return


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names for helper columns that no column in ``taken`` has (names are compared without case)."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by name, whatever signs the names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def column_ddl(field: StructField) -> str:
    return "`" + field.name.replace("`", "``") + "` " + field.dataType.simpleString()


def with_text(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, str]:
    """The kept columns and the text for a scoring pass, and the text's name there; the text is sent once."""
    if "text" in keep:
        return docs.select(*quoted(keep)), "text"
    (name,) = free_names(keep, "scored_text")
    return docs.select(*quoted(keep), F.col("text").alias(name)), name
