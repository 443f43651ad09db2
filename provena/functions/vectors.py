"""Vector expressions: norms and the safe cosine, as SQL functions and as numpy blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 2.2250738585072014e-308


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _top(v: Column) -> Column:
    """The largest absolute component."""
    return F.array_max(F.transform(as_doubles(v), F.abs))


def norm(v: Column) -> Column:
    """Euclidean length, by way of the largest component, so that squares neither overflow nor vanish."""

    def length(top: Column) -> Column:
        return F.when(top > 0, top * F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda s, x: s + (x / top) * (x / top)))).otherwise(0.0)

    return _bound(_top(v), length)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def scaled_to_one(v: Column) -> Column:
    """The vector divided by its largest component; a zero vector stays."""
    return _bound(_top(v), lambda top: F.transform(as_doubles(v), lambda x: F.when(top > 0, x / top).otherwise(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 if either vector is zero. Vectors of other lengths, or that hold what is no finite number, are an error."""
    bad = F.exists(F.concat(as_doubles(a), as_doubles(b)), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    x, y = scaled_to_one(a), scaled_to_one(b)
    raw = dot(x, y) / (norm(x) * norm(y))
    value = F.when((_top(a) > 0) & (_top(b) > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))).otherwise(F.lit(0.0))
    wrong = F.raise_error(F.lit("cosine: the vectors differ in length or are not finite")).cast("double")
    return F.when((F.size(a) != F.size(b)) | bad, wrong).otherwise(value)


def normalized(v: Column) -> Column:
    """Unit vector; a zero vector stays."""
    return _bound(F.greatest(norm(v), F.lit(_TINY)), lambda n: F.transform(as_doubles(v), lambda x: x / n))


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 without overflow; zero rows stay zero."""
    top = np.abs(m).max(axis=1, keepdims=True, initial=0.0)
    m = np.divide(m, top, out=np.zeros_like(m), where=top > 0)
    length = np.sqrt(np.square(m).sum(1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def cosine_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows of two blocks of unit (or zero) rows."""
    return np.clip(a @ b.T, -1.0, 1.0)


def bit_signature(v: Column) -> Column:
    """16 hex digits of the bits ``v >= median(v[1:])``, first component as the highest bit (64 components)."""
    d = as_doubles(v)
    low = F.element_at(F.array_sort(F.slice(d, 2, 63)), 32)
    bits = F.array_join(F.transform(d, lambda x: F.when(x >= low, "1").otherwise("0")), "")
    return F.lpad(F.lower(F.conv(bits, 2, 16)), 16, "0")


def hex_to_long(h: Column) -> Column:
    """Two's complement long of 16 hex digits."""
    return F.conv(h, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")
