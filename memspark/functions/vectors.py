"""Vector expressions over ``array<double>`` columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark.functions.common import let

HASH_DIM = 32


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def similarity(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def cosine(a: Column, b: Column) -> Column:
    a, b = as_double(a), as_double(b)
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
    return F.when(norm > 0.0, dot / norm).otherwise(F.lit(0.0))


def hash_vector(text: Column) -> Column:
    """Reproducible stand-in for an embedding: the 32 bytes of sha256, centred and normalised."""
    def raw(digest: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.lit(HASH_DIM)),
            lambda i: (F.conv(F.substr(digest, i * 2 - 1, F.lit(2)), 16, 10).cast("double") - 127.5) / 127.5,
        )

    def scaled(v: Column) -> Column:
        return let(
            F.sqrt(_sum(F.transform(v, lambda x: x * x))),
            lambda norm: F.when(norm == 0.0, v).otherwise(F.transform(v, lambda x: F.round(x / norm, 8))),
        )

    return let(F.sha2(text, 256), lambda digest: let(raw(digest), scaled))
