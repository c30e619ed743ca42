"""Vector and hashing column functions (V1, V8, fixture vectors, seeded
uniforms). Vectors are ``ARRAY<DOUBLE>`` columns; MLlib ``VectorUDT`` is
used only inside ML stages and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12
TWO_32 = 4294967296.0


def hash32(seed, key: Column) -> Column:
    """First 32 bits of ``md5(seed || '-' || key)`` as BIGINT in [0, 2^32).
    The same string hashes identically in DuckDB, so seeded choices can be
    repeated in SQL."""
    s = F.concat(F.lit(str(seed)), F.lit("-"), key.cast("string"))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def uniform01(seed, key: Column) -> Column:
    """Seeded uniform in [0, 1) keyed by ``key``."""
    return hash32(seed, key) / F.lit(TWO_32)


def hash_vector(term: Column, dim: int) -> Column:
    """Deterministic word vector: component i = md5(term-i) scaled to
    [-0.5, 0.5). Used where vectors must be repeatable in SQL."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.conv(F.substring(F.md5(F.concat(term, F.lit("-"), i.cast("string"))), 1, 8),
                         16, 10).cast("bigint") / F.lit(TWO_32) - F.lit(0.5))


def mean_by_place(df: DataFrame, keys, dim: int, vec: str = "vector", out: str = "vector") -> DataFrame:
    """Per-group mean of vectors of ``dim`` numbers and ``_rows``, the group's
    rows with a vector. Every place is a plain average, which Spark adds up in
    a hash map of fixed-size rows: nothing is sorted, however many groups."""
    places = [F.avg(F.get(F.col(vec), F.lit(i))).alias(f"_x{i}") for i in range(dim)]
    sums = df.where(F.col(vec).isNotNull()).groupBy(*keys).agg(
        *places, F.count(F.lit(1)).alias("_rows"), F.min(F.size(vec)).alias("_least"), F.max(F.size(vec)).alias("_most"))
    whole = F.array(*[F.col(f"_x{i}") for i in range(dim)])
    same = (F.col("_least") == dim) & (F.col("_most") == dim)
    return sums.select(*keys, F.when(same, whole).otherwise(F.raise_error(F.lit(f"a vector has not {dim} numbers")).cast(
        "array<double>")).alias(out), "_rows")


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def normalize(v: Column) -> Column:
    """V1: L2-normalise; a zero vector stays zero (divisor floored at 1e-12)."""
    n = F.greatest(norm(v), F.lit(EPS))
    return F.transform(v, lambda x: x / n)


def cosine(u: Column, v: Column) -> Column:
    """V8: dot(u, v) / (|u| |v|); NULL when either vector is zero."""
    return F.try_divide(dot(u, v), norm(u) * norm(v))
