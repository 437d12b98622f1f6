"""Vector expressions over array<float> or array<double>, computed in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factor of the string hash and of the index in mock vectors: fixed values.
HASH_FACTOR = 31


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """In [-1, 1]; null for null, zero or unequally long vectors."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once a row: what stands inside a transform is worked out for each element otherwise."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    scaled = lambda v, n: F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))
    return bound(a, lambda v: bound(norm(v), lambda n: scaled(v, n)))


def fixed_size(a: Column, n: int) -> Column:
    """The vector as array<float> if it has n elements, else null."""
    return F.when(F.size(a) == n, a.cast("array<float>"))


def parse_vector(text: Column) -> Column:
    """'<1, 2>' -> array<float>; null if the text or an element is malformed."""
    body = F.regexp_extract(text, r"^\s*<(.*)>\s*$", 1)
    parts = F.transform(F.split(body, ","), lambda x: F.trim(x).try_cast("float"))
    return F.when(text.rlike(r"^\s*<.+>\s*$") & ~F.exists(parts, lambda x: x.isNull()), parts)


def mock_embedding(text: Column, dim: int) -> Column:
    """A deterministic unit vector of a text: the 32-bit string hash, spread over dim components."""
    h = F.call_function("java_method", F.lit("java.util.Objects"), F.lit("hashCode"), text).cast("long")
    wrap = lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    raw = lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: ((wrap(h * (i + 1)).bitwiseXOR(i.cast("long") * HASH_FACTOR)) % 2000 - 1000) / F.lit(1000.0))
    return l2_normalize(bound(h, raw))
