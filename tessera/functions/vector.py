"""Vector arithmetic as JVM-side column expressions (no Python in the loop)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double_vec(v) -> Column:
    """``array<float>`` -> ``array<double>`` so sums are done in double precision."""
    return F.transform(_c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(as_double_vec(a), as_double_vec(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(as_double_vec(a), lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))


def dist_cosine(a, b) -> Column:
    """Cosine distance ``1 - a.b / (|a| |b|)``, clamped at 0 (the service's 0..2 range); 1 if a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0) - dot(a, b) / F.nullif(n, F.lit(0.0)), F.lit(0.0)))


def dist_euclidean(a, b) -> Column:
    return F.sqrt(
        F.aggregate(
            F.zip_with(as_double_vec(a), as_double_vec(b), lambda x, y: (x - y) * (x - y)),
            F.lit(0.0),
            lambda acc, x: acc + x,
        )
    )


def distance(a, b, metric: str) -> Column:
    return dist_cosine(a, b) if metric == "cosine" else dist_euclidean(a, b)


def l2_normalize(a) -> Column:
    """Unit-length copy of a vector (as float), so cosine becomes a dot product."""
    n = norm(a)
    return F.transform(as_double_vec(a), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)).cast("float"))


def similarity_score(dist) -> Column:
    """score = 1 - distance/2: cosine distance 0..2 mapped to similarity 1..0."""
    return F.lit(1.0) - _c(dist) / F.lit(2.0)
