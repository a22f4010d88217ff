"""Vector functions on arrays, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the dot product, for vectors of unit length."""
    return F.lit(1.0) - dot(a, b)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def distance_to(column: Column, vector: Sequence[float]) -> Column:
    """Cosine distance to one query vector by an Arrow function: one matrix product for each batch."""
    q = np.asarray(vector, np.float64)

    @F.arrow_udf("double")
    def distances(v: pa.Array) -> pa.Array:
        if not v.null_count and len(v) and (v.value_lengths().to_numpy() == len(q)).all():
            rows = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), len(q))
            return pa.array(1.0 - rows.astype(np.float64) @ q)
        return pa.array([None if x is None or len(x) != len(q) else float(1.0 - np.asarray(x, np.float64) @ q) for x in v.to_pylist()], pa.float64())

    return distances(column)
