"""4 x 4 affines (16 numbers, row by row) as column expressions.

The matrices are constants of the plan: a few numbers computed on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Affine = Sequence[float]
AXES = ("x", "y", "z")
INDEX = ("i", "j", "k")
IDENTITY: Affine = tuple(np.eye(4).ravel().tolist())


def diagonal(sizes: Sequence[float], origin: Sequence[float]) -> Affine:
    """Voxel-to-world affine of an upright grid."""
    a = np.diag([*map(float, sizes), 1.0])
    a[:3, 3] = origin
    return tuple(a.ravel().tolist())


def inverse(affine: Affine) -> Affine:
    a = np.asarray(affine, float).reshape(4, 4)
    if abs(np.linalg.det(a)) < 1e-12:
        raise ValueError("the affine is singular")
    return tuple(np.linalg.inv(a).ravel().tolist())


def product(left: Affine, right: Affine) -> Affine:
    return tuple((np.asarray(left, float).reshape(4, 4) @ np.asarray(right, float).reshape(4, 4)).ravel().tolist())


def transformed(affine: Affine, columns: Sequence[Column]) -> list[Column]:
    """R p + t.  Terms with a factor of 0 and factors of 1 are left out of the plan."""
    out = []
    for r in range(3):
        row = affine[4 * r : 4 * r + 4]
        terms = [c.cast("double") if f == 1 else c.cast("double") * F.lit(float(f)) for f, c in zip(row[:3], columns, strict=True) if f != 0]
        if row[3] != 0 or not terms:
            terms.append(F.lit(float(row[3])))
        out.append(reduce(lambda a, b: a + b, terms))
    return out


def nearest(affine: Affine, columns: Sequence[Column]) -> list[Column]:
    """Voxel indices (int) of world positions: inverse affine, rounded half to even."""
    return [F.rint(c).cast("int") for c in transformed(inverse(affine), columns)]


def inside(dims: Sequence[int], columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [(c >= 0) & (c < n) for c, n in zip(columns, dims, strict=True)])
