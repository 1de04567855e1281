"""Semirings for matrix products: what combines two elements, and what folds the results.

Registered semirings are column expressions and Spark aggregates, so they stay in generated code.  Any other pair of
scalar functions goes through ``python_fold``, which is slow: it runs them row by row in Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    inner: Callable[[Column, Column], Column]
    outer: Callable[[Column], Column]


SEMIRINGS = {
    "plus_times": Semiring(lambda x, y: x * y, F.sum),
    "min_plus": Semiring(lambda x, y: x + y, F.min),
    "max_plus": Semiring(lambda x, y: x + y, F.max),
    "max_min": Semiring(lambda x, y: F.least(x, y), F.max),
    "min_max": Semiring(lambda x, y: F.greatest(x, y), F.min),
    "or_and": Semiring(lambda x, y: F.when((x != 0) & (y != 0), 1).otherwise(0), F.max),
}

#: The same on arrays, for products of blocks.
KERNELS = {
    "plus_times": (np.multiply, np.add),
    "min_plus": (np.add, np.minimum),
    "max_plus": (np.add, np.maximum),
    "max_min": (np.minimum, np.maximum),
    "min_max": (np.maximum, np.minimum),
    "or_and": (lambda x, y: ((x != 0) & (y != 0)).astype(np.int64), np.maximum),
}
