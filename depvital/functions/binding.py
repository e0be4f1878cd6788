"""Name an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is computed once however often the body uses it.

    A chain of withColumn would say the same, but a filter pushed below it repeats every definition at
    each use, and long rule chains then grow out of bounds.
    """
    # the value starts a fold over nothing; taking the only element of a list would ask for its type, and walk the whole
    # expression for it, at every row
    return F.aggregate(F.array().cast("array<boolean>"), value, lambda bound, _: bound, body)
