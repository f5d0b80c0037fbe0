"""Column helpers without a built-in of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once.

    Catalyst merges stacked projections and would copy a column's expression into each of its uses; a lambda variable
    can't be merged, so that a long expression used n times costs once and the generated code stays small.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
