"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, however often the body refers to it.

    Common subexpressions are not shared inside lambda functions; a lambda's own argument is.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
