"""Expressions over arrays that work things out once and take linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once; an expression used twice in a lambda would be worked out at each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def places(flags: Column) -> Column:
    """array<boolean> -> the places, from 0, where it is true."""
    return F.filter(F.transform(flags, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
