"""Expressions over arrays that take linear time, or close to it, on long ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one inner sum goes over.
BLOCK = 128


def let(value: Column, f) -> Column:
    """f(value), with value worked out once; inside a lambda Spark would work it out at each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def sums_ahead(values: Column, block: int = BLOCK) -> Column:
    """array<long> -> for each element the sum of those ahead of it.

    Appending to an array copies it, so sums are put together from blocks: of each block's elements, then of the
    blocks' totals, whose number is small enough to be appended one by one.
    """
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def ahead(v: Column) -> Column:
        add = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(v, zero, add, lambda a: a["out"])

    total = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)

    def whole(v: Column) -> Column:
        firsts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(block))).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(firsts, lambda i: F.slice(v, i, F.lit(block)))
        return let(blocks, lambda b: let(ahead(F.transform(b, total)), lambda t: F.flatten(F.zip_with(t, b, lambda base, x: F.transform(ahead(x), lambda y: y + base)))))

    return let(values, whole)
