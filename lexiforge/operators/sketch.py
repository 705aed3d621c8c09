"""Distinct counts and quantiles as sketches that merge, so that a day's groups are read once and years are put together from days.

Exact quantiles hold all distinct values of a group in one task; a sketch holds some kilobytes, however many rows it has seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct count, as a power of two: its standard error is 1.04 over the square root of their number.
REGISTERS = 14
#: Values that a quantile sketch keeps of each level; a quantile's rank is off by about 1.7 hundredths at most with 200, inversely with more.
KEPT = 400


def sketched(rows: DataFrame, by: list[str], key: str, value: str, registers: int = REGISTERS, kept: int = KEPT) -> DataFrame:
    """AG4, AG5: by's columns, n, and sketches of the distinct keys and the values (as doubles). Null keys and values aren't seen; a group without any has no quantiles."""
    x = F.col(value).cast("double")
    some = F.when(~F.isnan(x), x)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(key, F.lit(registers)).alias("keys"), F.kll_sketch_agg_double(some, F.lit(kept)).alias("values"))


def merged(sketches: DataFrame, by: list[str], kept: int = KEPT) -> DataFrame:
    """Sketches of coarser groups from those of finer ones: the same columns, of by."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("values", F.lit(kept)).alias("values"))


def estimates(sketches: DataFrame, by: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """by's columns, n, the estimated number of distinct keys, and a quantile of the values for each share."""
    some = F.kll_sketch_get_n_double("values") > 0  # an empty sketch has no quantiles
    q = [F.when(some, F.kll_sketch_get_quantile_double("values", F.lit(s))).alias(f"q{round(100 * s)}") for s in shares]
    return sketches.select(*by, "n", F.hll_sketch_estimate("keys").alias("distinct_keys"), *q)
