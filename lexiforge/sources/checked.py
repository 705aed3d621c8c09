"""Counts that come with the write itself: how many rows a filter chain loses, and whether what was written is as it should be."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lexiforge.sources.corpora import _at, conform


def filtered(df: DataFrame, steps: Mapping[str, Column], seen: Observation) -> DataFrame:
    """AG7: the rows for which all steps hold. seen.get has ``rows`` and, per step, how many rows of those left it removed.

    The counts are partial sums of the tasks that do the filtering, there once an action over the result has ended; a null condition removes
    a row. No steps remove nothing, and an empty table counts zeros. If a lost executor has a stage ahead of a shuffle run
    again, what ran twice can count twice: write the result before it is shuffled where counts must be exact.
    """
    left, counts = F.lit(True), [F.count(F.lit(1)).alias("rows")]
    for name, keep in steps.items():
        keep = F.coalesce(keep, F.lit(False))
        counts.append(F.count_if(left & ~keep).alias(name))
        left = left & keep
    return df.observe(seen, *counts).where(left)


def write_conforming(df: DataFrame, path: str, columns: Sequence[str], rows: int | None = None, not_null: Sequence[str] = (), file_format: str = "parquet") -> dict[str, int]:
    """IO13: writes df if it has these columns in this order, as many rows where given, and no null in not_null; returns the counts.

    Rows are counted by the job that writes them, into a folder beside path that takes its place only if all is well; else
    that folder goes, what was at path stays and a ValueError says what is wrong. Names of columns may be any.
    """
    seen = Observation()
    nulls = {f"null_{k}": c for k, c in enumerate(not_null)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    counted = conform(df, columns).observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(quoted(c).isNull()).alias(k) for k, c in nulls.items()])
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    fs, new = _at(df.sparkSession, beside)
    _, old = _at(df.sparkSession, path)
    try:
        counted.write.format(file_format).save(beside)
        counts = {k: int(v or 0) for k, v in seen.get.items()}
        wrong = [f"{counts['rows']} rows, not {rows}"] if rows not in (None, counts["rows"]) else []
        wrong += [f"{counts[k]} nulls in {c}" for k, c in nulls.items() if counts[k]]
        if wrong:
            raise ValueError("; ".join(wrong))
        fs.delete(old, True)
        if not fs.rename(new, old):
            raise OSError(f"{beside} could not take the place of {path}")
    except ValueError:
        fs.delete(new, True)
        raise
    return {"rows": counts["rows"], **{c: counts[k] for k, c in nulls.items()}}
