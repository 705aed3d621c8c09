"""Deduplication, splits, samples and capped unions. Orders are explicit, so partitioning never shows in a result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def longest_target(df: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Of pairs with one source that with the longest target, ties to the least text."""
    return first_per(df, [src], F.length(tgt).desc(), F.col(tgt))


def bucket(key: Column, n: int = 10) -> Column:
    """A number below n from md5, the same in any engine and partitioning."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % n).cast("int")


def hash_split(df: DataFrame, key: Column, val_tenths: int = 1) -> DataFrame:
    """A column ``split``, val for about that many tenths of the keys. Split by document to keep its pairs together."""
    return df.withColumn("split", F.when(bucket(key) < val_tenths, "val").otherwise("train"))


def clean_val_split(df: DataFrame, key: Column, base: str = "base") -> DataFrame:
    """Only rows of the base source can be val."""
    return df.withColumn("split", F.when((F.col("source") == base) & (bucket(key) < 1), "val").otherwise("train"))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A keyed order of all rows."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """N rows, those with the smallest keyed hashes."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


#: Parts of equal width that keyed hashes of 60 bits are ranked in.
PARTS = 4096


def free_name(taken: list[str], name: str) -> str:
    """The name, with as many underscores behind it as it takes to be none of those taken, in any case."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def keyed_hash(*columns, seed: int = 42) -> Column:
    """60 bits of md5 of the seed and the columns, as any engine works it out."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str) else c for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def ranked(df: DataFrame, keyed: Column, *ties: str) -> DataFrame:
    """df with ``_rank`` from 1 by a keyed hash and ``_all``, the number of rows.

    Hashes are even, so parts of equal width are too: each part is sorted on its own, and only the sizes of PARTS parts meet in
    one task.
    """
    rows = df.withColumn("_h", keyed).withColumn("_p", F.shiftright("_h", 48))
    sizes = rows.groupBy("_p").count()  # PARTS rows at most
    ahead = F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_p", ahead.alias("_ahead"), F.sum("count").over(Window.partitionBy()).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_h", *ties))
    return rows.join(F.broadcast(sizes), "_p").withColumn("_rank", place + F.col("_ahead")).drop("_h", "_p", "_ahead")


def exact_split(df: DataFrame, key: str, share: float = 0.9, seed: int = 42) -> DataFrame:
    """R2: train gets floor(share * n) rows by keyed order."""
    out = ranked(df, keyed_hash(key, seed=seed), key)
    return out.withColumn("split", F.when(F.col("_rank") <= F.floor(F.lit(share) * F.col("_all")), "train").otherwise("val")).drop("_rank", "_all")


def tagged_union(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts with ``source`` and its place as ``precedence``; missing columns are null."""
    named = [df.withColumn("source", F.lit(k)).withColumn("precedence", F.lit(i)) for i, (k, df) in enumerate(parts.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def synthetic_cap(n_base: int, templates: int = 0, share: float = 0.3) -> int:
    """How many more synthetic rows keep them at the share of all."""
    return max(0, int(n_base / (1 - share) * share) - templates)


def capped(rows: DataFrame, cap: int, key: str, seed: int = 42) -> DataFrame:
    """So many rows at most, those with the smallest keyed hashes."""
    return ranked(rows, keyed_hash(key, seed=seed), key).filter(F.col("_rank") <= cap).drop("_rank", "_all")


def monolingual_pool(published: DataFrame | None, *train: DataFrame | None, text: str = "transliteration") -> DataFrame | None:
    """(text) of the published texts and of the first train table that is there, each text once; None if there is neither."""
    parts = [published, next((t for t in train if t is not None), None)]
    some = [p.select(F.col(text).alias("text")).filter("text is not null") for p in parts if p is not None]
    return reduce(lambda a, b: a.unionByName(b), some).distinct() if some else None


def pipeline_union(parts: dict[str, DataFrame], src: str = "src", tgt: str = "tgt") -> DataFrame:
    """The union without empty sides, each pair once, from the earliest source that has it."""
    rows = tagged_union(parts).filter((F.length(src) > 0) & (F.length(tgt) > 0))
    return first_per(rows, [src, tgt], F.col("precedence"))
