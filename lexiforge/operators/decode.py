"""Batch inference behind an injected function, candidate selection by minimum Bayes risk, and character ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiforge.functions import metrics
from lexiforge.functions.arrays import let


def translate(rows: DataFrame, load: Callable[[], Callable[[list[str]], list]], text: str, key: str, batch: int = 16, many: bool = False) -> DataFrame:
    """(key, prediction), or array predictions if many. load runs once per task; blanks give ``<gap>``."""
    out = "predictions array<string>" if many else "prediction string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            texts = part[text].fillna("").tolist()
            made: list = [None] * len(texts)
            ask = [i for i, t in enumerate(texts) if t.strip()]
            for lo in range(0, len(ask), batch):
                some = ask[lo : lo + batch]
                for i, p in zip(some, model([texts[i] for i in some]), strict=True):
                    made[i] = p
            if many:
                made = [p or ["<gap>"] for p in made]
            else:
                made = [p if p and p.strip() else "<gap>" for p in made]
            yield pd.DataFrame({key: part[key], out.split()[0]: made})

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {out}")


#: Scores are summed as whole numbers of this fraction, so that sums don't depend on their order and ties stay ties.
FINE = 1_000_000_000


#: Candidates, and characters of theirs, that a block of a key's candidates has on average at most (a longer text is a block with others).
BLOCK, BLOCK_CHARS = 48, 1 << 16


def pair_scores(rows: DataFrame, key: str, order: str, text: str, keep_blank: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct candidates (key, i, text), i the earliest place of each, and (key, i, j, s): i's score with j as its reference.

    A key's candidates are dealt into blocks by their text, and each two blocks meet in a row, where a text's grams are made once and compared with those of all others there.
    So only texts are shuffled, a row holds the grams of two blocks, and a large key is many rows. Pairs without a common character have no common gram: they score 0 and have no row.
    Both directions of a pair come from one count of what they share.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    said = F.regexp_replace(said, r"(?U)^\s+|\s+$", "") if keep_blank else said
    named = rows.select(F.col(key).alias("key"), F.col(order).alias("i"), said.alias("text"))
    named = named if keep_blank else named.filter(F.col("text").rlike(r"(?U)\S"))
    cands = named.groupBy("key", "text").agg(F.min("i").alias("i"))
    of_key = cands.groupBy(F.col("key").alias("of")).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("text")) / BLOCK_CHARS)).cast("int").alias("blocks"), F.count("*").alias("n")).filter("n > 1")
    dealt = cands.join(of_key, cands["key"].eqNullSafe(of_key["of"])).withColumn("b", F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int"))
    met = dealt.select("key", "i", "text", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    met = met.withColumns({"p": F.least("b", "o"), "q": F.greatest("b", "o")}).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "key", "p", "q")
    met = met.groupBy("key", "p", "q").agg(F.collect_list(F.struct("i", "b", "text")).alias("texts"))

    def made(x: Column) -> Column:
        sizes = lambda u: F.array(*[metrics.size(u, *o) for o in metrics.KINDS])
        return let(metrics.units(x["text"]), lambda u: F.struct(x["i"].alias("i"), x["b"].alias("b"), F.array_distinct(u["c"]).alias("c"), sizes(u).alias("n"), metrics.profile(u).alias("g")))

    def compared(all_: Column) -> Column:
        meets = lambda x, y: (x["b"] == F.col("p")) & (y["b"] == F.col("q")) & ((F.col("p") < F.col("q")) | (x["i"] < y["i"]))
        both = lambda x, y: F.struct(x["i"].alias("i"), y["i"].alias("j"), x["n"].alias("n_i"), y["n"].alias("n_j"), metrics.matches(x["g"], y["g"]).alias("m"))
        with_ = lambda x: F.transform(F.filter(all_, lambda y: meets(x, y) & F.arrays_overlap(x["c"], y["c"])), lambda y: both(x, y))
        return F.flatten(F.transform(all_, with_))

    pairs = met.select("key", F.explode(let(F.transform("texts", made), compared)).alias("x")).select("key", "x.*")
    fine = lambda h, r: F.round(metrics.geo(*metrics.scores(F.col("m"), F.col(f"n_{h}"), F.col(f"n_{r}"), effective=True)) * FINE).cast("long")
    both = F.explode(F.array(F.struct("i", "j", fine("i", "j").alias("s")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), fine("j", "i").alias("s"))))
    return cands, pairs.select("key", both.alias("x")).select("key", "x.i", "x.j", "x.s").filter("s > 0")


def sweep(rows: DataFrame, key: str, order: str, text: str, sizes: list[int], keep_blank: bool = False) -> DataFrame:
    """mbr's choice from the candidates with order < k for each k of sizes: (key, pool, n_candidates, selected).

    The whole pool is scored once. A candidate's sum over each pool is a sum of those scores with j < k, and its mean's divisor is the same for all of a pool, so
    the largest sum is chosen, the earliest candidate on ties. n_candidates counts repeated and blank ones too; keys without candidates in a pool have no row.
    """
    cands, pairs = pair_scores(rows.filter(F.col(order) < max(sizes)), key, order, text, keep_blank)
    sums = pairs.groupBy("key", "i").agg(*[F.sum(F.when(F.col("j") < k, F.col("s"))).alias(f"s{k}") for k in sizes])
    x = sums.select(F.col("key").alias("of"), F.col("i").alias("at"), *[f"s{k}" for k in sizes])
    every = cands.join(x, cands["key"].eqNullSafe(x["of"]) & (cands["i"] == x["at"]), "left")
    best = lambda k: F.max_by("text", F.when(F.col("i") < k, F.struct(F.coalesce(f"s{k}", F.lit(0)), -F.col("i"))))
    chosen = every.groupBy("key").agg(*[best(k).alias(f"c{k}") for k in sizes])
    counts = rows.groupBy(F.col(key).alias("of")).agg(*[F.count_if(F.col(order) < k).alias(f"n{k}") for k in sizes])
    made = counts.join(chosen, counts["of"].eqNullSafe(chosen["key"]), "left")
    pools = F.explode(F.array(*[F.struct(F.lit(k).alias("pool"), F.col(f"n{k}").cast("int").alias("n_candidates"), F.coalesce(f"c{k}", F.lit("")).alias("selected")) for k in sizes]))
    return made.select(F.col("of").alias(key), pools.alias("x")).select(key, "x.pool", "x.n_candidates", "x.selected").filter("n_candidates > 0")


def mbr(rows: DataFrame, key: str, order: str, text: str, most: int | None = None, keep_blank: bool = False) -> DataFrame:
    """rows(key, order, text) -> (key, n_candidates, selected): the candidate with the best mean score against the others, the earliest on ties.

    most keeps the candidates with order < most only. Blank candidates are left out; keep_blank strips all and counts a blank as one that scores 0.
    Without a candidate the choice is empty.
    """
    return sweep(rows, key, order, text, [most if most is not None else (1 << 31) - 1], keep_blank).drop("pool")


def vocabulary(rows: DataFrame, text: str) -> DataFrame:
    """AG10: (char, id), ids from 4 by code point; 0 to 3 are pad, start, end and unknown."""
    chars = rows.select(F.explode(F.split(text, "")).alias("char")).filter("char <> ''").distinct()
    return chars.select("char", (F.row_number().over(Window.orderBy("char")) + 3).alias("id"))  # a row per character


def encode(text: Column, ids: Column, most: int = 298) -> Column:
    """Ids (map<char, id>) of the first characters between start and end."""
    chars = F.slice(F.filter(F.split(text, ""), lambda c: c != ""), 1, most)
    return F.concat(F.array(F.lit(1)), F.transform(chars, lambda c: F.coalesce(F.try_element_at(ids, c), F.lit(3))), F.array(F.lit(2)))


def decode(codes: Column, chars: Column) -> Column:
    """Characters (map<id, char>) up to the end mark."""
    stop = F.array_position(codes, 2)
    kept = F.when(stop > 0, F.slice(codes, F.lit(1), (stop - 1).cast("int"))).otherwise(codes)
    return F.array_join(F.transform(F.filter(kept, lambda c: c > 3), lambda c: F.coalesce(F.try_element_at(chars, c), F.lit(""))), "")
