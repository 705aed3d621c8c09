"""Mixing sources to target weights as a time-varying curriculum.

Every source gets a target from its weight. Over training time t in [0, 1] it is asked for
``target * (a + 2 (1 - a) t)`` words a unit of time, whose integral over [0, 1] is the target:
``a`` over 1 brings a source early, under 1 late. A copy of a document whose words lie at u of the
source's target, counted along a keyed order and over epochs, stands where the integral reaches
u; sorting all copies by that position gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import Decisions, Workspace, free_names, keyed, row_key, running_total

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: Most copies of a source's words.
CAP = 3
#: ``a`` for each weight in WEIGHTS: light sources early, heavy ones late.
STARTS = (1.5, 1.0, 0.5)


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(ws: Workspace, sizes: DataFrame, weights=WEIGHTS, cap: int = CAP, starts=STARTS) -> DataFrame:
    """sizes(source, size) -> (source, source_size, ahead, weight, a, target), a row per source.

    Sources by code point, null last, take the weights in turn. They share all words by weight; a
    source whose share would pass cap times its size gets just that, and the others share
    the rest, until none is above.
    """
    per = ws.table(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ordered = running_total(ws, per.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], "one", "source_ranks")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("before") % len(values) + 1).cast("int"))
    ranked = ordered.select("source", "source_size", pick(weights).alias("weight"), pick(starts).alias("a"))
    ranked = running_total(ws, ranked, [F.col("source").asc_nulls_last()], "source_size", "source_sizes").withColumnRenamed("before", "ahead")
    ranked = ws.table(ranked, "source_weights")
    level, capped = 0.0, F.lit(False)
    while True:  # the level only rises, over a change of the capped sources
        at = F.sum(F.when(~capped, F.col("weight"))), F.sum(F.when(capped, cap * F.col("source_size"))), F.sum("source_size")
        open_weight, full, total = ranked.agg(*at).first()
        new = (total - (full or 0)) / open_weight if open_weight else level
        if new == level:
            break
        level, capped = new, cap * F.col("source_size") < F.lit(new) * F.col("weight")
    target = F.when(cap * F.col("source_size") < F.lit(level) * F.col("weight"), (cap * F.col("source_size")).cast("double"))
    return ranked.withColumn("target", target.otherwise(F.col("weight") * F.lit(level)))


def position(u: Column, a: Column) -> Column:
    """Where ``a t + (1 - a) t^2`` reaches u, for 0 <= a <= 2."""
    root = F.sqrt(F.greatest(a * a + 4 * (1 - a) * u, F.lit(0.0)))
    return F.when(a == 1, u).otherwise(2 * u / (a + root))


def plan(ws: Workspace, sized: DataFrame, weights=WEIGHTS, cap: int = CAP, starts=STARTS, key: str = "") -> DataFrame:
    """sized(doc_id, source, size, _file, _row) with source_size, target, copies, taken, positions array<double>.

    Within a source documents come by md5 of key and doc_id. The n-th copy of a document is
    taken if the middle of its words lies ahead of the target, so a source's taken words miss
    the target by half a document at most.
    """
    if not sized.limit(1).count():
        empty = F.lit(None).cast("double")
        return sized.withColumns({"source_size": F.lit(0).cast("long"), "target": empty, "copies": F.lit(0).cast("long"), "taken": F.lit(0).cast("long"), "positions": F.array(empty)})
    of = ws.table(targets(ws, sized, weights, cap, starts), "targets")
    dealt = sized.withColumn("_md5", F.md5(F.concat(F.lit(key), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    # Rows that tie up to the size are alike but for their place.
    order = [F.col("source").asc_nulls_last(), F.col("_md5"), F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("_file"), F.col("_row")]
    dealt = running_total(ws, dealt, order, "size", "order").drop("_md5")
    joined = dealt.join(of.withColumnRenamed("source", "_source"), dealt["source"].eqNullSafe(F.col("_source"))).drop("_source")
    middle = F.col("before") - F.col("ahead") + F.col("size") / 2
    epochs = F.expr(f"sequence(0L, {cap - 1}L)")
    taken = F.filter(F.transform(epochs, lambda e: e * F.col("source_size") + middle), lambda x: x < F.col("target"))
    joined = joined.withColumn("positions", F.transform(taken, lambda x: position(x / F.col("target"), F.col("a"))))
    joined = joined.withColumn("copies", F.size("positions").cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return joined.drop("before", "ahead", "weight", "a")


def mixture(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text, source, ...) -> doc_id, source, size, source_size, target, copies, taken, positions, in training order.

    Rows come by the position of their first copy, those that aren't taken last, then by doc_id. Null texts have size 0.
    A null source is a source of its own, last. Repeated rows are rows of their own. Sources without words take
    nothing. An empty table gives no rows. Other columns aren't read.
    """
    ws = Workspace(spark, "mixing")
    sized = row_key(ws.table(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes"))
    planned = ws.table(plan(ws, sized, **options).drop("_file", "_row"), "planned")
    ws.drop("sizes", "sources", "source_ranks", "source_sizes", "source_weights", "targets", "order")
    return planned.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), F.col("doc_id").asc_nulls_first(), "size", "source")


def mixed(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The taken copies of docs in training order: a row per copy, with docs' columns, whatever these are called.

    Nulls, repeated rows and an empty table are as for ``mixture``. Texts are read twice and shuffled once, by position.
    """
    ws = Workspace(spark, "mixed")
    table, file, row = keyed(ws, docs)
    sized = table.select(F.col(file).alias("_file"), F.col(row).alias("_row"), "doc_id", "source", words(F.col("text")).alias("size"))
    taken = plan(ws, ws.table(sized, "sizes"), **options).filter("copies > 0")
    at = Decisions(ws, taken.select(F.col("_file").alias("file"), F.col("_row").alias("row"), "positions"), "positions")
    ws.drop("sizes", "sources", "source_ranks", "source_sizes", "source_weights", "targets", "order")
    place = free_names(table.columns, "_position")[0]
    copies = table.withColumn(place, F.explode(at.of(F.col(file), F.col(row))))
    return copies.repartitionByRange(place, file, row).sortWithinPartitions(place, file, row).select(*docs.columns)
