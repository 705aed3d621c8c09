"""One golden record per cluster of records: survivorship with a hot-cold split.

Clusters are counted exactly. Those of at most ``heavy`` records are dealt out in buckets of about as many, and
each bucket's clusters are settled together in pandas by stable sorts. Larger ones, of which one may hold a third of all rows, are reduced
as trees: parts of a cluster by salt first, then the parts. So no task, broadcast or driver gets anything that grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import Workspace

#: Sources from the most to the least trusted; any other is trusted least.
TRUST = ("crm", "web", "store", "partner")
#: A record is stale if it is so much older than its cluster's latest.
STALE_MICROS = 60 * 24 * 3600 * 1_000_000
#: Records from which on a cluster is reduced as a tree, and of a bucket of smaller clusters, about.
HEAVY = 1024
#: Parts of a heavy cluster.
SPREAD = 64
SCHEMA = (
    "cluster_id long, n_records long, n_stale long, name string, email string, segment string, city string, nation_id int, balance_cents long, "
    "name_from long, email_from long, segment_from long, balance_from long, address_from long"
)
COLUMNS = tuple(c.strip().split()[0] for c in SCHEMA.split(","))
_LEAST = -(1 << 63)


def _micros(df: DataFrame, name: str) -> Column:
    """A timestamp's microseconds; without a zone they are those since 1970 on its own clock, whatever the session's zone."""
    c = F.col(name)
    if df.schema[name].dataType.simpleString() != "timestamp_ntz":
        return F.unix_micros(c)
    since = c - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda unit, micros: (F.extract(F.lit(unit), since).cast("decimal(20,6)") * micros).cast("long")
    return part("DAY", 86_400_000_000) + part("HOUR", 3_600_000_000) + part("MINUTE", 60_000_000) + part("SECOND", 1_000_000)


def prepared(records: DataFrame) -> DataFrame:
    """The records as both ways of settling read them: blanks as nulls, orders as numbers of which the larger comes first."""
    said = lambda c: F.when(F.col(c).rlike(r"[^\x20\x09-\x0D]"), F.col(c))
    trust = F.lit(0)
    for k, source in enumerate(reversed(TRUST)):
        trust = F.when(F.col("source") == source, k + 1).otherwise(trust)
    cents = F.floor(100 * F.col("balance").cast("double") + 0.5)
    fits = F.col("balance").cast("double").between(-9e16, 9e16)  # neither NaN, which is above all, nor infinite
    id_ = F.col("client_id").cast("long")
    return records.select(
        F.coalesce(F.col("master_id").cast("long"), id_).alias("cluster_id"),
        id_.alias("client_id"),
        F.coalesce(trust, F.lit(0)).alias("trust"),
        F.coalesce(_micros(records, "updated_at"), F.lit(_LEAST)).alias("updated"),
        F.coalesce(F.bitwise_not(id_), F.lit(_LEAST)).alias("by_id"),
        *[said(c).alias(c) for c in ("name", "email", "segment", "city")],
        F.col("nation_id").cast("int").alias("nation_id"),
        F.when(fits, cents).cast("long").alias("cents"),
    )


def _last_of(cluster: np.ndarray, n: int, keys: Iterable[np.ndarray], some: np.ndarray) -> np.ndarray:
    """For each of n clusters the row that sorts last by the keys, the first of which counts most, among some; -1 without any."""
    rows = np.flatnonzero(some)
    order = rows[np.lexsort([*[k[rows] for k in reversed(list(keys))], cluster[rows]])]  # a stable sort per key
    of = cluster[order]
    last = np.append(of[1:] != of[:-1], np.ones(min(len(of), 1), bool))
    at = np.full(n, -1)
    at[of[last]] = order[last]
    return at


def settle(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole clusters' prepared records, whose missing ids are marked, -> a record for each cluster."""
    cluster, each = pd.factorize(2 * pd.factorize(rows["cluster"])[0] + rows["lost"].to_numpy())
    n = len(each)
    column = {c: rows[c].to_numpy() for c in ("trust", "updated", "by_id")}
    told = {c: rows[c].notna().to_numpy() for c in ("name", "email", "segment", "city", "nation_id")} | {"cents": rows["has_cents"].to_numpy()}
    # Rows that agree in all of an order's keys, as repeated ones do, go by the value: the larger one.
    value = {c: pd.factorize(rows[c], sort=True)[0] for c in ("name", "email", "segment", "city")} | {"cents": rows["cents"].to_numpy(), "nation_id": rows["nation_id"].fillna(-(1 << 40)).to_numpy()}
    dated = column["updated"] != _LEAST
    latest = np.full(n, _LEAST)
    np.maximum.at(latest, cluster, column["updated"])
    fresh = dated & (np.where(dated, latest[cluster] - np.where(dated, column["updated"], 0), 0) <= STALE_MICROS)
    recent = [column["updated"], column["trust"], column["by_id"]]
    trusted = [fresh, column["trust"], *recent]
    pick = lambda keys, of: _last_of(cluster, n, [*keys, value[of]], told[of])
    segment = pick(recent, "segment")
    chosen = np.where(segment >= 0, value["segment"][segment], -2)[cluster]
    size = rows["name"].str.len().fillna(0).to_numpy()
    address = _last_of(cluster, n, [told["city"].astype(int) + told["nation_id"], *trusted, value["city"], value["nation_id"]], np.ones(len(rows), bool))
    at = {"name": pick([size, *trusted], "name"), "email": pick(trusted, "email"), "segment": segment, "balance": pick([value["segment"] == chosen, *recent], "cents"), "address": address}
    one = _last_of(cluster, n, [], np.ones(len(rows), bool))
    ids = pd.array(np.where(rows["has_id"], rows["client_id"], 0), dtype="Int64")
    ids[~rows["has_id"].to_numpy()] = pd.NA
    taken = lambda values, places: values.take(places, allow_fill=True)
    text = {c: pd.array(rows[c], dtype=object) for c in ("name", "email", "segment", "city")}
    clusters = pd.array(rows["cluster"].to_numpy()[one], dtype="Int64")
    clusters[rows["lost"].to_numpy()[one]] = pd.NA
    given = np.where((told["city"] | told["nation_id"])[address], address, -1)
    made = {
        "cluster_id": clusters,
        "n_records": np.bincount(cluster, minlength=n),
        "n_stale": np.bincount(cluster, weights=~fresh, minlength=n).astype(np.int64),
        **{c: taken(text[c], at[c]) for c in ("name", "email", "segment")},
        "city": taken(text["city"], address),
        "nation_id": taken(pd.array(rows["nation_id"], dtype="Int32"), address),
        "balance_cents": taken(pd.array(rows["cents"], dtype="Int64"), at["balance"]),
        **{f"{c}_from": taken(ids, at[c]) for c in ("name", "email", "segment", "balance")},
        "address_from": taken(ids, given),
    }
    return pd.DataFrame(made)[list(COLUMNS)]


def settled_in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """Records of small clusters, dealt out in buckets of whole clusters."""
    zero = F.lit(0).cast("long")
    plain = rows.select(
        F.pmod(F.xxhash64("cluster_id"), F.lit(buckets)).alias("bucket"),
        F.col("cluster_id").isNull().alias("lost"),
        F.coalesce("cluster_id", zero).alias("cluster"),
        F.col("client_id").isNotNull().alias("has_id"),
        F.coalesce("client_id", zero).alias("client_id"),
        F.col("cents").isNotNull().alias("has_cents"),
        F.coalesce("cents", zero).alias("cents"),
        *["trust", "updated", "by_id", "name", "email", "segment", "city", "nation_id"],
    )
    return plain.groupBy("bucket").applyInPandas(settle, SCHEMA)


def _tree(rows: DataFrame, **best: Column) -> DataFrame:
    """The largest of each column for each cluster: of the parts by salt, then of the clusters."""
    parts = rows.groupBy("cluster_id", "salt").agg(*[F.max(c).alias(k) for k, c in best.items() if not k.startswith("n_")], *[F.sum(c).alias(k) for k, c in best.items() if k.startswith("n_")])
    return parts.groupBy("cluster_id").agg(*[(F.sum if k.startswith("n_") else F.max)(k).alias(k) for k in best])


def reduced(rows: DataFrame) -> DataFrame:
    """Records of heavy clusters, with their salt: two sweeps up the tree, as what is stale and which balance counts depend on the first."""
    recent = [F.col("updated"), F.col("trust"), F.col("by_id")]
    id_ = F.col("client_id").alias("id")
    best = lambda of, *keys: F.when(F.col(of).isNotNull(), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col(of).alias("v"), id_))
    first = _tree(rows, latest=F.col("updated"), segment=best("segment", *recent))
    told = first.select("cluster_id", "latest", F.col("segment.v").alias("chosen"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    same = lambda a, b: a["cluster_id"].eqNullSafe(b["cluster_id"])
    both = rows.join(told, same(rows, told) & (rows["salt"] == told["salt"])).select(rows["*"], "latest", "chosen")
    dated = F.col("updated") != _LEAST
    fresh = dated & (F.when(dated, F.col("latest") - F.col("updated")).otherwise(0) <= STALE_MICROS)
    both = both.withColumn("fresh", fresh)
    trusted = [F.col("fresh"), F.col("trust"), *recent]
    filled = F.when(F.col("city").isNotNull(), 1).otherwise(0) + F.when(F.col("nation_id").isNotNull(), 1).otherwise(0)
    address = F.struct(filled.alias("filled"), *[k.alias(f"k{i}") for i, k in enumerate(trusted)], "city", "nation_id", id_)
    chosen = F.coalesce(F.col("segment") == F.col("chosen"), F.lit(False))
    second = _tree(
        both,
        n_records=F.lit(1).cast("long"),
        n_stale=F.when(F.col("fresh"), 0).otherwise(1).cast("long"),
        name=best("name", F.length("name"), *trusted),
        email=best("email", *trusted),
        balance=best("cents", chosen, *recent),
        address=address,
    )
    got = second.join(first.select(F.col("cluster_id").alias("of"), "segment"), F.col("cluster_id").eqNullSafe(F.col("of")))
    return got.select(
        *["cluster_id", "n_records", "n_stale", "name.v", "email.v", "segment.v", "address.city", "address.nation_id", "balance.v"],
        *["name.id", "email.id", "segment.id", "balance.id"],
        F.when(F.col("address.filled") > 0, F.col("address.id")),
    ).toDF(*COLUMNS)


def golden_records(spark: SparkSession, records: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """records(client_id, master_id, source, updated_at, name, email, city, nation_id, segment, balance, ...) -> a record per cluster.

    A record's cluster is its master_id, or its client_id if that is null; records with neither form one cluster, whose id
    is null. Strings without any character but white space count as null, as do balances that aren't finite or whose cents
    don't fit. Unknown and null sources are trusted least. A null client_id comes behind all others where ids
    decide. Records that an order can't tell apart, as repeated ones, each count in n_records, and the larger value is taken. Texts of any
    length are taken whole. Other columns aren't read, and an empty table gives no rows.
    """
    ws = Workspace(spark, "golden")
    rows = prepared(records)
    seen = Observation()
    counts = rows.groupBy("cluster_id").agg(F.count("*").alias("n")).observe(seen, F.sum("n").alias("rows"))
    # Each heavy cluster in as many copies as it has parts, so that its records meet it part by part.
    parts = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt")
    hot = ws.table(counts.filter(F.col("n") > heavy).select(F.col("cluster_id").alias("hot_id"), parts), "heavy")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("client_id", "updated", "name", "email", "cents"), F.lit(SPREAD)).cast("int"))
    on = salted["cluster_id"].eqNullSafe(hot["hot_id"]) & (salted["salt"] == hot["salt"])
    small = settled_in_buckets(salted.join(hot, on, "left_anti"), max(1, -(-(seen.get["rows"] or 0) // max(heavy, 1))))
    large = ws.table(salted.join(hot, on, "left_semi"), "records")
    return small.unionByName(reduced(large))
