"""Golden records against plain Python: both ways of settling, nulls, blanks, repeated rows, clashing columns, none at all."""

import math
import random
from datetime import datetime, timedelta

import pytest

from lexiforge.llm import golden

SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, salt string, bucket int, cluster_id string"
FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]


def rows_of(seed, n=400):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    pick = lambda *x: rng.choice(x)
    rows = []
    for i in range(n):
        at = None if rng.random() < 0.1 else start + pick(timedelta(0), timedelta(days=60), timedelta(days=60, microseconds=1), timedelta(hours=rng.randrange(3000)))
        rows.append((i, pick(None, 3, 3, rng.randrange(n)), pick("crm", "web", "store", "partner", " crm", "", None), at, pick(None, "", " \t", "Ann", "Bob Ä", " x ", "日本語テスト"), pick(None, "\n", "a@x", "b@y"), pick(None, "Rome", " "), pick(None, 1, 2), pick(None, "", "retail", "export"), pick(None, 1.005, -2.5, 0.0, math.nan, math.inf, 1e300), "s", 1, "c"))
    rows += rows[:20] + [(None, None, "web", start, "Lost", None, "Paris", None, None, 1.0, "", 0, ""), (None, None, None, None, None, "z@z", None, 4, "retail", None, "", 0, ""), (None, 3, "crm", start, "Anonymous of three", None, None, None, None, 7.0, "", 0, "")]
    return rows


def brute(rows):
    said = lambda s: s if s is not None and s.strip("\x20\x09\x0a\x0b\x0c\x0d") else None
    groups = {}
    for r in rows:
        x = dict(zip(FIELDS, r))
        for c in ("name", "email", "city", "segment"):
            x[c] = said(x[c])
        b = x["balance"]
        x["cents"] = None if b is None or not math.isfinite(b) or abs(b) > 9e16 else math.floor(100 * b + 0.5)
        x["trust"] = {"crm": 4, "web": 3, "store": 2, "partner": 1}.get(x["source"], 0)
        groups.setdefault(x["client_id"] if x["master_id"] is None else x["master_id"], []).append(x)
    out = []
    for key, g in groups.items():
        dates = [x["updated_at"] for x in g if x["updated_at"]]
        for x in g:
            x["fresh"] = bool(x["updated_at"] and max(dates) - x["updated_at"] <= timedelta(hours=60 * 24))
        low = datetime(1, 1, 1)
        recent = lambda x: (x["updated_at"] is not None, x["updated_at"] or low, x["trust"], x["client_id"] is not None, -(x["client_id"] or 0))
        trusted = lambda x: (x["fresh"], x["trust"], *recent(x))

        def best(field, order):
            some = [x for x in g if x[field] is not None]
            top = max(some, key=lambda x: (*order(x), x[field]), default=None)
            return (None, None) if top is None else (top[field], top["client_id"])

        segment, segment_from = best("segment", recent)
        name, name_from = best("name", lambda x: (len(x["name"]), *trusted(x)))
        email, email_from = best("email", trusted)
        cents, balance_from = best("cents", lambda x: (segment is not None and x["segment"] == segment, *recent(x)))
        a = max(g, key=lambda x: ((x["city"] is not None) + (x["nation_id"] is not None), *trusted(x), x["city"] or "", x["nation_id"] or -1))
        from_ = None if a["city"] is None and a["nation_id"] is None else a["client_id"]
        out.append((key, len(g), sum(not x["fresh"] for x in g), name, email, segment, a["city"], a["nation_id"], cents, name_from, email_from, segment_from, balance_from, from_))
    return sorted(out, key=str)


@pytest.mark.parametrize("heavy", [1, 7, 10_000])
def test_golden_records(spark, heavy):
    rows = rows_of(heavy)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = golden.golden_records(spark, df, heavy)
    assert got.columns == list(golden.COLUMNS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_golden_records_of_nothing(spark):
    assert golden.golden_records(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_golden_zone(spark):
    """Clocks without a zone: an hour that the session's zone leaves out counts like any other."""
    rows = [(1, 1, "crm", datetime(2024, 3, 31, 2, 30), "a", None, None, None, None, None, "", 0, ""), (2, 1, "web", datetime(2024, 5, 30, 2, 30, 0, 1), "b", None, None, None, None, None, "", 0, "")]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = golden.golden_records(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [(r.n_records, r.n_stale) for r in got] == [(2, 1)]


def test_golden_long_texts(spark):
    long = "é" * 3_000_000
    rows = [(i, 5, "crm", None, long + str(i % 2), None, long, 1, long, 1.0, "", 0, "") for i in range(4)]
    for heavy in (2, 100):
        (r,) = golden.golden_records(spark, spark.createDataFrame(rows, SCHEMA), heavy).collect()
        assert r.name == long + "0" and r.segment == long and r.name_from == 0 and r.n_stale == 4
