"""The state that a stream keeps, and calls to services: restarts, repeated batches, rates by a clock of its own."""

import math
import time

import pandas as pd
from pyspark.sql import functions as F

from lexiforge.operators import align
from lexiforge.sources import connector
from lexiforge.streaming import resume


def run(spark, tmp_path, work=lambda df: df, **how):
    source = spark.readStream.schema("k string, v int, t timestamp").parquet(str(tmp_path / "in"))
    q = resume.stream_resumable(source, work, str(tmp_path / "out"), str(tmp_path / "cp"), "k", **how)
    q.awaitTermination(120)
    if q.exception():
        raise q.exception()
    return q.lastProgress


def feed(spark, tmp_path, rows):
    spark.createDataFrame(rows, "k string, v int, t string").withColumn("t", F.to_timestamp("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_keys_once_across_restarts(spark, tmp_path):
    feed(spark, tmp_path, [("a", 1, None), ("b", 2, None), ("a", 1, None), (None, 5, None)])
    run(spark, tmp_path)
    feed(spark, tmp_path, [("b", 3, None), ("c", 4, None), (None, 6, None), ("c", 4, None)])
    run(spark, tmp_path)
    run(spark, tmp_path)
    assert sorted((r.k or "") for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["", "a", "b", "c"]


def test_a_broken_batch_is_done_again_once(spark, tmp_path):
    feed(spark, tmp_path, [("a", 1, None), ("b", 2, None)])
    broken = []

    def work(df):
        if not broken:
            broken.append(1)
            df.write.mode("overwrite").parquet(str(tmp_path / "out" / "batch=0"))  # what a driver lost behind its write leaves
            raise OSError("lost")
        return df

    try:
        run(spark, tmp_path, work)
    except Exception as e:
        assert "lost" in str(e)
    run(spark, tmp_path, work)
    feed(spark, tmp_path, [("a", 9, None), ("d", 2, None)])
    run(spark, tmp_path, work)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "d"]


def test_state_is_bounded_by_time(spark, tmp_path):
    for day in range(1, 9):
        feed(spark, tmp_path, [(f"{day}-{i}", i, f"2024-01-0{day} 00:00:00") for i in range(50)] + [(f"{day}-0", 7, f"2024-01-0{day} 00:10:00")])
        progress = run(spark, tmp_path, event_time="t", keep="1 hour")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400
    assert progress["stateOperators"][0]["numRowsTotal"] <= 150


class Clock:
    def __init__(self, at=0.0):
        self.at = at

    def __call__(self):
        return self.at

    def sleep(self, s):
        self.at += s


def calls_of(lane, n, route, start=0.0, fails=0):
    """When a lane makes its calls, by a clock of its own."""
    clock, times, left = Clock(start), [], [fails]

    def call(prompt):
        times.append(clock())
        clock.at += 0.3
        if left[0]:
            left[0] -= 1
            raise TimeoutError("no answer")
        return prompt

    frame = pd.DataFrame([(i, "x", lane, "p") for i in range(n)], columns=["doc_id", "route", "lane", "prompt"])
    made = pd.concat(list(connector.answers(iter([frame]), {"x": connector.Route(call, route.per_minute, route.lanes)}, clock=clock, sleep=clock.sleep)))
    return times, made, clock()


def test_no_minute_exceeds_the_limit():
    route = connector.Route(None, 14, 2)
    times = []
    for lane in range(2):
        at = 0.0
        for job in range(3):  # one job behind the other, each with tasks that know nothing of the last
            made, _, at = calls_of(lane, 40, route, at, fails=job)
            times += made
    times.sort()
    assert len(times) == 2 * (120 + 3)
    assert max(sum(t <= u < t + 60 for u in times) for t in times) <= 14
    assert times[-1] <= 60 * math.ceil(2 * 126 / 14) + 120  # and it isn't much slower than allowed


def test_retries_back_off():
    times, made, _ = calls_of(0, 2, connector.Route(None, 60, 1), fails=2)
    assert [round(b - a, 2) for a, b in zip(times, times[1:])] == [2.0, 4.0, 1.0]
    assert made.attempts.tolist() == [3, 1] and made.error.tolist() == [None, None]
    _, made, _ = calls_of(0, 1, connector.Route(None, 60, 1), fails=9)
    assert made.response.tolist() == [None] and made.error.tolist() == ["TimeoutError: no answer"] and made.attempts.tolist() == [3]


def test_routes_and_resuming(spark, tmp_path):
    def first(prompt):
        if "bad" in prompt and not (tmp_path / "mended").exists():
            raise ValueError("bad")
        return "first " + str("one" in prompt)

    routes = {"a": connector.Route(first, 60_000, 2), "b": connector.Route(lambda p: "second", 60_000, 1)}
    docs = spark.createDataFrame([(1, "one", "x", "a"), (2, "two", None, "b"), (3, "bad", "x", "a"), (4, "n", "x", "c"), (5, None, "x", None)], "doc_id long, src string, tgt string, vendor string")
    got = {r.doc_id: r for r in connector.ask_routed(docs, routes, F.col("vendor"), attempts=2).collect()}
    assert (got[1].response, got[2].response, got[3].error, got[3].attempts) == ("first True", "second", "ValueError: bad", 2)
    assert got[4].error == "no route c" and got[5].error == "no route None" and got[4].attempts == 0
    path, some = str(tmp_path / "answers"), docs.filter("doc_id < 4")
    ask = lambda: {r.doc_id for r in connector.ask_all(spark, some, routes, F.col("vendor"), path, every=2, attempts=1).collect()}
    assert ask() == {1, 2}
    (tmp_path / "mended").touch()
    assert ask() == {1, 2, 3}


def test_slices_of_a_document_of_10000_sentences(spark):
    n = 25_000
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "doc_id int, src string")
    sents = spark.range(10_000).selectExpr("1 as doc_id", "cast(id as int) as ord", "'t' as tgt", "cast(2 * id + 1 as int) as first_word").repartition(4)
    start = time.time()
    rows = {r.ord: r.src for r in align.sentence_slices(docs, sents).collect()}
    assert len(rows) == 10_000 and rows[17] == "w34 w35" and rows[9999].startswith("w19998 w19999") and rows[9999].endswith(f"w{n - 1}") and time.time() - start < 30
