"""Calls to outside services from tasks: routed by key, paced for the whole cluster, retried, and resumable."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.operators.align import PROMPT
from lexiforge.streaming.resume import run_resumable


@dataclass(frozen=True)
class Route:
    """A service: what a call takes and gives, how many calls a minute it allows, and by how many tasks at once they are made."""

    call: Callable[[str], str]
    per_minute: float = 14
    lanes: int = 1

    @property
    def interval(self) -> float:
        """Seconds between a lane's calls; a little over the minute's share, so that rounding lets no call slip into a minute too early."""
        return 60.01 * self.lanes / self.per_minute


class Pacer:
    """Lets a lane's calls through an interval apart, counted from its start too.

    So a lane that starts again, in the next job or as a retried task, leaves its gap, and lanes never have to talk to
    each other: any minute sees as many calls of a lane as there are intervals in it at most.
    """

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.interval, self.clock, self.sleep = interval, clock, sleep
        self.last = clock()

    def wait(self, least: float = 0.0) -> None:
        """Returns once the interval, and at least so many seconds, lie behind the call before."""
        while (left := self.last + max(self.interval, least) - self.clock()) > 0:
            self.sleep(left)
        self.last = self.clock()


def answers(parts: Iterator[pd.DataFrame], routes: dict[str, Route], attempts: int = 3, backoff: float = 2.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator[pd.DataFrame]:
    """Frames of (doc_id, route, lane, prompt) -> (doc_id, route, response, error, attempts). A failed call is made again, each time after a longer gap."""
    pacers: dict[tuple[str, int], Pacer] = {}
    for part in parts:
        made = []
        for doc_id, route, lane, prompt in part[["doc_id", "route", "lane", "prompt"]].itertuples(index=False):
            if route not in routes:
                made.append((doc_id, route, None, f"no route {route}", 0))
                continue
            pacer = pacers.setdefault((route, lane), Pacer(routes[route].interval, clock, sleep))
            for k in range(attempts):
                pacer.wait(routes[route].interval * backoff**k if k else 0.0)
                try:
                    response, error = routes[route].call(prompt), None
                    break
                except Exception as e:  # the service's own errors, of any kind
                    response, error = None, f"{type(e).__name__}: {e}"
            made.append((doc_id, route, response, error, k + 1))
        yield pd.DataFrame(made, columns=["doc_id", "route", "response", "error", "attempts"])


def ask_routed(docs: DataFrame, routes: dict[str, Route], route: Column, attempts: int = 3, backoff: float = 2.0, limit: int = 3000) -> DataFrame:
    """A11, IO14: docs(doc_id, src, tgt) -> (doc_id, route, response, error, attempts), each document asked at the service that route names.

    Each lane of a service is dealt to one task, which leaves the lane's gap between its calls, so all tasks together keep to
    what the service allows a minute, whatever runs beside or after them. Speculative execution must be off. A call that fails attempts times gives its last error
    and no response; so does an unknown or null route, without a call. Null sides are empty; prompts hold the first ``limit`` characters of each.
    """
    lanes = F.coalesce(*[F.when(route == name, r.lanes) for name, r in routes.items()], F.lit(1))
    side = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, limit)
    head, middle, end = PROMPT.replace("{src}", "{tgt}").split("{tgt}")
    prompt = F.concat(F.lit(head), side("src"), F.lit(middle), side("tgt"), F.lit(end))
    rows = docs.select("doc_id", route.cast("string").alias("route"), F.pmod(F.xxhash64("doc_id"), lanes).alias("lane"), prompt.alias("prompt"))
    dealt = rows.repartition(max(1, sum(r.lanes for r in routes.values())), "route", "lane")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.mapInPandas(lambda parts: answers(parts, routes, attempts, backoff), f"doc_id {kind}, route string, response string, error string, attempts int")


def ask_all(spark: SparkSession, docs: DataFrame, routes: dict[str, Route], route: Column, path: str, every: int = 50, **how) -> DataFrame:
    """ask_routed's answers in path, saved about every so many documents; a run asks only for what has no answer there, so failed calls come again with the next."""
    return run_resumable(spark, docs, lambda some: ask_routed(some, routes, route, **how).filter("error is null").drop("error"), path, "doc_id", every)
