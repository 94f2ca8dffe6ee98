"""Counters of a run: named sums taken while the stages of a plan run, and the same as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def interpretation_counters(kind: Column, failed: Column, seconds: Column) -> dict[str, Column]:
    """The counters of a run of calls: by kind (request, cache_hit, cache_miss, open_skip), failures, and seconds of the requests."""
    n = lambda c: F.count(F.when(c, 1))
    request = kind == "request"
    return {
        "requests": n(request),
        "failures": n(request & failed),
        "cache_hits": n(kind == "cache_hit"),
        "cache_misses": n(kind == "cache_miss"),
        "breaker_open_skips": n(kind == "open_skip"),
        "total_seconds": F.coalesce(F.sum(F.when(request, seconds)), F.lit(0.0)),
    }


def averaged(counters: dict) -> dict:
    """``counters`` with average_seconds instead of total_seconds: 0 where nothing was asked."""
    seconds = round(counters["total_seconds"] / counters["requests"], 2) if counters["requests"] else 0.0
    return {k: v for k, v in counters.items() if k != "total_seconds"} | {"average_seconds": seconds}


def counted(calls: DataFrame, keys: list[str], counters: dict[str, Column]) -> DataFrame:
    """keys and one column for each counter; average_seconds as in :func:`averaged`."""
    found = calls.groupBy(*keys).agg(*[c.alias(name) for name, c in counters.items()])
    average = F.when(F.col("requests") > 0, F.round(F.col("total_seconds") / F.col("requests"), 2)).otherwise(0.0)
    return found.withColumn("average_seconds", average).drop("total_seconds") if "total_seconds" in counters else found


class Run:
    """Counters of the stages of one plan. They are taken as rows pass, by the action that the plan is run for, without a job of their own.

    Of a stage that several actions run, the first one counts. A row that a lost executor's task had counted isn't counted twice, as only tasks that end count.
    """

    def __init__(self) -> None:
        self._stages: dict[str, Observation] = {}

    def stage(self, df: DataFrame, name: str, **counters: Column) -> DataFrame:
        if name in self._stages:
            raise ValueError(f"stage {name} is observed already")
        self._stages[name] = Observation(name)
        return df.observe(self._stages[name], *[c.alias(k) for k, c in counters.items()])

    def snapshot(self) -> dict[str, dict]:
        """Counters by stage; waits for the plan's action to end."""
        return {name: dict(seen.get) for name, seen in self._stages.items()}


class StreamCounters(StreamingQueryListener):
    """Sums of the named counters of all micro-batches: ``df.observe(name, *counters)`` names them, ``spark.streams.addListener`` begins."""

    def __init__(self) -> None:
        self.totals: dict[str, dict] = {}
        self.batches = 0

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        for name, row in event.progress.observedMetrics.items():
            own = self.totals.setdefault(name, {})
            for counter, value in row.asDict().items():
                own[counter] = own.get(counter, 0) + (value or 0)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
