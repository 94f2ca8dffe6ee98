"""Keyed operators over streams whose state Spark keeps between micro-batches: value, list and map state, timers and time to live.

Each micro-batch's rows of a key are taken in order of time, ties by ``ident``. A row older than the last one taken for its key is late: it comes out with ``late`` and null results
and leaves the state alone, so a stream whose files come in order gives what the batch forms in ``limits`` and ``tables`` give, over restarts from the checkpoint, too. Null keys are one key.

With ``idle`` a key without rows for so many seconds of processing time is forgotten; a run over what is available now ends only without it.

The state store must be RocksDB's; where the session names no provider, it is set.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tables import STAGES, stage_status
from .limits import COOLDOWN, LIMIT, THRESHOLD, WINDOW, admit, pass_through

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """Rows of a key in order of time. Subclasses hold state in ``opened`` and answer a row in ``answer``; ``loaded`` and ``kept`` are called once a micro-batch."""

    def __init__(self, seconds: str, ident: str, results: list[str], idle: float | None = None):
        self.seconds, self.ident, self.results, self.idle = seconds, ident, results, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seconds double")
        self.due = handle.getValueState("due", "at long")
        self.opened(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows), ignore_index=True).sort_values([self.seconds, self.ident], kind="stable", ignore_index=True)
        last = self.last.get()[0] if self.last.exists() else None
        self.loaded()
        late, out = [], []
        for row in whole.itertuples(index=False):
            now = getattr(row, self.seconds)
            late.append(last is not None and now < last)
            if late[-1]:
                out.append((None,) * len(self.results))
            else:
                out.append(self.answer(row, now))
                last = now
        self.kept()
        self.last.update((float(last),))
        if self.idle is not None:
            due = timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000) + 1
            self.due.update((due,))
            self.handle.registerTimer(due)
        yield whole.assign(late=late, **{c: pd.Series([x[i] for x in out], dtype=object) for i, c in enumerate(self.results)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A key without rows for ``idle`` seconds of processing time is forgotten; timers of earlier rows do nothing."""
        if self.due.exists() and timerValues.getCurrentProcessingTimeInMs() >= self.due.get()[0]:
            self.forget()
            self.last.clear()
            self.due.clear()
        return iter([])

    def opened(self, handle) -> None: ...

    def loaded(self) -> None: ...

    def kept(self) -> None: ...

    def forget(self) -> None: ...

    def close(self) -> None: ...


class _Limiter(_InOrder):
    def __init__(self, *args, limit: int, window: float, **kwargs):
        super().__init__(*args, **kwargs)
        self.limit, self.window = limit, window

    def opened(self, handle):
        self.log = handle.getListState("hits", "seconds double")

    def loaded(self):
        self.hits = deque(x[0] for x in self.log.get()) if self.log.exists() else deque()

    def answer(self, row, now):
        return admit(self.hits, now, self.limit, self.window)

    def kept(self):
        self.log.put([(float(x),) for x in self.hits]) if self.hits else self.log.clear()

    def forget(self):
        self.log.clear()


class _Breaker(_InOrder):
    def __init__(self, *args, failed: str, threshold: int, cooldown: float, **kwargs):
        super().__init__(*args, **kwargs)
        self.failed, self.threshold, self.cooldown = failed, threshold, cooldown

    def opened(self, handle):
        self.circuit = handle.getValueState("circuit", "failures int, opened double")

    def answer(self, row, now):
        failures, opened = self.circuit.get() if self.circuit.exists() else (0, 0.0)
        allowed, failures, opened = pass_through(failures, opened, now, bool(getattr(row, self.failed)), self.threshold, self.cooldown)
        self.circuit.update((int(failures), float(opened)))
        return (allowed,)

    def forget(self):
        self.circuit.clear()


class _Cache(_InOrder):
    """Names and values in one map, the order of names in another; with ``ttl`` a name is forgotten that many milliseconds after it came."""

    def __init__(self, *args, name: str, value: str, kind: str, capacity: int, ttl: int | None, **kwargs):
        super().__init__(*args, **kwargs)
        self.name, self.value, self.kind, self.capacity, self.ttl = name, value, kind, capacity, ttl

    def opened(self, handle):
        self.held = handle.getMapState("held", "name string", f"value {self.kind}, at long", self.ttl)
        self.turns = handle.getMapState("turns", "at long", "name string")
        self.ends = handle.getValueState("ends", "first long, next long")

    def answer(self, row, now):
        name, got = str(getattr(row, self.name)), getattr(row, self.value)
        if self.held.containsKey((name,)):
            return True, self.held.getValue((name,))[0]
        first, following = self.ends.get() if self.ends.exists() else (0, 0)
        self.held.updateValue((name,), (got, following))
        self.turns.updateValue((following,), (name,))
        following += 1
        if following - first > self.capacity:
            (oldest,) = self.turns.getValue((first,))
            self.turns.removeKey((first,))
            # a name that expired and came again has a later turn
            if self.held.containsKey((oldest,)) and self.held.getValue((oldest,))[1] == first:
                self.held.removeKey((oldest,))
            first += 1
        self.ends.update((first, following))
        return False, got

    def forget(self):
        self.held.clear()
        self.turns.clear()
        self.ends.clear()


class _Stages(_InOrder):
    def __init__(self, *args, stage: str, **kwargs):
        super().__init__(*args, **kwargs)
        self.stage = stage

    def opened(self, handle):
        self.held = handle.getValueState("stage", "stage string, since double")

    def answer(self, row, now):
        stage = getattr(row, self.stage)
        before, since = self.held.get() if self.held.exists() else (None, None)
        if stage not in STAGES:
            return before, None, None
        self.held.update((stage, float(now)))
        return before, stage_status(stage), None if since is None else float(now - since)

    def forget(self):
        self.held.clear()


def _over(events: DataFrame, key: str, processor: _InOrder, results: dict[str, str]) -> DataFrame:
    spark = events.sparkSession
    if spark.conf.get(_PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKSDB)
    layout = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema), "late boolean", *(f"{c} {t}" for c, t in results.items())])
    return events.groupBy(key).transformWithStateInPandas(processor, layout, "Append", "None" if processor.idle is None else "ProcessingTime")


def limited(events: DataFrame, key: str, seconds: str, ident: str, limit: int = LIMIT, window: float = WINDOW, idle: float | None = None) -> DataFrame:
    """``events`` with late, allowed and retry_after, by a sliding log of each key's admitted requests (a list)."""
    return _over(events, key, _Limiter(seconds, ident, ["allowed", "retry_after"], idle, limit=limit, window=window), {"allowed": "boolean", "retry_after": "int"})


def guarded(calls: DataFrame, key: str, seconds: str, ident: str, failed: str, threshold: int = THRESHOLD, cooldown: float = COOLDOWN, idle: float | None = None) -> DataFrame:
    """``calls`` with late and allowed, by each key's circuit (a value)."""
    return _over(calls, key, _Breaker(seconds, ident, ["allowed"], idle, failed=failed, threshold=threshold, cooldown=cooldown), {"allowed": "boolean"})


def cached(requests: DataFrame, key: str, seconds: str, ident: str, name: str, value: str, capacity: int = 256, ttl: int | None = None, idle: float | None = None) -> DataFrame:
    """``requests`` with late, hit and served, by each key's cache of ``capacity`` names (maps), which forgets the oldest and, with ``ttl``, what is older than so many milliseconds; null names are one name."""
    kind = requests.schema[value].dataType.simpleString()
    return _over(requests, key, _Cache(seconds, ident, ["hit", "served"], idle, name=name, value=value, kind=kind, capacity=capacity, ttl=ttl), {"hit": "boolean", "served": kind})


def staged(updates: DataFrame, key: str, seconds: str, ident: str, stage: str, idle: float | None = None) -> DataFrame:
    """``updates`` with late, before (the stage until now), status and waited (seconds in it), by each document's stage; an unknown stage changes nothing."""
    return _over(updates, key, _Stages(seconds, ident, ["before", "status", "waited"], idle, stage=stage), {"before": "string", "status": "string", "waited": "double"})
