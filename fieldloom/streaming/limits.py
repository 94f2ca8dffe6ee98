"""Keyed operators whose answer depends on earlier answers: rate limits and circuit breakers.

The batch forms read each key's rows in order of time, in one pass with the state of one key. The streaming form of the limiter keeps
the same state between micro-batches.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.paged import same_key

LIMIT, WINDOW = 12, 300.0
THRESHOLD, COOLDOWN = 3, 60.0


def admit(hits: deque, now: float, limit: int, window: float) -> tuple[bool, int]:
    """Whether a request at ``now`` (seconds) is admitted, and seconds to wait; only admitted ones count against the limit."""
    while hits and now - hits[0] > window:
        hits.popleft()
    if len(hits) >= limit:
        return False, int(window - (now - hits[0])) + 1
    hits.append(now)
    return True, 0


def pass_through(failures: int, opened: float, now: float, failed: bool, threshold: int, cooldown: float) -> tuple[bool, int, float]:
    """Whether a call at ``now`` goes through a circuit of so many failures in a row, opened then; and both after it."""
    if failures >= threshold:
        if now - opened < cooldown:
            return False, failures, opened
        failures = threshold - 1
    if not failed:
        return True, 0, opened
    return True, failures + 1, now if failures + 1 >= threshold else opened


def _folded(key: str, make, step, columns: dict[str, str]):
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state = None, None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if not same_key(own, (getattr(row, key),)):
                    own, state = (getattr(row, key),), make()
                out.append(step(state, row))
            yield frame.assign(**{c: [x[i] for x in out] for i, c in enumerate(columns)})

    return fold


def _in_order(events: DataFrame, key: str, order: list[str], make, step, columns: dict[str, str]) -> DataFrame:
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema), *(f"{c} {t}" for c, t in columns.items())])
    dealt = events.repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInPandas(_folded(key, make, step, columns), schema)


def rate_limited(events: DataFrame, key: str, seconds: str, order: list[str], limit: int = LIMIT, window: float = WINDOW) -> DataFrame:
    """``events`` with allowed and retry_after, by a sliding log of each key's admitted requests. Null keys are one key."""
    return _in_order(events, key, order, deque, lambda hits, row: admit(hits, getattr(row, seconds), limit, window), {"allowed": "boolean", "retry_after": "int"})


def guarded(calls: DataFrame, key: str, seconds: str, failed: str, order: list[str], threshold: int = THRESHOLD, cooldown: float = COOLDOWN) -> DataFrame:
    """``calls`` with allowed: false while the key's circuit is open, which ``threshold`` failures in a row open; after ``cooldown`` a probe goes through."""

    def step(state: dict, row) -> tuple[bool]:
        allowed, state["failures"], state["opened"] = pass_through(state["failures"], state["opened"], getattr(row, seconds), getattr(row, failed), threshold, cooldown)
        return (allowed,)

    return _in_order(calls, key, order, lambda: {"failures": 0, "opened": 0.0}, step, {"allowed": "boolean"})


def cached(requests: DataFrame, cache: str, key: str, value: str, order: list[str], capacity: int = 256) -> DataFrame:
    """``requests`` with hit and served: the value first held for the key, in a cache of ``capacity`` keys that drops the oldest; a hit does not refresh it. Null keys are one key."""

    def step(held: dict, row) -> tuple[bool, object]:
        name, got = getattr(row, key), getattr(row, value)
        name = None if name != name else name
        if name in held:
            return True, held[name]
        held[name] = got
        if len(held) > capacity:
            del held[next(iter(held))]
        return False, got

    return _in_order(requests, cache, order, dict, step, {"hit": "boolean", "served": requests.schema[value].dataType.simpleString()})


def rate_limited_stream(events: DataFrame, key: str, seconds: str, limit: int = LIMIT, window: float = WINDOW, expire: bool = True) -> DataFrame:
    """The limiter over a stream with columns key (long) and seconds (double): key, seconds, allowed, retry_after.

    With ``expire`` a key's log is dropped ``window`` seconds of processing time after its last batch; a run over what is available now ends only without it.
    """

    def update(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(frames)).sort_values(seconds)
        found = [admit(hits, t, limit, window) for t in rows[seconds]]
        state.update((list(hits),))
        if expire:
            state.setTimeoutDuration(int(window * 1000) + 1)
        yield pd.DataFrame({key: own[0], seconds: rows[seconds].to_numpy(), "allowed": [a for a, _ in found], "retry_after": [r for _, r in found]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} long, {seconds} double, allowed boolean, retry_after int", "hits array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)
