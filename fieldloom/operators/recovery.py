"""Requests that are asked again: failed batches in halves, partial ones for the rest, and failover over models and keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.limits import _in_order
from .work import computed

MODELS, KEYS = 2, 2
TIMEOUT, BUDGET = 30.0, 2.5


def first_batches(blanks: DataFrame, keys: list[str], order: list[str], ident: str, size: int) -> DataFrame:
    """keys, path, ids: each key's blanks in order, ``size`` to a batch; ``path`` is the batch's number as text."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    dealt = blanks.select(*keys, at.alias("_at"), F.floor(at / size).cast("string").alias("path"), F.col(ident).alias("_id"))
    held = F.array_sort(F.collect_list(F.struct("_at", "_id")))
    return dealt.groupBy(*keys, "path").agg(F.transform(held, lambda x: x["_id"]).alias("ids"))


def bisected(batches: DataFrame, ask: Callable[[DataFrame], DataFrame], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What batches (keys, path, ids) that are asked, and asked again, get: answers (keys, id, path, round) and rounds (keys, round, asked, failed, answered, lost).

    ``ask`` adds the columns answered (ids; null where the request failed) and open (whether the circuit is open after it) to the batches of one round. A failed batch is
    halved (the first half is the smaller one; paths end in .L and .R), a partial answer's other ids are asked again (.M), both only while the circuit is closed and the batch has more than one id. An answer
    without any id of its batch counts as failed, ids of other batches don't count. A round is one plan over all batches still open, whose
    rows are written before the next; there are as many as the largest batch has ids at most. ``lost``: ids that are not asked again. Repeated ids are blanks of their own; null ids are never answered.
    """
    frontier, answers, rounds, at = batches.select(*keys, "path", "ids"), [], [], 0
    while True:
        at += 1
        named = lambda i: F.coalesce(F.array_contains("answered", i), F.lit(False))
        known = F.filter("ids", named)
        told = ask(frontier).withColumn("rest", F.filter("ids", lambda i: ~named(i))).withColumn("answered", F.when(F.size(known) > 0, known)).withColumn("open", F.coalesce("open", F.lit(False)))
        again = (F.size("rest") > 0) & (F.size("ids") > 1) & ~F.col("open")
        told = computed(told.select(*keys, "path", "ids", "answered", "rest", again.alias("again")))
        answers.append(told.select(*keys, F.explode("answered").alias("id"), "path", F.lit(at).alias("round")))
        count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        rounds.append(told.groupBy(*keys).agg(F.lit(at).alias("round"), F.count(F.lit(1)).alias("asked"), F.count(F.when(F.col("answered").isNull(), 1)).alias("failed"), count(F.size(F.coalesce("answered", F.array()))).alias("answered"), count(F.when(~F.col("again"), F.size("rest"))).alias("lost")))
        middle = F.floor(F.size("ids") / 2).cast("int")
        part = lambda name, ids: F.struct(F.concat("path", F.lit(name)).alias("path"), ids.alias("ids"))
        halves = F.array(part(".L", F.slice("ids", F.lit(1), middle)), part(".R", F.slice("ids", middle + 1, F.size("ids"))))
        more = F.when(F.col("answered").isNull(), halves).otherwise(F.array(part(".M", F.col("rest"))))
        frontier = told.where("again").select(*keys, F.explode(more).alias("b")).select(*keys, "b.path", "b.ids")
        if frontier.isEmpty():
            break
    union = lambda parts: parts[0] if len(parts) == 1 else union([a.unionByName(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + ([parts[-1]] if len(parts) % 2 else []))
    return union(answers), union(rounds)


def _served(models: int, keys: int, timeout: float, budget: float, attempts: str):
    """One request of a client, whose state says which model and key answered last."""

    def serve(state: dict, row) -> tuple:
        found = {(a["model"], a["key"]): a for a in getattr(row, attempts)}
        spent, tried, limited = 0.0, 0, False
        for m in range(models):
            model = (state["model"] + m) % models
            for k in range(keys):
                if spent >= max(timeout, 1) * budget:
                    return "deadline", None, None, tried
                key = (state["key"] + k) % keys
                attempt = found.get((model, key))
                tried += 1
                outcome = attempt["outcome"] if attempt else "refused"
                spent += attempt["seconds"] if attempt else 0.0
                if attempt and outcome not in ("ok", "missing", "rate"):
                    # once more without the constraint to JSON
                    outcome = attempt["plain"]
                    spent += attempt["plain_seconds"]
                if outcome in ("ok", "empty"):
                    state["model"], state["key"] = model, key
                    return "answered" if outcome == "ok" else "empty", model, key, tried
                if outcome == "missing":
                    break
                limited |= outcome == "rate"
                if outcome != "rate" and not (outcome == "server" and k + 1 < keys):
                    return "failed", None, None, tried
        return "rate_limited" if limited else "unavailable", None, None, tried

    return serve


def failover(requests: DataFrame, client: str, order: list[str], attempts: str = "attempts", models: int = MODELS, keys: int = KEYS, timeout: float = TIMEOUT, budget: float = BUDGET) -> DataFrame:
    """``requests`` with outcome, served_model, served_key and tried, by failover over models and keys.

    ``attempts``: array of (model, key, outcome, seconds, plain, plain_seconds), what each model would say to the request by each key: outcome ok, empty,
    missing (no such model: on to the next model), rate (429: next key), server (5xx: next key, if there is one) or another error (ends the request); plain is the outcome when an
    empty or failed reply is asked for without JSON. A request starts with the model and key that answered the client's last one, and ends
    before an attempt once ``timeout * budget`` seconds are spent. Outcomes: answered, empty, rate_limited (some key was, and none answered), unavailable, deadline, failed.
    An attempt without a row is refused; null attempts are none. A client's requests are taken in order with its state alone; null clients are one client.
    """
    whole = requests.withColumn(attempts, F.coalesce(F.col(attempts), F.array().cast(requests.schema[attempts].dataType)))
    return _in_order(whole, client, order, lambda: {"model": 0, "key": 0}, _served(models, keys, timeout, budget, attempts), {"outcome": "string", "served_model": "int", "served_key": "int", "tried": "int"})
