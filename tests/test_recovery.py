import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import recovery


def plain(ids, path, at, reply, out, lost):
    """The recursion that the rounds stand for."""
    answered, open_ = reply(ids, path)
    known = [i for i in ids if answered is not None and i in answered]
    out += [(i, path, at) for i in known]
    rest = [i for i in ids if i not in known]
    if not rest or len(ids) == 1 or open_:
        lost += rest
    elif known:
        plain(rest, path + ".M", at + 1, reply, out, lost)
    else:
        plain(ids[: len(ids) // 2], path + ".L", at + 1, reply, out, lost)
        plain(ids[len(ids) // 2 :], path + ".R", at + 1, reply, out, lost)


def test_rounds_against_the_recursion(spark):
    rows = [(p, i * 3 + p) for p in range(5) for i in range(23)] + [(None, 4), (None, 5), (6, 7), (6, 7)]
    reply = lambda ids, path: (None if sum(ids) % 4 == 0 else [i for i in ids if (i + len(ids)) % 3] + [999], path.count(".") > 2 and ids[0] % 5 == 0)

    def ask(frontier):
        total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, b: a + b)
        said = F.concat(F.filter("ids", lambda i: (i + F.size("ids")) % 3 != 0), F.array(F.lit(999).cast("long")))
        return frontier.withColumn("answered", F.when(total % 4 != 0, said)).withColumn("open", (F.size(F.split("path", r"\.")) > 3) & (F.col("ids")[0] % 5 == 0))

    batches = recovery.first_batches(spark.createDataFrame(rows, "page long, id long"), ["page"], ["id"], "id", 7)
    answers, rounds = recovery.bisected(batches, ask, ["page"])
    wanted, lost = [], []
    for page in {p for p, _ in rows}:
        ids = sorted(i for p, i in rows if p == page)
        for b in range(0, len(ids), 7):
            found = []
            plain(ids[b : b + 7], str(b // 7), 1, reply, found, lost)
            wanted += [(page, *x) for x in found]
    assert sorted(((r.page, r.id, r.path, r.round) for r in answers.collect()), key=repr) == sorted(wanted, key=repr)
    assert rounds.agg(F.sum("lost"), F.sum("answered")).first() == (len(lost), len(wanted))
    assert max(r[3] for r in wanted) >= 3


def test_no_batches(spark):
    batches = recovery.first_batches(spark.createDataFrame([], "page long, id long"), ["page"], ["id"], "id", 7)
    answers, rounds = recovery.bisected(batches, lambda f: f.withColumn("answered", F.col("ids")).withColumn("open", F.lit(False)), ["page"])
    assert answers.count() == rounds.count() == 0


def attempt(model, key, outcome, seconds=1.0, plain="ok"):
    return (model, key, outcome, seconds, plain, 0.5)


CASES = [
    ([attempt(0, 0, "ok")], ("answered", 0, 0, 1)),
    ([attempt(0, 0, "rate"), attempt(0, 1, "ok")], ("answered", 0, 1, 2)),
    ([attempt(0, 0, "missing"), attempt(1, 0, "ok")], ("answered", 1, 0, 2)),
    ([attempt(m, k, "rate") for m in (0, 1) for k in (0, 1)], ("rate_limited", None, None, 4)),
    ([attempt(m, k, "missing") for m in (0, 1) for k in (0, 1)], ("unavailable", None, None, 2)),
    ([attempt(0, 0, "empty")], ("answered", 0, 0, 1)),
    ([attempt(0, 0, "empty", plain="empty")], ("empty", 0, 0, 1)),
    ([attempt(0, 0, "timeout", plain="timeout")], ("failed", None, None, 1)),
    ([attempt(0, 0, "server", plain="server"), attempt(0, 1, "server", plain="server")], ("failed", None, None, 2)),
    ([attempt(0, 0, "rate", 80.0), attempt(0, 1, "ok")], ("deadline", None, None, 1)),
    ([], ("failed", None, None, 1)),
    (None, ("failed", None, None, 1)),
]


@pytest.mark.parametrize("turn", [0, 1])
def test_failover_cases(spark, turn):
    kind = "client int, n int, attempts array<struct<model:int,key:int,outcome:string,seconds:double,plain:string,plain_seconds:double>>"
    rows = [(c if c else None, 0, a) for c, (a, _) in enumerate(CASES)]
    # the next request begins with what answered last: its model 0 and key 0 stand in the place of those
    rows += [(1, 1, [attempt(0, 1, "ok")]), (2, 1, [attempt(1, 1, "rate"), attempt(1, 0, "missing"), attempt(0, 0, "ok"), attempt(0, 1, "ok")])]
    found = {(r.client, r.n): (r.outcome, r.served_model, r.served_key, r.tried) for r in recovery.failover(spark.createDataFrame(rows, kind).repartition(1 + 4 * turn), "client", ["n"]).collect()}
    assert [found[(c if c else None, 0)] for c in range(len(CASES))] == [w for _, w in CASES]
    assert found[(1, 1)] == ("answered", 0, 1, 1)
    assert found[(2, 1)] == ("answered", 0, 0, 2)


def test_bisecting_is_random_free(spark):
    rows = [(0, random.Random(i).randint(0, 9)) for i in range(20)]
    batches = recovery.first_batches(spark.createDataFrame(rows, "page long, id long"), ["page"], ["id"], "id", 10)
    assert sorted(i for r in batches.collect() for i in r.ids) == sorted(i for _, i in rows)
