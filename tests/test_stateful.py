import random
import time

import pytest

from fieldloom.operators import tables
from fieldloom.streaming import limits, stateful

SCHEMA = "k long, t double, i long, bad boolean, name string, stage string"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(stateful._PROVIDER, None)
    yield
    spark.conf.set(stateful._PROVIDER, before) if before else spark.conf.unset(stateful._PROVIDER)


def rows_of(n):
    rnd = random.Random(11)
    stages = [*tables.STAGES, "unheard of"]
    return [(rnd.choice([0, 1, 2, None]), float(i // 2), i, rnd.random() < 0.6, f"n{rnd.randint(0, 5)}", rnd.choice(stages)) for i in range(n)]


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, operator, folder, out):
    """One run over what is there, from where the last one ended."""
    found = operator(spark.readStream.schema(SCHEMA).parquet(str(folder)))
    found.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(out))


OPERATORS = {
    "limited": (lambda df: stateful.limited(df, "k", "t", "i", limit=4, window=20.0), lambda df: limits.rate_limited(df, "k", "t", ["t", "i"], 4, 20.0), ["allowed", "retry_after"]),
    "guarded": (lambda df: stateful.guarded(df, "k", "t", "i", "bad", 2, 9.0), lambda df: limits.guarded(df, "k", "t", "bad", ["t", "i"], 2, 9.0), ["allowed"]),
    "cached": (lambda df: stateful.cached(df, "k", "t", "i", "name", "i", capacity=3), lambda df: limits.cached(df, "k", "name", "i", ["t", "i"], 3), ["hit", "served"]),
    "staged": (lambda df: stateful.staged(df, "k", "t", "i", "stage"), lambda df: tables.staged(df, ["k"], ["t", "i"], "stage", "t"), ["before", "status", "waited"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_stream_equals_batch_over_a_restart_and_marks_late_rows(spark, rocksdb, tmp_path, name):
    stream, batch, columns = OPERATORS[name]
    rows = rows_of(120)
    write(spark, rows[:70], tmp_path / "in")
    run(spark, stream, tmp_path / "in", tmp_path / "out")
    late = [(0, 1.0, 900, True, "n0", "ready"), (1, 0.0, 901, False, "n1", "failed")]
    write(spark, [*rows[70:], *late], tmp_path / "in")
    found = run(spark, stream, tmp_path / "in", tmp_path / "out").collect()
    wanted = {r.i: tuple(r[c] for c in columns) for r in batch(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {r.i: tuple(r[c] for c in columns) for r in found if not r.late} == wanted
    assert {r.i: tuple(r[c] for c in columns) for r in found if r.late} == {i: (None,) * len(columns) for i in (900, 901)}


def test_latest_stage(spark):
    df = spark.createDataFrame([(1, 1.0, "validating"), (1, 3.0, "ready"), (1, 4.0, "??"), (2, 1.0, "reading_text"), (3, 1.0, None)], "k int, t double, stage string")
    assert sorted(tuple(r) for r in tables.latest_stage(df, ["k"], ["t"], "stage").collect()) == [(1, "ready", "ready"), (2, "reading_text", "processing")]


def test_idle_keys_are_forgotten(spark, rocksdb, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    write(spark, [(0, 0.0, 1, False, "", "")], source)
    stream = stateful.limited(spark.readStream.schema(SCHEMA).parquet(str(source)), "k", "t", "i", limit=1, window=1e9, idle=0.5)
    running = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="1 second").start()

    def rows(n):
        for _ in range(60):
            if (out / "_spark_metadata").exists() and (found := spark.read.schema(f"{SCHEMA}, late boolean, allowed boolean").parquet(str(out)).collect()) and len(found) >= n:
                return found
            time.sleep(0.5)
        raise TimeoutError(f"not {n} rows in half a minute")

    try:
        rows(1)
        time.sleep(3)
        write(spark, [(0, 5.0, 2, False, "", "")], source)
        assert {r.i: r.allowed for r in rows(2)} == {1: True, 2: True}
    finally:
        running.stop()
