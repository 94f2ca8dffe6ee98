"""Operators whose answer for a row depends on those for earlier rows of its page, conversation or client.

Rows are dealt by key and sorted; a task streams through them and holds one key's rows or state at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame


def same_key(a: tuple | None, b: tuple) -> bool:
    """Whether two keys are one; null is like null, also where pandas shows it as NaN."""
    return a is not None and all(x == y or (x != x and y != y) or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b, strict=True))


#: Arrow types of added columns.
KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; null is like null, NaN like NaN."""
    before, after = column[:-1], column[1:]
    differs = pc.fill_null(pc.not_equal(before, after), False)
    if pa.types.is_floating(column.type):
        differs = pc.and_not(differs, pc.fill_null(pc.and_(pc.is_nan(before), pc.is_nan(after)), False))
    return pc.or_(differs, pc.xor(before.is_null(), after.is_null())).to_numpy(zero_copy_only=False)


def per_key(rows: DataFrame, keys: list[str], order: list[str | Column], columns: list[str], f: Callable[[list[tuple]], list[tuple]], added: str) -> DataFrame:
    """``rows`` with the columns ``added`` (a DDL string), which ``f`` gives for each key from the tuples of ``columns`` of all its rows in order.

    Only ``columns`` become Python values; all others pass a task as Arrow arrays.
    """
    names, kinds = zip(*(c.strip().split() for c in added.split(",")), strict=True)

    def answered(batch: pa.RecordBatch, cuts: list[int]) -> pa.RecordBatch:
        """``batch``, whose keys begin at ``cuts``, with the new columns."""
        rows, found = list(zip(*(batch.column(c).to_pandas().tolist() for c in columns), strict=True)), []
        for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True):
            found += f(rows[a:b])
        new = [pa.array([x[i] for x in found], KINDS[k]) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows - 1, bool)
            for k in keys:
                new |= _changes(batch.column(k))
            starts = [0, *(np.flatnonzero(new) + 1).tolist()]
            if held and not any(_changes(pa.concat_arrays([held[-1].column(k)[-1:], batch.column(k)[:1]]))[0] for k in keys):
                end = starts[1] if len(starts) > 1 else batch.num_rows
                held.append(batch[:end])
                starts = starts[1:]
            if not starts:
                continue
            if held:
                yield answered(whole(held), [0])
            # whole keys are answered together; the last one may go on in the next batch
            if len(starts) > 1:
                yield answered(batch[starts[0] : starts[-1]], [x - starts[0] for x in starts[:-1]])
            held = [batch[starts[-1] :]]
        if held:
            yield answered(whole(held), [0])

    schema = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.schema), added])
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
