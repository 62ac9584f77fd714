"""Ordered folds: rows are dealt by key, sorted within partitions and read as a stream.

State is a few numbers, reset where the key changes, so a group of any length takes the memory of one Arrow
batch and costs no gathering.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], outputs: str, start: Callable[[], object], step: Callable) -> DataFrame:
    """Adds the columns of ``outputs`` (DDL): ``step(state, *inputs) -> (state, output values)``, in ``order`` within ``keys``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(outputs)
    schema = StructType([*df.schema.fields, *added.fields])
    arrow = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for key, row in zip(zip(*(batch[k].to_pylist() for k in keys), strict=True), zip(*(batch[c].to_pylist() for c in inputs), strict=True), strict=True):
                if state is None or key != at:
                    at, state = key, start()
                state, values = step(state, *row)
                out.append(values)
            columns = [pa.array([v[i] for v in out], f.type) for i, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *arrow.names])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def greedy_batches(df: DataFrame, keys: list[str], order: list[str], size: str, most_items: int | None, most_size: int, out: str = "batch_id", least: int = 0) -> DataFrame:
    """Adds ``out``, from 0: a batch takes rows in order until its items or its summed sizes would pass the limits; a larger row is alone."""

    def step(state: tuple[int, int, int], n: int | None):
        batch, items, total = state
        n = max(n or 0, least)
        if items and ((most_items is not None and items >= most_items) or total + n > most_size):
            batch, items, total = batch + 1, 0, 0
        return (batch, items + 1, total + n), (batch,)

    return ordered_fold(df, keys, order, [size], f"{out} long", lambda: (0, 0, 0), step)


def paginate(df: DataFrame, keys: list[str], order: list[str], line: str, top: float, bottom: float, line_height: float, blank_share: float = 0.7) -> DataFrame:
    """Adds ``output_page`` (from 1) and ``y``: lines fill a page downwards, a null line costs a share of a line."""

    def step(state: tuple[int, float], text: str | None):
        page, y = state
        if y < bottom + line_height:
            page, y = page + 1, top
        return (page, y - line_height * (1 if text is not None else blank_share)), (page, y)

    return ordered_fold(df, keys, order, [line], "output_page int, y double", lambda: (1, top), step)
