"""Order-dependent folds: state is carried from row to row of a key."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

FLUSH = 20_000


def _stream_fold(df: DataFrame, keys: list[str], order: list[str], init: Callable, step: Callable, schema: str) -> DataFrame:
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(key, frames, held):
        state = pickle.loads(held.get[0]) if held.exists else init()
        # the rows of a trigger come in no order; a later trigger's rows are later
        rows, out = pd.concat(list(frames)).sort_values(order, kind="stable"), []
        for row in rows.itertuples(index=False):
            state, more = step(state, row)
            out.extend(more)
        held.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=names)

    return df.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", "NoTimeout")


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], init: Callable, step: Callable, schema: str) -> DataFrame:
    """For the rows of each key, in order: state, out = step(state, row), where
    row is a named tuple and out a list of tuples of `schema`.

    One shuffle by the keys and a sort; then rows stream through, so memory
    depends on the state alone, not on how many rows a key has.  Keep payloads
    out of df: a fold needs the deciding columns only.
    """
    if df.isStreaming:
        return _stream_fold(df, keys, order, init, step, schema)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = object(), None, []
        for pdf in it:
            for row in pdf.itertuples(index=False):
                now = tuple(getattr(row, k) for k in keys)
                if now != key:
                    key, state = now, init()
                state, more = step(state, row)
                out.extend(more)
                if len(out) >= FLUSH:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def spaced(df: DataFrame, keys: list[str], order: list[str], value: str, least: int, first: bool, carry: tuple[str, ...] = (), start: int | None = None) -> DataFrame:
    """The rows whose `value` is at least `least` above that of the row taken
    before.  The first row of a key counts as taken, and is given out if `first`;
    or `start` counts as taken before it.  The columns `carry` come along.
    Greedy, so it isn't a tumbling window."""
    cols = list(dict.fromkeys([*keys, *order, value, *carry]))
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in cols)

    def step(last, row):
        now = getattr(row, value)
        if last is None:
            return now, [tuple(getattr(row, c) for c in cols)] if first else []
        if now - last >= least:
            return now, [tuple(getattr(row, c) for c in cols)]
        return last, []

    return ordered_fold(df.select(*cols), keys, order, lambda: start, step, schema)
