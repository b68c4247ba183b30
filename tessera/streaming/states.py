"""The state of a fold kept for each key of a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.folds import Machine


def follow(stream: DataFrame, key: str, order: list[str], machine: Machine, start: dict, inputs: list[str], step: Callable[..., dict]) -> DataFrame:
    """The new state of each key that a micro-batch touched; ``step`` is the machine's step in plain Python, over the inputs.

    A key's rows of one micro-batch are put in order, and later micro-batches are taken to come later.  A null input is None; whole
    numbers are int.
    """
    kinds = {n: t.lower() for n, t, *_ in machine.fields}
    columns = ", ".join(f"{n} {t}" for n, t in kinds.items())
    whole = {n for n, t in machine.inputs if t == "BIGINT"}

    def plain(name: str, value: object) -> object:
        return None if pd.isna(value) else int(value) if name in whole else value

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # type: ignore[no-untyped-def]
        now = dict(zip(kinds, state.get)) if state.exists else dict(start)
        rows = pd.concat(list(parts)).sort_values(order)
        for values in zip(*[rows[n] for n in inputs]):
            now = step(now, *[plain(n, v) for n, v in zip(inputs, values)])
        state.update(tuple(now[n] for n in kinds))
        yield pd.DataFrame([{key: keys[0], **now}])

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, *dict.fromkeys([*order, *inputs])).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {columns}", columns, "update", "NoTimeout")
