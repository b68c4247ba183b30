"""Ordered folds: values that each row hands on to the next, computed per key over its rows in order."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slots import walk
from .steps import compiled


#: Rows of one key that may meet in an array.
MOST_ROWS = 500_000

_FAR = 1e300  # stands for no limit; unlike infinity it may be multiplied by zero
_CASTS: dict[str, Callable] = {
    "BIGINT": lambda v: None if v is None else int(v),
    "DOUBLE": lambda v: None if v is None else float(v),
}


@dataclass(frozen=True)
class Average:
    """A value that each row moves by ``least(high, greatest(low, a * was + b))``.

    ``step`` gives a (not negative), b, low and high for a row's value, as Columns.  Without a ``start`` the first value is the start.
    Such steps can be joined into one of their kind, so a key's rows can be folded in blocks, and the blocks after that.
    """

    value: Column
    start: float | None
    step: Callable[[Column], tuple[Column | float, Column | float, Column | float, Column | float]]


def ewma(keep: float) -> Callable:
    """A moving average that keeps a share of what was."""
    return lambda now: (keep, now * (1 - keep), -_FAR, _FAR)


def memory_bias(loaded_share: Column) -> tuple:
    """Coarser by a tenth while more than 1.3 times the limit is loaded, else slowly finer; between 1 and 10."""
    over = loaded_share > 1.3
    return F.when(over, 1.1).otherwise(0.98), 0.0, F.when(over, -_FAR).otherwise(1.0), F.when(over, 10.0).otherwise(_FAR)


def frame_bias(ratio: Column) -> tuple:
    """Coarser above 1.5 times the target frame time, finer below 1.1 times, else unchanged; between 1 and 3."""
    over, under = ratio > 1.5, ratio < 1.1
    return F.when(over, 1.05).when(under, 0.97).otherwise(1.0), 0.0, F.when(under, 1.0).otherwise(-_FAR), F.when(over, 3.0).otherwise(_FAR)


def averages(df: DataFrame, keys: list[str], order: list[str], block: Column, found: dict[str, Average]) -> DataFrame:
    """One row for each key with all averages after its last row.  Null values move nothing; a key without values has its starts.

    ``block`` never falls along the order and cuts a long key into pieces, such as minutes of its time: the rows of a block meet in one
    task as an array, so a block must be short enough for that, and a key's blocks, five numbers each for an average, meet in another.
    """
    values = [a.value.cast("double").alias(n) for n, a in found.items()]
    rows = df.select(*keys, block.alias("_block"), F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate(order)], *values).alias("_row"))
    rows = rows.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))

    def joined(name: str, average: Average) -> Column:
        def move(was: Column, row: Column) -> Column:
            now = row[name]
            a, b, low, high = (c if isinstance(c, Column) else F.lit(c) for c in average.step(now))

            def to(x: Column) -> Column:
                return F.least(high, F.greatest(low, x * a + b))

            seed = F.when(was["seed"].isNotNull(), to(was["seed"])).otherwise(now)
            moved = F.struct((was["a"] * a).alias("a"), (was["b"] * a + b).alias("b"), to(was["low"]).alias("low"), to(was["high"]).alias("high"), seed.alias("seed"))
            return F.when(now.isNull(), was).otherwise(moved)

        still = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(-_FAR).alias("low"), F.lit(_FAR).alias("high"), F.lit(None).cast("double").alias("seed"))
        return F.aggregate("_rows", still, move)

    blocks = rows.select(*keys, F.struct("_block", *[joined(n, a).alias(n) for n, a in found.items()]).alias("_step"))
    blocks = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list("_step")).alias("_steps"))

    def after(name: str, start: float | None) -> Column:
        def move(x: Column, block_: Column) -> Column:
            s = block_[name]
            return F.when(x.isNull(), s["seed"]).otherwise(F.least(s["high"], F.greatest(s["low"], x * s["a"] + s["b"])))

        return F.aggregate("_steps", F.lit(start).cast("double"), move)

    return blocks.select(*keys, *[after(n, a.start).alias(n) for n, a in found.items()])


@dataclass(frozen=True)
class Machine:
    """A fold whose state has several fields.

    ``fields`` are (name, SQL type, start, next value) and ``inputs`` are (name, SQL type); a next value is SQL text over a,
    the state, and b, the row, in words that Spark and DuckDB share.
    """

    fields: tuple[tuple[str, str, str, str], ...]
    inputs: tuple[tuple[str, str], ...]

    def run(self, df: DataFrame, key: str, order: list[str], most_rows: int = MOST_ROWS) -> DataFrame:
        """One row for each key with its fields after its last row.  Rows whose order is equal come in the order of their inputs.

        The rows of a key with at most ``most_rows`` meet in one task as an array and are folded there by expressions.  Longer keys are
        told by a count, and their rows are sorted, which spills, and walked one by one, so that only the state is held.
        An empty table gives no row.
        """
        long = df.groupBy(F.col(key).alias("_long")).count().where(F.col("count") > most_rows).select("_long")
        if long.isEmpty():
            return self._gathered(df, key, order)
        is_long = F.col(key).eqNullSafe(F.col("_long"))
        return self._gathered(df.join(long, is_long, "left_anti"), key, order).unionByName(self.walked(df.join(long, is_long, "left_semi"), key, order))

    def _gathered(self, df: DataFrame, key: str, order: list[str]) -> DataFrame:
        struct = F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate(order)], *[F.col(n).cast(t).alias(n) for n, t in self.inputs])
        start = ", ".join(f"'{n}', CAST({s} AS {t})" for n, t, s, _ in self.fields)
        step = ", ".join(f"'{n}', CAST({e} AS {t})" for n, t, _, e in self.fields)
        folded = df.groupBy(key).agg(F.array_sort(F.collect_list(struct)).alias("rows"))
        state = F.expr(f"aggregate(rows, named_struct({start}), (a, b) -> named_struct({step}))")
        return folded.select(key, state.alias("state")).select(key, "state.*")

    def walked(self, df: DataFrame, key: str, order: list[str]) -> DataFrame:
        """The same in a walk over sorted rows, with the step's text evaluated in Python."""
        names, fields = [n for n, _ in self.inputs], [(n, t) for n, t, *_ in self.fields]
        rows = df.select(key, *[F.col(n).cast(t).alias(n) for n, t in self.inputs], *[F.col(c).alias(f"_{k}") for k, c in enumerate(order)])
        texts = [(n, t, s, e) for n, t, s, e in self.fields]

        def fold(own: Iterator[tuple]) -> Iterator[tuple]:
            rules = [(n, _CASTS[t], compiled(e)) for n, t, _, e in texts]
            state = {n: _CASTS[t](compiled(s)({}, {})) for n, t, s, _ in texts}
            for values in own:
                row = dict(zip(names, values))
                state = {n: cast(rule(state, row)) for n, cast, rule in rules}
            yield tuple(state[n] for n, _ in fields)

        return walk(rows, key, [*[f"_{k}" for k in range(len(order))], *names], fold, ", ".join(f"{n} {t}" for n, t in fields))

    def duck(self, source: str, key: str, order: str) -> str:
        """The same in DuckDB's words, over a source that has the key, the inputs and the columns of the order."""

        def struct(parts: list[str]) -> str:
            return "{" + ", ".join(parts) + "}"

        empty = [f"'{n}': CAST(NULL AS {t})" for n, t in self.inputs]
        start = struct([f"'{n}': CAST({s} AS {t})" for n, t, s, _ in self.fields] + empty)
        row = struct([f"'{n}': CAST(NULL AS {t})" for n, t, *_ in self.fields] + [f"'{n}': CAST({n} AS {t})" for n, t in self.inputs])
        step = struct([f"'{n}': CAST({re.sub(r'(?<![A-Za-z0-9_])([ab])[.]([a-z_]+)', r"\1['\2']", e)} AS {t})" for n, t, _, e in self.fields] + empty)
        out = ", ".join(f"s['{n}'] AS {n}" for n, *_ in self.fields)
        return f"SELECT {key}, {out} FROM (SELECT {key}, list_reduce(list_prepend({start}, list({row} ORDER BY {order})), lambda a, b: {step}) AS s FROM ({source}) q GROUP BY {key})"
