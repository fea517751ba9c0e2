"""Arrays and rows whose expressions are evaluated once.

Catalyst copies an expression to every place that uses it, also into lambdas, where it is then evaluated for every element.
`bind` and `settle` stop that; both stay in the JVM and keep the plan narrow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value evaluated once: it is the element of a one-element array."""
    return F.transform(F.array(value), f)[0]


def settle(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, which the optimizer neither merges projections nor moves filters through."""
    return df.select(F.explode_outer(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))).alias("__row")).select("__row.*")


def split_at(items: Column, starts: Callable[[Column, Column], Column], kind: str) -> Column:
    """The array cut into runs, in linear time: an item for which starts(items, place) holds begins a new run, and the first
    one does. `kind` is the items' array type."""

    def cut(xs: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | starts(xs, i))
        runs = bind(begins, lambda b: F.transform(b, lambda at, j: F.slice(xs, at + 1, F.coalesce(F.get(b, j + 1), F.size(xs)) - at)))
        return F.when(F.size(xs) > 0, runs).otherwise(F.array().cast(f"array<{kind}>"))

    return bind(items, cut)
