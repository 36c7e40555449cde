"""Expressions over short arrays with one slot per timepoint.

The number of timepoints is known when the plan is built, so these helpers write the
slots out one by one. Such expressions stay inside whole-stage code generation, which
the higher-order array functions do not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_slots(df: DataFrame, prefix: str, values: Sequence[Column]) -> tuple[DataFrame, list[Column]]:
    """Add one column per value, and return the references to them.

    A value that later expressions use several times is computed once this way; inside
    an array it would be copied into each of them.
    """
    names = [f"{prefix}{i}" for i in range(len(values))]
    return df.withColumns(dict(zip(names, values))), [F.col(name) for name in names]


def slot(array: str, i: int) -> Column:
    return F.get(F.col(array), F.lit(i))


def slots(array: str, width: int) -> list[Column]:
    return [slot(array, i) for i in range(width)]


def total(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def largest(values: Sequence[Column]) -> Column:
    """Largest value, nulls ignored."""
    return F.greatest(*values) if len(values) > 1 else values[0]


def smallest(values: Sequence[Column]) -> Column:
    """Smallest value, nulls ignored."""
    return F.least(*values) if len(values) > 1 else values[0]


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def any_null(values: Sequence[Column]) -> Column:
    return any_of([v.isNull() for v in values])


def label_of(values: Sequence[Column], labels: Sequence[int], pick: Callable[[Sequence[Column]], Column]) -> Column:
    """Label of the first slot that holds ``pick(values)``; nulls ignored."""
    best = pick(values)
    return F.coalesce(*[F.when(v == best, F.lit(label)) for v, label in zip(values, labels)])


def dot(values: Sequence[Column], weights: Sequence[float]) -> Column:
    return total([v * F.lit(float(w)) for v, w in zip(values, weights)])


def squared_distance(values: Sequence[Column], point: Sequence[float]) -> Column:
    return total([(v - F.lit(float(p))) * (v - F.lit(float(p))) for v, p in zip(values, point)])


def long_rows(labels: Sequence[int], name: str, arrays: Sequence[tuple[str, str]]) -> Column:
    """One row per slot: the label and the slot of each ``(array, output name)``."""
    return F.inline(
        F.array(
            *[
                F.struct(F.lit(label).alias(name), *[slot(array, i).alias(out) for array, out in arrays])
                for i, label in enumerate(labels)
            ]
        )
    )
