"""Unit vectors whose dot products are correlations between clone trajectories.

Each function takes a table and the columns with the values of a clone at its
timepoints, and returns the table with further columns and the slots of ``u``. Their
values mean nothing for a constant trajectory, see ``varies``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.slots import any_of, total, with_slots

Profile = tuple[DataFrame, list[Column]]


def varies(values: Sequence[Column]) -> Column:
    """False for a constant trajectory, whose correlations are undefined.

    Tested on the values themselves, so that a filter on it stays a short expression.
    """
    return any_of([v != values[0] for v in values[1:]]) if len(values) > 1 else F.lit(False)


def _normalised(df: DataFrame, values: Sequence[Column]) -> Profile:
    df, (length,) = with_slots(df, "_length", [F.sqrt(total([v * v for v in values]))])
    return df, [F.when(length > 0, v / length) for v in values]


def _centred(df: DataFrame, values: Sequence[Column]) -> Profile:
    df, (mean,) = with_slots(df, "_mean", [total(values) / float(len(values))])
    return with_slots(df, "_centred", [v - mean for v in values])


def _average_ranks(df: DataFrame, values: Sequence[Column]) -> Profile:
    """Rank of every slot among the slots; ties share the mean of their ranks."""

    def rank(v: Column) -> Column:
        below = total([F.when(w < v, 1.0).otherwise(0.0) for w in values])
        level = total([F.when(w == v, 1.0).otherwise(0.0) for w in values])
        return below + (level + 1.0) / 2.0

    return with_slots(df, "_rank", [rank(v) for v in values])


def pearson(df: DataFrame, values: Sequence[Column]) -> Profile:
    return _normalised(*_centred(df, values))


def spearman(df: DataFrame, values: Sequence[Column]) -> Profile:
    return _normalised(*_centred(*_average_ranks(df, values)))


def kendall(df: DataFrame, values: Sequence[Column]) -> Profile:
    """Signs of all slot differences; their dot product is Kendall's tau-b."""
    width = len(values)
    signs = [F.signum(values[j] - values[i]) for i in range(width) for j in range(i + 1, width)]
    return _normalised(*with_slots(df, "_sign", signs))


CORRELATIONS: dict[str, Callable[[DataFrame, Sequence[Column]], Profile]] = {
    "pearson": pearson,
    "spearman": spearman,
    "kendall": kendall,
}


def profile_width(method: str, timepoints: int) -> int:
    return timepoints * (timepoints - 1) // 2 if method == "kendall" else timepoints
