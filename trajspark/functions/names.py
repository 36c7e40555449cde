"""Trajectory names and membership tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajspark.schema import K, TRAJ_PREFIX


def trajectory_number(k: str = K) -> Column:
    """The number in a trajectory name; null for ``Other``."""
    return F.when(F.col(k).startswith(TRAJ_PREFIX), F.substring(k, len(TRAJ_PREFIX) + 1, 9).try_cast("int"))


def is_listed(column: str, values: Sequence) -> Column:
    """Membership test that is false, not null, for a null value."""
    return F.coalesce(F.col(column).isin(*values), F.lit(False)) if values else F.lit(False)
