"""Cells that stand for many clones: the leaves of a grid tree, cut where it costs least.

Clones are points in a box. It is halved along every axis as often as the number of cells
with clones stays below ``FINE_CELLS``; every coarser grid is made of these cells. The tree
of grids is then cut at the largest cells whose sum of squares is below a bound, the
smallest bound that leaves at most ``limit`` cells. The rule is the same for any number of
clones: up to ``limit`` different points each is a cell of its own and nothing is lost;
beyond, the loss is the sum of squares within cells, and is measured.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.functions.slots import slots, total
from trajspark.schema import CLONE
from trajspark.session import materialize

#: Cells that the tree is made of, at most, and how often the box is halved at most.
FINE_CELLS = 1 << 17
DEPTH = 40


@dataclass(frozen=True)
class Leaves:
    """Cells of the cut: for every fine cell its leaf; means, weights and sums of squares of the leaves."""

    leaf: np.ndarray
    mean: np.ndarray
    weight: np.ndarray
    spread: np.ndarray


def _grouped(group: np.ndarray, weight: np.ndarray, mean: np.ndarray, spread: np.ndarray):
    """Weight, mean and sum of squares of unions of cells."""
    total = np.bincount(group, weights=weight)
    centre = np.stack([np.bincount(group, weights=weight * m) / total for m in mean.T], axis=1)
    apart = ((mean - centre[group]) ** 2).sum(axis=1)
    return total, centre, np.bincount(group, weights=spread + weight * apart)


def cut_tree(code: np.ndarray, weight: np.ndarray, mean: np.ndarray, spread: np.ndarray, limit: int) -> Leaves:
    """At most ``limit`` leaves of the tree over fine cells at ``code``, with least sums of squares."""
    if len(code) <= limit:
        return Leaves(np.arange(len(code)), mean, weight, spread)
    # sums of squares of the cells of every grid, the finest first, and the cell each is part of
    levels, parents = [spread], []
    now, cells = code, (weight, mean, spread)
    while len(now) > 1:
        now, parent = np.unique(now >> 1, axis=0, return_inverse=True)
        parent = parent.ravel()
        cells = _grouped(parent, *cells)
        # rounding must not make a union smaller than its parts
        largest = np.zeros(len(now))
        np.maximum.at(largest, parent, levels[-1])
        levels.append(np.maximum(cells[2], largest))
        parents.append(parent)

    def climbed(bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Level and node of the highest cell within the bound, for every fine cell."""
        level, at = np.zeros(len(code), dtype=np.int64), np.arange(len(code))
        moving = np.arange(len(code))
        for i, parent in enumerate(parents):
            up = parent[at[moving]]
            inside = levels[i + 1][up] <= bound
            moving = moving[inside]
            at[moving], level[moving] = up[inside], i + 1
        return level, at

    def leaf_count(bound: float) -> int:
        """Cells within the bound whose parent is not, and fine cells that are not themselves."""
        count = 0
        for i, size in enumerate(levels):
            ends = levels[i + 1][parents[i]] > bound if i < len(parents) else np.ones(1, dtype=bool)
            count += int((ends if i == 0 else ends & (size <= bound)).sum())
        return count

    bounds = np.unique(np.concatenate(levels))
    low, high = 0, len(bounds) - 1
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if leaf_count(bounds[middle]) <= limit else (middle + 1, high)
    level, node = climbed(bounds[low])
    _, first, leaf = np.unique(np.stack([level, node]), axis=1, return_index=True, return_inverse=True)
    # leaves in the order of their first cells
    leaf = np.argsort(np.argsort(first))[leaf.ravel()]
    weight, mean, spread = _grouped(leaf, weight, mean, spread)
    return Leaves(leaf, mean, weight, spread)


def in_grid(placed: DataFrame, width: int, clones: int, cells: int = FINE_CELLS) -> tuple[DataFrame, DataFrame]:
    """``placed`` with its fine ``cell``, and the fine cells: first clone, weight, mean, variance.

    The cells are at most ``cells``, whatever the number of clones is.
    """
    v = slots("v", width)
    box = placed.agg(*[F.min(c).alias(f"lo{d}") for d, c in enumerate(v)], *[F.max(c).alias(f"hi{d}") for d, c in enumerate(v)]).first()
    edge = max([box[f"hi{d}"] - box[f"lo{d}"] for d in range(width)] + [0.0]) or 1.0
    code = [F.floor((c - F.lit(box[f"lo{d}"])) / F.lit(edge) * F.lit(float(1 << DEPTH))) for d, c in enumerate(v)]
    coded = placed.withColumn("_code", F.array(*code))
    halved = DEPTH
    if clones > cells:
        guess = coded.agg(
            *[F.approx_count_distinct(F.xxhash64(*[F.shiftright(c, DEPTH - j) for c in slots("_code", width)])).alias(f"n{j}") for j in range(DEPTH + 1)]
        ).first()
        halved = max(j for j in range(DEPTH + 1) if j == 0 or guess[f"n{j}"] <= cells)
    while True:
        cell = F.array(*[F.shiftright(c, DEPTH - halved) for c in slots("_code", width)])
        gridded = coded.select(CLONE, "v", cell.alias("cell"))
        fine = materialize(
            gridded.groupBy("cell").agg(
                F.min(CLONE).alias("first"),
                F.count(F.lit(1)).cast("double").alias("weight"),
                F.array(*[F.avg(c) for c in v]).alias("mean"),
                F.array(*[F.var_pop(c) for c in v]).alias("variance"),
            )
        )
        # the estimate may be a little off
        if halved == 0 or clones <= cells or fine.count() <= cells:
            return gridded, fine
        halved -= 1


def clustered(
    fine: DataFrame, width: int, limit: int, cluster: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
) -> DataFrame:
    """``cell``, ``leaf``, its ``mean`` and ``cluster``, and the share of all squares that is ``lost`` within leaves.

    The fine cells are few, see ``in_grid``: one task cuts their tree and applies ``cluster`` to
    means and weights of the leaves. A row for each fine cell comes out.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("first")
        code, weight = _rows(table.column("cell"), width).astype(np.int64), table.column("weight").to_numpy()
        mean, variance = _rows(table.column("mean"), width), _rows(table.column("variance"), width)
        found = cut_tree(code, weight, mean, variance.sum(axis=1) * weight, limit)
        label = cluster(found.mean, found.weight) if cluster else np.zeros(len(found.weight), dtype=np.int64)
        whole = _grouped(np.zeros(len(found.weight), dtype=np.int64), found.weight, found.mean, found.spread)[2][0]
        lost = found.spread.sum() / whole if whole > 0 else 0.0
        return pa.table(
            {
                "cell": pa.array(list(code), pa.list_(pa.int64())),
                "leaf": pa.array(found.leaf.astype(np.int32)),
                "mean": pa.array(list(found.mean[found.leaf]), pa.list_(pa.float64())),
                "cluster": pa.array(label[found.leaf].astype(np.int32)),
                "lost": pa.array(np.full(len(code), lost)),
            }
        )

    schema = "cell array<bigint>, leaf int, mean array<double>, cluster int, lost double"
    return materialize(fine.groupBy(F.lit(1).alias("all")).applyInArrow(run, schema))


def _rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, width)


def with_cell(gridded: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """Every clone with columns of its fine cell, of which there are at most ``FINE_CELLS``."""
    return gridded.join(F.broadcast(found.select("cell", *columns)), "cell").select(CLONE, "v", *columns)


def representatives(gridded: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """For every leaf the clone nearest to its mean, how many clones the leaf has, and the share ``lost``."""
    held = with_cell(gridded, found, "leaf", "mean", "lost")
    gap = total([(a - b) * (a - b) for a, b in zip(slots("v", width), slots("mean", width))])
    nearest = F.min(F.struct(gap.alias("gap"), F.col(CLONE), F.col("v")))
    clones = F.count(F.lit(1)).cast("double").alias("weight")
    return held.groupBy("leaf").agg(nearest.alias("best"), clones, F.max("lost").alias("lost")).select(
        F.col(f"best.{CLONE}").alias(CLONE), F.col("best.v").alias("v"), "weight", "lost"
    )
