"""Scaled clone vectors and their correlations, without a clone-by-clone matrix.

Every clone gets a unit vector ``u`` so that the correlation of two clones is the dot
product of their ``u``. The table of ``u`` is the whole correlation matrix in factored
form. Distances between rows of that matrix are distances between the short vectors
``v = u P``, where ``P`` comes from the small matrix of sums of ``u[a] * u[b]``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.profiles import CORRELATIONS, profile_width, varies
from trajspark.functions.slots import any_null, dot, slot, slots, total, with_slots
from trajspark.operators.joins import lookup_join
from trajspark.schema import CLONE, K, require
from trajspark.session import materialize

EIGEN_FLOOR = 1e-12
ANCHOR_BLOCK = 256
#: Slots of a unit vector that make its cell in the search for correlated profiles.
GRID_AXES = 3


def abundance_matrix(vectors: DataFrame, width: int, fill_missing: bool = True) -> DataFrame:
    """Clone and its shares as the array ``x``.

    A timepoint without a sample becomes 0; with ``fill_missing=False`` clones that
    have one are left out instead.
    """
    require(vectors, CLONE, "perc")
    perc = slots("perc", width)
    if not fill_missing:
        return vectors.filter(~any_null(perc)).select(CLONE, F.col("perc").alias("x"))
    return vectors.select(CLONE, F.array(*[F.coalesce(p, F.lit(0.0)) for p in perc]).alias("x"))


def wide_matrix(matrix: DataFrame, timepoints: Sequence[int]) -> DataFrame:
    """The matrix with one column per timepoint, named ``t<week>``."""
    return matrix.select(CLONE, *[slot("x", i).alias(f"t{t}") for i, t in enumerate(timepoints)])


def scaled_matrix(matrix: DataFrame, width: int) -> DataFrame:
    """Z-score of every timepoint across clones; 0 where a timepoint does not vary.

    Means and deviations are one row, computed first and written into the plan.
    """
    x = slots("x", width)
    moments = matrix.agg(
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)],
        *[F.stddev_samp(v).alias(f"s{i}") for i, v in enumerate(x)],
    ).first()

    def scale(i: int, v: Column) -> Column:
        sd = moments[f"s{i}"]
        return (v - F.lit(moments[f"m{i}"])) / F.lit(sd) if sd else F.lit(0.0)

    return matrix.select(CLONE, F.array(*[scale(i, v) for i, v in enumerate(x)]).alias("x"))


def unit_vectors(matrix: DataFrame, width: int, method: str = "pearson") -> DataFrame:
    """Add ``u``; null for a clone that is constant over time."""
    if method not in CORRELATIONS:
        raise ValueError(f"method must be one of {', '.join(CORRELATIONS)}")
    spread, x = with_slots(matrix, "_x", slots("x", width))
    spread, u = CORRELATIONS[method](spread, x)
    return spread.select(*matrix.columns, F.when(varies(x), F.array(*u)).alias("u"))


def defined(units: DataFrame) -> DataFrame:
    """Clones whose correlations are defined."""
    return units.filter(F.col("u").isNotNull())


@dataclass(frozen=True)
class Projection:
    """``v = u @ matrix - offset``; the distance between two ``v`` is the row distance.

    ``clones`` is the number of clones that the sums behind it ran over.
    """

    matrix: np.ndarray
    offset: np.ndarray
    clones: int

    @property
    def width(self) -> int:
        return self.matrix.shape[1]

    def columns(self, source: str = "u") -> list[Column]:
        u = slots(source, self.matrix.shape[0])
        return [
            dot(u, self.matrix[:, c]) - F.lit(float(self.offset[c])) for c in range(self.width)
        ]


def _pair_sums(values: Sequence[Column], weight: Column | None = None) -> list[Column]:
    """Sums of all products of two slots, as aggregate columns ``g<a>_<b>``."""
    scale = F.lit(1.0) if weight is None else weight
    return [
        F.sum(values[a] * values[b] * scale).alias(f"g{a}_{b}")
        for a in range(len(values))
        for b in range(a, len(values))
    ]


def _symmetric(row, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    for a in range(width):
        for b in range(a, width):
            out[a, b] = out[b, a] = row[f"g{a}_{b}"] or 0.0
    return out


def _root(gram: np.ndarray) -> np.ndarray:
    """``R`` with ``R R^T = gram``, one column per dimension that matters, largest first."""
    values, axes = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1]
    values, axes = values[order], axes[:, order]
    keep = values > EIGEN_FLOOR * max(values[0], 0.0)
    keep[0] = True
    values = np.maximum(values, 0.0)
    return axes[:, keep] * np.sqrt(values[keep])


def row_projection(units: DataFrame, timepoints: int, method: str = "pearson") -> Projection:
    """Projection for distances between rows of the correlation matrix."""
    width = profile_width(method, timepoints)
    sums = defined(units).agg(F.count(F.lit(1)).alias("n"), *_pair_sums(slots("u", width))).first()
    root = _root(_symmetric(sums, width))
    return Projection(root, np.zeros(root.shape[1]), sums["n"])


def principal_projection(
    units: DataFrame, timepoints: int, method: str = "pearson", components: int = 5
) -> Projection:
    """Projection onto the principal axes of the standardised correlation matrix.

    Column ``j`` of that matrix has mean ``mean(u) . u_j`` and variance ``u_j S u_j``
    with ``S`` the covariance of ``u``, so two passes over the clones give all sums.
    An axis points to where most columns load positively.
    """
    width = profile_width(method, timepoints)
    clones, u = defined(units), slots("u", width)
    first = clones.agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{d}") for d, c in enumerate(u)], *_pair_sums(u)
    ).first()
    n = first["n"]
    if n == 0:
        return Projection(np.zeros((width, 1)), np.zeros(1), 0)
    mean = np.array([first[f"s{d}"] for d in range(width)]) / n
    spread = _symmetric(first, width) / n - np.outer(mean, mean)

    variance = total([dot(u, spread[:, d]) * u[d] for d in range(width)])
    precision = F.when(variance > EIGEN_FLOOR, 1.0 / variance).otherwise(0.0)
    second = clones.agg(
        *_pair_sums(u, precision), *[F.sum(c * F.sqrt(precision)).alias(f"w{d}") for d, c in enumerate(u)]
    ).first()
    root = _root(_symmetric(second, width))
    loadings = np.array([second[f"w{d}"] for d in range(width)])

    values, axes = np.linalg.eigh(root.T @ spread @ root)
    axes = axes[:, np.argsort(values)[::-1]][:, :components]
    matrix = root @ axes
    signs = np.where(loadings @ spread @ matrix < 0, -1.0, 1.0)
    matrix = matrix * signs
    return Projection(matrix, mean @ matrix, n)


def _trajectory_centres(units: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """Mean ``u`` of every trajectory; each clone has one row on both sides of the join."""
    members = defined(units).join(labels.select(CLONE, K), CLONE)
    return members.groupBy(K).agg(F.array(*[F.avg(c) for c in slots("u", width)]).alias("c"))


def _with_each(df: DataFrame, small: DataFrame, *columns: Column) -> DataFrame:
    """Repeat every row of ``df`` for the rows of a table of few rows, packed as one array."""
    packed = small.agg(F.array_sort(F.collect_list(F.struct(*columns)))).scalar()
    return df.select("*", F.inline(packed))


def _products(a: str, b: str, width: int) -> Column:
    return total([x * y for x, y in zip(slots(a, width), slots(b, width))])


def mean_correlations(units: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """Mean correlation of every clone with the clones of every trajectory.

    By linearity this is the dot product with the trajectory's mean ``u``. Work grows
    with clones times trajectories, not with pairs of clones.
    """
    centres = _trajectory_centres(units, labels, width)
    paired = _with_each(defined(units).select(CLONE, "u"), centres, F.col(K), F.col("c"))
    return paired.select(CLONE, K, _products("u", "c", width).alias("mean_cor"))


def block_means(units: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """Mean correlation between every two trajectories: the heat map by blocks.

    The mean over a block is the dot product of the two mean vectors, so one aggregate
    over the clones yields the whole table of trajectories by trajectories.
    """
    centres = materialize(_trajectory_centres(units, labels, width))
    paired = _with_each(centres, centres, F.col(K).alias("k_other"), F.col("c").alias("d"))
    return paired.select(K, "k_other", _products("c", "d", width).alias("mean_cor"))


def anchor_correlations(units: DataFrame, anchors: DataFrame, width: int) -> DataFrame:
    """Rows of the correlation matrix: every clone against each clone listed in ``anchors``.

    For the rows that are looked at. Anchors of any number are packed in blocks of about
    ``ANCHOR_BLOCK``; a clone meets one block after the other.
    """
    listed = materialize(defined(units).join(anchors.select(CLONE).distinct(), CLONE, "left_semi"))
    blocks = max(1, -(-listed.count() // ANCHOR_BLOCK))
    packed = listed.groupBy(F.pmod(F.xxhash64(CLONE), F.lit(blocks)).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(CLONE).alias("anchor_id"), F.col("u").alias("a")))).alias("anchors")
    )
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block")
    paired = defined(units).select(CLONE, "u", every).join(packed, "block").select(CLONE, "u", F.inline("anchors"))
    return paired.select(CLONE, "anchor_id", _products("u", "a", width).alias("cor"))


def profiles(units: DataFrame) -> DataFrame:
    """Different unit vectors: the first ``clone_id`` that has one, ``u``, and the number of ``clones`` that share it."""
    return defined(units).groupBy("u").agg(F.min(CLONE).alias(CLONE), F.count(F.lit(1)).alias("clones")).select(CLONE, "u", "clones")


def profile_members(units: DataFrame) -> DataFrame:
    """Every clone and its ``profile``, the first clone with the same unit vector."""
    named = profiles(units).select("u", F.col(CLONE).alias("profile"))
    return lookup_join(defined(units).select(CLONE, "u"), named, ["u"], "inner").select(CLONE, "profile")


def correlated_profiles(units: DataFrame, width: int, min_abs_cor: float) -> DataFrame:
    """Pairs of different profiles whose correlation is at least ``min_abs_cor`` or at most its negative.

    ``clone_id`` and ``other_id`` (the later), ``clones`` and ``others`` that share them, ``cor``. Pairs of
    clones follow from ``profile_members``; those that share a profile correlate by 1.

    Such unit vectors, or one and the opposite of the other, are nearer than
    ``sqrt(2 - 2 * min_abs_cor)``, so they lie in the same or neighbouring cells of that size
    in their first ``GRID_AXES`` slots. Only such pairs meet; with the threshold their number
    falls, and no table of all pairs is made.
    """
    if not 0 < min_abs_cor <= 1:
        raise ValueError("min_abs_cor must be above 0 and at most 1")
    axes = min(width, GRID_AXES)
    # a little larger, for rounding
    edge = math.sqrt(2 - 2 * min_abs_cor) + 1e-6
    held = materialize(profiles(units))
    u = slots("u", width)

    def cell(values: Sequence[Column], step: Sequence[Column]) -> Column:
        return F.array(*[F.floor(v / F.lit(edge)) + s for v, s in zip(values, step)])

    steps = list(product((-1, 0, 1), repeat=axes))
    each = F.explode(F.array(*[F.array(*[F.lit(s) for s in step]) for step in steps])).alias("step")
    way = F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("way")
    turned = held.select(CLONE, "u", "clones", way)
    reached = turned.select("*", each).select(
        CLONE, "u", "clones", "way", cell([F.col("way") * v for v in u[:axes]], slots("step", axes)).alias("cell")
    )
    zero = [F.lit(0)] * axes
    other = held.select(
        F.col(CLONE).alias("other_id"), F.col("u").alias("w"), F.col("clones").alias("others"), cell(u[:axes], zero).alias("cell")
    )
    met = reached.join(other, "cell").filter(F.col(CLONE) < F.col("other_id"))
    paired = met.select(CLONE, "other_id", "clones", "others", "way", _products("u", "w", width).alias("cor"))
    return paired.filter(F.col("cor") * F.col("way") >= F.lit(min_abs_cor)).drop("way")


def row_distances(units: DataFrame, projection: Projection) -> DataFrame:
    """Per clone, the mean squared distance of its correlation row to all other rows.

    Uses ``mean |v - w|^2 = |v|^2 - 2 v . mean(w) + mean |w|^2``. No rows if no clone has a
    defined correlation.
    """
    width = projection.width
    placed = defined(units).select(CLONE, F.array(*projection.columns()).alias("v"))
    v = slots("v", width)
    sums = placed.agg(
        *[F.avg(c).alias(f"m{d}") for d, c in enumerate(v)], F.avg(total([c * c for c in v])).alias("q")
    ).first()
    # without clones the means are null
    centre = [sums[f"m{d}"] or 0.0 for d in range(width)]
    return placed.select(
        CLONE,
        (total([c * c for c in v]) - F.lit(2.0) * dot(v, centre) + F.lit(sums["q"] or 0.0)).alias("mean_sq_dist"),
    )
