"""Trajectory labels: Ward, medoids, principal components with Ward, or the peak timepoint.

All methods work on the vectors ``v`` of ``trajspark.operators.vectors``, whose distances
are those between rows of the correlation matrix. Ward joins the cells of
``trajspark.operators.cells``, one for each different clone as long as there are no more
than ``WARD_CELLS``; medoids are clones of the table, and exchanges are judged by the
distances of all clones; after principal components, centres move by the means of all
clones. What reaches the driver are a few rows for each trajectory.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.names import trajectory_number
from trajspark.functions.partition import distances, exchange_costs, medoids, ward
from trajspark.functions.slots import label_of, largest, slots, smallest, squared_distance, with_slots
from trajspark.operators.cells import clustered, in_grid, representatives, with_cell
from trajspark.operators.joins import lookup_join
from trajspark.operators.ordering import ordered_rank
from trajspark.operators.vectors import Projection, defined, principal_projection, row_projection
from trajspark.schema import CLONE, K, N_CLUSTERS, OTHER, TRAJ_PREFIX, require
from trajspark.session import materialize

#: Different clones that are clustered exactly; more are joined in cells first.
WARD_CELLS = 5_000
MEDOID_CELLS = 2_500
#: Clones that may take a medoid's place, tried with the distances of all clones.
CANDIDATES = 256
EXCHANGES = 20
#: Share of squares within cells that is rounding.
EXACT_LOSS = 1e-12
CONSOLIDATION_PASSES = 10
METHODS = ("hclust", "pam", "hcpc", "absolute")


def place(units: DataFrame, projection: Projection) -> DataFrame:
    """Clones with defined correlations and their ``v``."""
    return defined(units).select(CLONE, F.array(*projection.columns()).alias("v"))


def nearest(placed: DataFrame, points: np.ndarray, name: str) -> DataFrame:
    """Add the number of the nearest of few points, the first of equally near ones."""
    v = slots("v", points.shape[1])
    spread, gaps = with_slots(placed, "_gap", [squared_distance(v, p) for p in points])
    return spread.select(*placed.columns, label_of(gaps, range(len(points)), smallest).alias(name))


def ward_cells(placed: DataFrame, projection: Projection, clusters: int, cells: int = WARD_CELLS) -> DataFrame:
    """Every clone with its Ward ``cluster`` and the share of squares ``lost`` within cells (0: exact)."""
    gridded, fine = in_grid(placed, projection.width, projection.clones)
    found = clustered(fine, projection.width, cells, lambda points, weights: ward(points, weights, clusters))
    return with_cell(gridded, found, "cluster", "lost")


def first_clones(assigned: DataFrame) -> dict[int, int]:
    """Number the clusters 1, 2, ... by their first clone."""
    firsts = assigned.groupBy("cluster").agg(F.min(CLONE).alias("first")).collect()
    return {r.cluster: i + 1 for i, r in enumerate(sorted(firsts, key=lambda r: r.first))}


def custom_numbers(numbers: dict[int, int], custom_order: Sequence[int] | None, clusters: int) -> dict[int, int]:
    """Cluster ``c`` becomes its position in ``custom_order``, if that lists every cluster once."""
    if not custom_order or len(custom_order) != clusters or set(custom_order) != set(numbers.values()):
        return numbers
    position = {c: i + 1 for i, c in enumerate(custom_order)}
    return {cluster: position[number] for cluster, number in numbers.items()}


def relabel(labels: DataFrame, custom_order: Sequence[int], clusters: int) -> DataFrame:
    """Renumber the ``clusters`` trajectories of a label table: number ``c`` becomes its position in ``custom_order``.

    Nothing changes unless the list has every number from 1 to ``clusters`` once. ``Other``
    stays as it is.
    """
    if sorted(custom_order) != list(range(1, clusters + 1)):
        return labels
    number = trajectory_number()
    position = F.array_position(F.array(*[F.lit(c) for c in custom_order]), number)
    name = F.when(position > 0, F.concat(F.lit(TRAJ_PREFIX), position.cast("string"))).otherwise(F.col(K))
    return labels.withColumn(K, name)


def named(assigned: DataFrame, numbers: dict[int, int]) -> DataFrame:
    """Clone and trajectory name."""
    names = [F.when(F.col("cluster") == c, F.lit(f"{TRAJ_PREFIX}{i}")) for c, i in sorted(numbers.items())]
    return assigned.select(CLONE, F.coalesce(*names).alias(K))


def no_labels(placed: DataFrame) -> DataFrame:
    """The result if no clone has a defined correlation."""
    return placed.select(CLONE, F.lit(None).cast("string").alias(K))


def no_loss(units: DataFrame) -> DataFrame:
    """The row of ``ward_loss`` if no clone has a defined correlation."""
    nothing = [F.lit(None).cast("bigint").alias("clones"), F.lit(0.0).alias("lost"), F.lit(None).cast("double").alias("within")]
    return units.sparkSession.range(1).select(*nothing)


def ward_labels(
    units: DataFrame,
    timepoints: int,
    clusters: int = N_CLUSTERS,
    correlation: str = "pearson",
    custom_order: Sequence[int] | None = None,
    cells: int = WARD_CELLS,
) -> DataFrame:
    """Ward clusters of the correlation rows; exact for up to ``cells`` different clones."""
    projection = row_projection(units, timepoints, correlation)
    placed = place(units, projection)
    if projection.clones == 0:
        return no_labels(placed)
    assigned = ward_cells(materialize(placed), projection, clusters, cells)
    return named(assigned, custom_numbers(first_clones(assigned), custom_order, clusters))


def ward_loss(
    units: DataFrame, timepoints: int, clusters: int = N_CLUSTERS, correlation: str = "pearson", cells: int = WARD_CELLS
) -> DataFrame:
    """One row: ``clones``, the share of all squares ``lost`` within cells, and the share ``within`` the clusters.

    What is within the clusters is what is between the cells of a cluster, which Ward keeps
    small, and ``lost``. If no clone has a defined correlation, nothing is lost and the
    other two are null.
    """
    projection = row_projection(units, timepoints, correlation)
    if projection.clones == 0:
        return no_loss(units)
    assigned = ward_cells(materialize(place(units, projection)), projection, clusters, cells)
    v = slots("v", projection.width)

    def squares(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"),
            F.max("lost").alias("lost"),
            (sum((F.var_pop(c) for c in v), F.lit(0.0)) * F.count(F.lit(1))).alias("squares"),
        )

    parts = squares(assigned, "cluster").agg(F.sum("squares").alias("inner"))
    whole = squares(assigned)
    return whole.select(F.col("n").alias("clones"), "lost", F.try_divide(parts.scalar(), F.col("squares")).alias("within"))


def chosen_medoids(
    placed: DataFrame, projection: Projection, clusters: int, cells: int = MEDOID_CELLS, candidates: int = CANDIDATES
) -> list:
    """Rows of the clones that are medoids: name and ``v``.

    Medoids of the cells' clones come first. Then the best exchange of a medoid for one of
    the most promising clones is made, as long as one lowers the sum of the distances of all
    clones. For up to ``cells`` different clones the first step is the whole of the method.
    """
    gridded, fine = in_grid(placed, projection.width, projection.clones)
    standing = materialize(representatives(gridded, clustered(fine, projection.width, cells), projection.width))

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by(CLONE)
        points = np.array(table.column("v").to_pylist()).reshape(table.num_rows, projection.width)
        weights = table.column("weight").to_numpy()
        found = medoids(points, weights, clusters)
        change = exchange_costs(points, weights, points[found], points).min(axis=0)
        change[found] = np.inf
        others = np.argsort(change, kind="stable")[: min(candidates, len(change) - len(found))]
        return table.take(np.append(found, others)).append_column("place", pa.array(np.arange(len(found) + len(others))))

    schema = f"{CLONE} string, v array<double>, weight double, lost double, place bigint"
    rows = standing.groupBy(F.lit(1).alias("all")).applyInArrow(choose, schema).orderBy("place").collect()
    count = min(clusters, len(rows))
    now, others = rows[:count], rows[count:]
    # where each different clone was a cell of its own, nothing is left to gain
    for _ in range(EXCHANGES if rows[0].lost > EXACT_LOSS else 0):
        change, cost = exchange_sums(placed, [r.v for r in now], [r.v for r in others])
        if not len(others) or change.min() >= -1e-9 * max(1.0, cost):
            break
        out, new = np.unravel_index(np.argmin(change), change.shape)
        now[out], others[new] = others[new], now[out]
    return now


def exchange_sums(placed: DataFrame, held: list, offered: list) -> tuple[np.ndarray, float]:
    """What the sum of distances of all clones gains by every exchange, and the sum now.

    Blocks of clones are judged where they lie; a row for each exchange is summed.
    """
    held, offered = np.array(held), np.array(offered).reshape(-1, np.array(held).shape[1])

    def judge(batches):
        change, cost = np.zeros((len(held), len(offered))), 0.0
        for batch in batches:
            points = batch.column(0).flatten().to_numpy().reshape(-1, held.shape[1])
            ones = np.ones(len(points))
            change += exchange_costs(points, ones, held, offered)
            cost += distances(points, held).min(axis=1).sum()
        yield pa.RecordBatch.from_arrays([pa.array([[cost, *change.ravel()]], pa.list_(pa.float64()))], ["sums"])

    sums = placed.select("v").mapInArrow(judge, "sums array<double>").select(F.posexplode("sums").alias("place", "part"))
    totals = {r.place: r.total for r in sums.groupBy("place").agg(F.sum("part").alias("total")).collect()}
    change = np.array([totals[i + 1] for i in range(held.shape[0] * len(offered))])
    return change.reshape(len(held), len(offered)), totals[0]


def medoid_clusters(
    units: DataFrame,
    timepoints: int,
    clusters: int = N_CLUSTERS,
    correlation: str = "pearson",
    custom_order: Sequence[int] | None = None,
    cells: int = MEDOID_CELLS,
) -> DataFrame:
    """Every clone with its trajectory, its ``medoid`` (a clone) and the ``distance`` to it."""
    projection = row_projection(units, timepoints, correlation)
    placed = place(units, projection)
    if projection.clones == 0:
        return no_labels(placed).select("*", F.lit(None).cast("string").alias("medoid"), F.lit(None).cast("double").alias("distance"))
    placed = materialize(placed)
    found = chosen_medoids(placed, projection, clusters, cells)
    points = np.array([r.v for r in found])
    assigned = nearest(placed, points, "cluster")
    numbers = custom_numbers(first_clones(assigned), custom_order, clusters)
    v = slots("v", projection.width)

    def of_cluster(values: Sequence[Column]) -> Column:
        return F.coalesce(*[F.when(F.col("cluster") == i, value) for i, value in enumerate(values)])

    return assigned.select(
        CLONE,
        of_cluster([F.lit(f"{TRAJ_PREFIX}{numbers[i]}") if i in numbers else F.lit(None) for i in range(len(found))]).alias(K),
        of_cluster([F.lit(r[CLONE]) for r in found]).alias("medoid"),
        F.sqrt(of_cluster([squared_distance(v, p) for p in points])).alias("distance"),
    )


def medoid_labels(
    units: DataFrame,
    timepoints: int,
    clusters: int = N_CLUSTERS,
    correlation: str = "pearson",
    custom_order: Sequence[int] | None = None,
    cells: int = MEDOID_CELLS,
) -> DataFrame:
    """Clusters around medoids; each clone goes to its nearest medoid."""
    return medoid_clusters(units, timepoints, clusters, correlation, custom_order, cells).select(CLONE, K)


def moved_centres(placed: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Means of the clones nearest to each centre; a centre without clones stays."""
    means = [F.avg(c).alias(f"m{d}") for d, c in enumerate(slots("v", centres.shape[1]))]
    out = centres.copy()
    for row in nearest(placed, centres, "cluster").groupBy("cluster").agg(*means).collect():
        out[row.cluster] = [row[f"m{d}"] for d in range(centres.shape[1])]
    return out


def principal_labels(
    units: DataFrame,
    timepoints: int,
    clusters: int = N_CLUSTERS,
    correlation: str = "pearson",
    cells: int = WARD_CELLS,
    passes: int = CONSOLIDATION_PASSES,
) -> DataFrame:
    """Ward clusters on principal components, consolidated by moving centres at most ``passes`` times.

    Centres move to the mean of all their clones; each clone goes to its nearest centre.
    Numbered by the clusters' centres on the first axis.
    """
    projection = principal_projection(units, timepoints, correlation)
    placed = place(units, projection)
    if projection.clones == 0:
        return no_labels(placed)
    placed = materialize(placed)
    means = [F.avg(c) for c in slots("v", projection.width)]
    start = ward_cells(placed, projection, clusters, cells).groupBy("cluster").agg(F.array(*means).alias("mean"))
    centres = np.array([r.mean for r in sorted(start.collect())], dtype=float)
    for _ in range(passes):
        before, centres = centres, moved_centres(placed, centres)
        if np.allclose(before, centres, rtol=0, atol=1e-12):
            break
    numbers = {int(c): i + 1 for i, c in enumerate(np.argsort(centres[:, 0], kind="stable"))}
    return named(nearest(placed, centres, "cluster"), numbers)


def peak_labels(matrix: DataFrame, timepoints: int) -> DataFrame:
    """Trajectory by the first timepoint with the largest (scaled) share."""
    number = label_of(slots("x", timepoints), range(1, timepoints + 1), largest)
    return matrix.select(CLONE, F.concat(F.lit(TRAJ_PREFIX), number.cast("string")).alias(K))


def trajectory_labels(
    units: DataFrame,
    timepoints: int,
    method: str = "hclust",
    clusters: int = N_CLUSTERS,
    correlation: str = "pearson",
    custom_order: Sequence[int] | None = None,
) -> DataFrame:
    """``clone_id`` and ``k`` by any of the methods."""
    require(units, CLONE, "x", "u")
    if method == "absolute":
        return peak_labels(units, timepoints)
    if method == "hclust":
        return ward_labels(units, timepoints, clusters, correlation, custom_order)
    if method == "pam":
        return medoid_labels(units, timepoints, clusters, correlation, custom_order)
    if method == "hcpc":
        return principal_labels(units, timepoints, clusters, correlation)
    raise ValueError(f"method must be one of {', '.join(METHODS)}")


def label_cells(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``k`` to every cell: its trajectory, ``Other``, or null for a cell without a clone."""
    marked = lookup_join(cells.drop(K), labels.select(CLONE, K), [CLONE], "left")
    name = F.when(F.col(CLONE).isNotNull(), F.coalesce(K, F.lit(OTHER)))
    return marked.withColumn(K, name)


def label_clones(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``k`` to a table with few rows per clone, ``Other`` where there is no label."""
    marked = df.drop(K).join(labels.select(CLONE, K), CLONE, "left")
    return marked.withColumn(K, F.coalesce(K, F.lit(OTHER)))


def labels_of(cells: DataFrame) -> DataFrame:
    """Distinct clone and label of cells that carry a label already."""
    return cells.filter(F.col(CLONE).isNotNull() & F.col(K).isNotNull()).select(CLONE, K).distinct()


def ordered_labels(labels: DataFrame) -> DataFrame:
    """Labelled clones without ``Other``, sorted by trajectory then clone, with their ``row`` in the heat map."""
    kept = labels.filter(F.col(K) != OTHER).select(CLONE, K).distinct()
    return ordered_rank(kept, [], [K, CLONE], rank="row").orderBy("row")


def trajectory_sizes(labels: DataFrame) -> DataFrame:
    """Clones per trajectory."""
    kept = labels.filter(F.col(K) != OTHER)
    return kept.groupBy(K).agg(F.countDistinct(CLONE).alias("n"))
