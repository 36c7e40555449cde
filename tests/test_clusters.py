"""Correlations and clusterings against plain computations on the explicit matrix."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajspark.functions import partition
from trajspark.functions.profiles import profile_width
from trajspark.operators import cells, cluster, vectors

METHODS = ("pearson", "spearman", "kendall")


def random_profiles(n, width=4, seed=1, ties=False):
    rng = np.random.default_rng(seed)
    shapes = rng.normal(size=(5, width)) * 2
    x = shapes[rng.integers(0, 5, n)] + rng.normal(size=(n, width))
    return np.round(x) if ties else x


def as_matrix(spark, x):
    rows = [(f"c{i:05d}", [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "clone_id string, x array<double>")


def explicit_correlation(x, method):
    return pd.DataFrame(np.asarray(x).T).corr(method=method if method != "kendall" else tau_b).to_numpy()


def tau_b(a, b):
    i, j = np.triu_indices(len(a), 1)
    da, db = np.sign(a[i] - a[j]), np.sign(b[i] - b[j])
    return (da * db).sum() / np.sqrt((da**2).sum() * (db**2).sum())


def row_distances(m):
    return np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2))


def plain_ward(distance, k):
    """Lance-Williams updates on squared distances, always joining the closest pair, the first of equal ones."""
    d = distance**2
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, member = np.ones(n), [{i} for i in range(n)]
    alive = set(range(n))
    while len(alive) > k:
        a, b = np.unravel_index(np.argmin(np.round(d / n, 9)), d.shape)
        for c in alive - {a, b}:
            s = size[a] + size[b] + size[c]
            d[a, c] = d[c, a] = ((size[a] + size[c]) * d[a, c] + (size[b] + size[c]) * d[b, c] - size[c] * d[a, b]) / s
        size[a] += size[b]
        member[a] |= member[b]
        d[b, :] = d[:, b] = np.inf
        alive.remove(b)
    return {frozenset(member[i]) for i in alive}


def groups(labels):
    out = {}
    for row in labels.collect():
        out.setdefault(row.k, set()).add(int(row.clone_id[1:]))
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("method", METHODS)
def test_unit_vectors_give_correlations(spark, method):
    x = random_profiles(60, ties=True)
    x = x[x.max(axis=1) > x.min(axis=1)]
    units = vectors.unit_vectors(as_matrix(spark, x), 4, method).orderBy("clone_id").collect()
    u = np.array([r.u for r in units])
    assert u.shape[1] == profile_width(method, 4)
    np.testing.assert_allclose(u @ u.T, explicit_correlation(x, method), atol=1e-12)


@pytest.mark.parametrize("method", METHODS)
def test_projection_keeps_row_distances(spark, method):
    x = random_profiles(50)
    units = vectors.unit_vectors(as_matrix(spark, x), 4, method)
    projection = vectors.row_projection(units, 4, method)
    placed = np.array([r.v for r in cluster.place(units, projection).orderBy("clone_id").collect()])
    np.testing.assert_allclose(row_distances(placed), row_distances(explicit_correlation(x, method)), atol=1e-9)
    got = {r.clone_id: r.mean_sq_dist for r in vectors.row_distances(units, projection).collect()}
    want = (row_distances(explicit_correlation(x, method)) ** 2).mean(axis=1)
    np.testing.assert_allclose([got[c] for c in sorted(got)], want, atol=1e-9)


@pytest.mark.parametrize("method", METHODS)
def test_ward_equals_plain_ward(spark, method):
    x = random_profiles(90, width=5)
    units = vectors.unit_vectors(as_matrix(spark, x), 5, method)
    want = plain_ward(row_distances(explicit_correlation(x, method)), 4)
    assert groups(cluster.ward_labels(units, 5, 4, method)) == want


def test_ward_with_equal_clones(spark):
    x = np.repeat(random_profiles(25, seed=3), 3, axis=0)
    units = vectors.unit_vectors(as_matrix(spark, x), 4)
    want = plain_ward(row_distances(explicit_correlation(x, "pearson")), 4)
    assert groups(cluster.ward_labels(units, 4, 4)) == want


def test_numbers_follow_first_clone_and_custom_order(spark):
    up, down, middle = [0.0, 1, 2, 9], [9.0, 2, 1, 0], [0.0, 9, 1, 0]
    x = [down, up, middle] * 4
    x = [[v + 0.01 * i for v in row] for i, row in enumerate(x)] + [[1.0, 1, 1, 1]]
    units = vectors.unit_vectors(as_matrix(spark, x), 4)
    labels = {r.clone_id: r.k for r in cluster.ward_labels(units, 4, 3).collect()}
    assert [labels[f"c0000{i}"] for i in range(3)] == ["Traj 1", "Traj 2", "Traj 3"]
    assert "c00012" not in labels
    cells = units.select("clone_id").withColumn("barcode", F.col("clone_id"))
    named = {r.clone_id: r.k for r in cluster.label_cells(cells, cluster.ward_labels(units, 4, 3)).collect()}
    assert named["c00012"] == "Other"
    for method in (cluster.ward_labels, cluster.medoid_labels):
        moved = {r.clone_id: r.k for r in method(units, 4, 3, custom_order=[3, 1, 2]).collect()}
        # cluster 3 comes first, then 1, then 2
        assert [moved[f"c0000{i}"] for i in range(3)] == ["Traj 2", "Traj 3", "Traj 1"]
        kept = {r.clone_id: r.k for r in method(units, 4, 3, custom_order=[1, 2]).collect()}
        assert kept == labels
    relabelled = {r.clone_id: r.k for r in cluster.relabel(cluster.ward_labels(units, 4, 3), [3, 1, 2], 3).collect()}
    assert relabelled["c00000"] == "Traj 2" and set(relabelled) == set(labels)
    incomplete = {r.clone_id: r.k for r in cluster.relabel(cluster.ward_labels(units, 4, 3), [3, 1], 3).collect()}
    assert incomplete == labels
    principal = groups(cluster.principal_labels(units, 4, 3))
    assert principal == {frozenset(range(i, 12, 3)) for i in range(3)}
    sizes = {r.k: r.n for r in cluster.trajectory_sizes(cluster.ward_labels(units, 4, 3)).collect()}
    assert sizes == {"Traj 1": 4, "Traj 2": 4, "Traj 3": 4}


def medoid_cost(distance, chosen):
    return distance[:, chosen].min(axis=1).sum()


def test_medoids_cannot_be_improved_by_an_exchange(spark):
    x = random_profiles(70)
    m = explicit_correlation(x, "pearson")
    d = row_distances(m)
    units = vectors.unit_vectors(as_matrix(spark, x), 4)
    found = groups(cluster.medoid_labels(units, 4, 4))
    centres = [min(g, key=lambda i: d[i, sorted(g)].sum()) for g in found]
    cost = medoid_cost(d, centres)
    best = min(
        medoid_cost(d, [*(c for c in centres if c != out), new]) for out in centres for new in range(len(x))
    )
    assert cost <= best + 1e-9
    nearest = {c: {i for i in range(len(x)) if d[i, centres].argmin() == j} for j, c in enumerate(centres)}
    assert {frozenset(v) for v in nearest.values()} == found


def test_principal_axes_match_the_standardised_matrix(spark):
    x = random_profiles(60)
    m = explicit_correlation(x, "pearson")
    z = (m - m.mean(axis=0)) / m.std(axis=0)
    units = vectors.unit_vectors(as_matrix(spark, x), 4)
    projection = vectors.principal_projection(units, 4)
    placed = np.array([r.v for r in cluster.place(units, projection).orderBy("clone_id").collect()])
    np.testing.assert_allclose(row_distances(placed), row_distances(z), atol=1e-8)
    np.testing.assert_allclose(placed.mean(axis=0), 0, atol=1e-9)
    left, _, right = np.linalg.svd(z, full_matrices=False)
    axis = z @ right[0]
    axis = axis if right[0].sum() > 0 else -axis
    np.testing.assert_allclose(placed[:, 0], axis, atol=1e-8)


def placed_points(spark, x, project=vectors.row_projection):
    """Clones with ``v``, the projection, and all ``v`` in the order of the clones."""
    units = vectors.unit_vectors(as_matrix(spark, x), x.shape[1])
    projection = project(units, x.shape[1])
    rows = cluster.place(units, projection).orderBy("clone_id").collect()
    return units, projection, np.array([r.v for r in rows])


def squares(points, sets):
    return sum(((points[sorted(s)] - points[sorted(s)].mean(axis=0)) ** 2).sum() for s in sets)


@pytest.mark.parametrize("limit", [1, 7, 200])
def test_cells_are_few_and_keep_the_squares(spark, limit):
    x = random_profiles(3000, seed=5)
    units, projection, points = placed_points(spark, x)
    gridded, fine = cells.in_grid(cluster.place(units, projection), projection.width, len(x), cells=1000)
    assert 300 < fine.count() <= 1000
    found = cells.clustered(fine, projection.width, limit)
    leaf = {r.clone_id: r.leaf for r in cells.with_cell(gridded, found, "leaf").collect()}
    assert len(leaf) == len(x) and len(set(leaf.values())) <= limit
    sets = {}
    for clone, at in leaf.items():
        sets.setdefault(at, set()).add(int(clone[1:]))
    total = ((points - points.mean(axis=0)) ** 2).sum()
    assert found.first().lost == pytest.approx(squares(points, sets.values()) / total, abs=1e-9)
    standing = cells.representatives(gridded, found, projection.width).collect()
    assert sum(r.weight for r in standing) == len(x) and len(standing) == len(sets)


def test_ward_is_exact_for_thousands_of_clones(spark):
    x = random_profiles(2500, seed=6)
    units, _, points = placed_points(spark, x)
    label = partition.ward(points, np.ones(len(points)), 6)
    want = {frozenset(np.flatnonzero(label == k).tolist()) for k in range(6)}
    assert groups(cluster.ward_labels(units, 4, 6)) == want
    loss = cluster.ward_loss(units, 4, 6).first()
    assert loss.clones == 2500 and loss.lost == pytest.approx(0, abs=1e-12)
    assert loss.within == pytest.approx(squares(points, want) / ((points - points.mean(axis=0)) ** 2).sum())


def test_ward_of_many_clones_loses_little(spark):
    x = random_profiles(6000, seed=7)
    units, _, points = placed_points(spark, x)
    label = partition.ward(points, np.ones(len(points)), 6)
    exact = squares(points, [np.flatnonzero(label == k).tolist() for k in range(6)])
    loss = cluster.ward_loss(units, 4, 6, cells=500).first()
    assert 0 < loss.lost < 0.01
    total = ((points - points.mean(axis=0)) ** 2).sum()
    assert loss.within * total < 1.1 * exact


def plain_medoid_cost(points, k):
    chosen = partition.medoids(points, np.ones(len(points)), k)
    return partition.distances(points, points[chosen]).min(axis=1).sum()


@pytest.mark.parametrize("few", [2500, 200])
def test_medoids_are_clones_and_cost_little_more(spark, few):
    x = random_profiles(2500, seed=8)
    units, _, points = placed_points(spark, x)
    rows = cluster.medoid_clusters(units, 4, 6, cells=few).collect()
    assert len(rows) == 2500 and len({r.medoid for r in rows}) == 6
    held = points[[int(m[1:]) for m in sorted({r.medoid for r in rows})]]
    gaps = partition.distances(points, held)
    assert [r.distance for r in sorted(rows)] == pytest.approx(gaps.min(axis=1).tolist(), abs=1e-9)
    assert {r.medoid for r in rows if r.distance < 1e-9} == {r.medoid for r in rows}
    limit = 1.01 if few < 2500 else 1 + 1e-9
    assert gaps.min(axis=1).sum() <= limit * plain_medoid_cost(points, 6)


def test_exchanges_are_judged_by_all_clones(spark):
    points = np.random.default_rng(3).normal(size=(300, 3))
    placed = spark.createDataFrame([(f"c{i:05d}", p.tolist()) for i, p in enumerate(points)], "clone_id string, v array<double>")
    change, cost = cluster.exchange_sums(placed.repartition(5), points[:3].tolist(), points[3:9].tolist())
    assert cost == pytest.approx(partition.distances(points, points[:3]).min(axis=1).sum())
    for out in range(3):
        for new in range(6):
            held = [*points[[i for i in range(3) if i != out]], points[3 + new]]
            want = partition.distances(points, np.array(held)).min(axis=1).sum() - cost
            assert change[out, new] == pytest.approx(want, abs=1e-9)


def test_principal_clones_go_to_their_nearest_centre(spark):
    x = random_profiles(3000, seed=9)
    units, _, points = placed_points(spark, x, vectors.principal_projection)
    found = cluster.principal_labels(units, 4, 5, cells=100, passes=200)
    sets = groups(found)
    centres = np.array([points[sorted(s)].mean(axis=0) for s in sets])
    nearest = partition.distances(points, centres).argmin(axis=1)
    assert {frozenset(np.flatnonzero(nearest == i).tolist()) for i in range(5)} == sets


@pytest.mark.parametrize("labels", [cluster.ward_labels, cluster.medoid_labels, cluster.principal_labels])
def test_result_does_not_depend_on_partitions(spark, labels):
    x = random_profiles(400, seed=6)
    units = vectors.unit_vectors(as_matrix(spark, x), 4)
    once = sorted(labels(units.repartition(2), 4, 5, cells=60).collect())
    again = sorted(labels(units.repartition(9), 4, 5, cells=60).collect())
    assert once == again


def test_fewer_clones_than_clusters(spark):
    units = vectors.unit_vectors(as_matrix(spark, [[0.0, 1, 2, 3], [3.0, 1, 0, 0]]), 4)
    for method in ("hclust", "pam", "hcpc"):
        labels = cluster.trajectory_labels(units, 4, method, 6)
        assert {r.k for r in labels.collect()} == {"Traj 1", "Traj 2"}


def test_no_defined_clone(spark):
    units = vectors.unit_vectors(as_matrix(spark, [[1.0, 1, 1, 1]]), 4)
    for method in ("hclust", "pam", "hcpc"):
        assert cluster.trajectory_labels(units, 4, method).count() == 0
    with pytest.raises(ValueError):
        cluster.trajectory_labels(units, 4, "other")


def test_peak_timepoint_takes_the_first_tie(spark):
    labels = cluster.peak_labels(as_matrix(spark, [[1.0, 3, 3, 0], [0.0, 0, 0, 1]]), 4)
    assert {r.clone_id: r.k for r in labels.collect()} == {"c00000": "Traj 2", "c00001": "Traj 4"}


def test_scaling_of_a_constant_timepoint(spark):
    scaled = vectors.scaled_matrix(as_matrix(spark, [[5.0, 1], [5.0, 3]]), 2).orderBy("clone_id").collect()
    assert [r.x[0] for r in scaled] == [0.0, 0.0]
    assert scaled[1].x[1] == pytest.approx(1 / np.sqrt(2))


def test_block_means_and_rows(spark):
    x = random_profiles(40)
    m = explicit_correlation(x, "pearson")
    units = vectors.unit_vectors(as_matrix(spark, x), 4)
    labels = cluster.ward_labels(units, 4, 3)
    k = np.array([r.k for r in labels.orderBy("clone_id").collect()])
    for row in vectors.block_means(units, labels, 4).collect():
        assert row.mean_cor == pytest.approx(m[np.ix_(k == row.k, k == row.k_other)].mean())
    for row in vectors.mean_correlations(units, labels, 4).collect():
        assert row.mean_cor == pytest.approx(m[int(row.clone_id[1:]), k == row.k].mean())
    anchors = labels.filter("clone_id in ('c00003', 'c00017')")
    rows = vectors.anchor_correlations(units, anchors, 4).collect()
    assert len(rows) == 80
    for row in rows:
        assert row.cor == pytest.approx(m[int(row.clone_id[1:]), int(row.anchor_id[1:])])


def test_weighted_ward_equals_repeated_points():
    rng = np.random.default_rng(2)
    points, weights = rng.normal(size=(30, 3)), rng.integers(1, 5, 30)
    few = partition.ward(points, weights, 5)
    repeated = np.repeat(np.arange(30), weights)
    many = partition.ward(points[repeated], np.ones(len(repeated)), 5)
    pairs = {(few[i], c) for i, c in zip(repeated, many)}
    assert len(pairs) == 5


def test_anchors_of_any_number(spark):
    x = random_profiles(1500, seed=8)
    units = vectors.unit_vectors(as_matrix(spark, x), 4)
    got = vectors.anchor_correlations(units, units.select("clone_id"), 4)
    assert got.count() == 1500 * 1500
    row = got.filter("clone_id = 'c00007' and anchor_id = 'c01400'").first()
    assert row.cor == pytest.approx(np.corrcoef(x[7], x[1400])[0, 1])


@pytest.mark.parametrize("method, least", [("pearson", 0.9), ("pearson", 0.3), ("spearman", 0.99), ("kendall", 1.0)])
def test_correlated_profiles_equal_all_pairs(spark, method, least):
    x = random_profiles(150, seed=4, ties=True)
    x = np.concatenate([x, np.repeat(x[:1], 60, axis=0), -x[:20]])
    x = x[x.max(axis=1) > x.min(axis=1)]
    units = vectors.unit_vectors(as_matrix(spark, x), 4, method)
    width = profile_width(method, 4)
    least -= 1e-9
    m = explicit_correlation(x, method)
    profile = {r.clone_id: r.profile for r in vectors.profile_members(units).collect()}
    assert len(profile) == len(x)
    names = [f"c{i:05d}" for i in range(len(x))]
    want = {
        (names[i], names[j])
        for i in range(len(x))
        for j in range(i + 1, len(x))
        if abs(m[i, j]) >= least and profile[names[i]] != profile[names[j]]
    }
    got = {}
    members = {}
    for clone, of in profile.items():
        members.setdefault(of, []).append(clone)
    rows = vectors.correlated_profiles(units, width, least).collect()
    for r in rows:
        assert (r.clones, r.others) == (len(members[r.clone_id]), len(members[r.other_id]))
        assert r.cor == pytest.approx(m[int(r.clone_id[1:]), int(r.other_id[1:])])
        got |= {tuple(sorted((a, b))): r.cor for a in members[r.clone_id] for b in members[r.other_id]}
    assert set(got) == want and len(rows) == len({(r.clone_id, r.other_id) for r in rows})


def test_heat_map_rows(spark):
    labels = spark.createDataFrame([("b", "Traj 2"), ("a", "Traj 2"), ("c", "Traj 1"), ("d", "Other")], "clone_id string, k string")
    rows = cluster.ordered_labels(labels).collect()
    assert [(r.row, r.clone_id, r.k) for r in rows] == [(1, "c", "Traj 1"), (2, "a", "Traj 2"), (3, "b", "Traj 2")]


def test_row_distances_without_defined_clones(spark):
    for x in (np.zeros((0, 4)), np.ones((3, 4))):
        units = vectors.unit_vectors(as_matrix(spark, x), 4)
        found = vectors.row_distances(units, vectors.row_projection(units, 4))
        assert found.dtypes == [("clone_id", "string"), ("mean_sq_dist", "double")] and found.collect() == []


def test_ward_loss_without_defined_clones(spark):
    types = cluster.ward_loss(vectors.unit_vectors(as_matrix(spark, random_profiles(9)), 4), 4).dtypes
    for x in (np.zeros((0, 4)), np.ones((3, 4))):
        found = cluster.ward_loss(vectors.unit_vectors(as_matrix(spark, x), 4), 4)
        assert found.dtypes == types and [tuple(r) for r in found.collect()] == [(None, 0.0, None)]
