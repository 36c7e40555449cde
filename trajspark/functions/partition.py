"""Clustering of a bounded number of weighted points, within one task.

The points are cells that stand for all clones. Their number is bounded, whatever the
number of clones is.
"""

from __future__ import annotations

import numpy as np


#: Costs of joins, as a share of the number of clones, count as equal when they agree in so many places.
TIE_PLACES = 9


def ward(points: np.ndarray, weights: np.ndarray, clusters: int) -> np.ndarray:
    """Cluster of each point after Ward linkage, cut into ``clusters`` groups.

    Joining clusters ``a`` and ``b`` costs ``2 w_a w_b / (w_a + w_b) |c_a - c_b|^2``,
    the squared Ward.D2 height, so only centres and weights are kept. The least costly join
    is made until few enough are left; of equal costs the one whose clusters have the first
    points. Every cluster keeps its best partner among those after it; a join makes few of
    them look again.
    """
    count, total = len(points), float(weights.sum())
    name = np.arange(count)
    group = np.arange(count)
    centre, weight = points.astype(float).copy(), weights.astype(float).copy()
    open_ = np.ones(count, dtype=bool)

    def costs(i: int, others: slice | np.ndarray) -> np.ndarray:
        gap = np.zeros(len(weight[others]))
        for d in range(centre.shape[1]):
            gap += (centre[others, d] - centre[i, d]) ** 2
        cost = np.round(2 * weight[others] * weight[i] / (weight[others] + weight[i]) * gap / total, TIE_PLACES)
        cost[~open_[others]] = np.inf
        return cost

    def look(i: int) -> None:
        cost = costs(i, slice(i + 1, None))
        if len(cost):
            partner[i] = i + 1 + np.argmin(cost)
            least[i] = cost[partner[i] - i - 1]
        else:
            least[i] = np.inf

    least, partner = np.full(count, np.inf), np.zeros(count, dtype=np.int64)
    for i in range(count):
        look(i)
    left = count
    while left > clusters:
        a = int(np.argmin(least))
        b = int(partner[a])
        both = weight[a] + weight[b]
        centre[a] = (weight[a] * centre[a] + weight[b] * centre[b]) / both
        weight[a] = both
        open_[b], least[b] = False, np.inf
        group[name[b]] = name[a]
        left -= 1
        again = np.flatnonzero(open_[:b] & ((partner[:b] == a) | (partner[:b] == b)))
        near = costs(a, slice(0, a))
        better = (near < least[:a]) | ((near == least[:a]) & (a < partner[:a]))
        least[:a][better], partner[:a][better] = near[better], a
        for i in {a, *again.tolist()}:
            look(i)
        if 2 * left < len(name):
            # clusters that were joined into others leave the arrays
            at = np.cumsum(open_) - 1
            partner = at[partner[open_]]
            name, centre, weight, least = name[open_], centre[open_], weight[open_], least[open_]
            open_ = np.ones(left, dtype=bool)

    while (group[group] != group).any():
        group = group[group]
    return np.unique(group, return_inverse=True)[1]


def medoids(points: np.ndarray, weights: np.ndarray, clusters: int, block: int = 256) -> np.ndarray:
    """Indices of the points that partition all points around medoids at least cost.

    Medoids are added greedily, then the best exchange of a medoid and another point is
    made until none lowers the weighted sum of distances. Distances are computed anew in
    blocks of rows, so memory grows with the points, not with their pairs.
    """
    total = len(points)
    count = min(clusters, total)
    blocks = [slice(i, i + block) for i in range(0, total, block)]
    nearest = np.full(total, np.inf)
    chosen: list[int] = []
    while len(chosen) < count:
        gain = np.zeros(total)
        for rows in blocks:
            distance = distances(points[rows], points)
            if chosen:
                gain += weights[rows] @ np.maximum(nearest[rows, None] - distance, 0)
            else:
                gain -= weights[rows] @ distance
        gain[chosen] = -np.inf
        chosen.append(int(np.argmax(gain)))
        nearest = np.minimum(nearest, distances(points[chosen[-1:]], points)[0])
    while total > count:
        change = exchange_costs(points, weights, points[chosen], points, block)
        nearest = distances(points, points[chosen]).min(axis=1)
        change[:, chosen] = np.inf
        out, new = np.unravel_index(np.argmin(change), change.shape)
        if change[out, new] >= -1e-9 * max(1.0, float(weights @ nearest)):
            break
        chosen[out] = int(new)
    return np.array(chosen)


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distance of every point to every other."""
    out = np.zeros((len(points), len(others)))
    for d in range(points.shape[1]):
        out += (points[:, d][:, None] - others[None, :, d]) ** 2
    return np.sqrt(out)


def exchange_costs(
    points: np.ndarray, weights: np.ndarray, held: np.ndarray, offered: np.ndarray, block: int = 256
) -> np.ndarray:
    """Change of the weighted sum of distances to the nearest medoid, for every medoid held and point offered."""
    change = np.zeros((len(held), len(offered)))
    for at in range(0, len(points), block):
        here, weight = points[at : at + block], weights[at : at + block]
        to_held = distances(here, held)
        order = np.argsort(to_held, axis=1, kind="stable")
        rows = np.arange(len(here))
        nearest = to_held[rows, order[:, 0]]
        second = to_held[rows, order[:, 1]] if len(held) > 1 else np.full(len(here), np.inf)
        owner = np.zeros((len(held), len(here)))
        owner[order[:, 0], rows] = weight
        distance = distances(here, offered)
        closer = np.minimum(distance - nearest[:, None], 0)
        after_loss = np.minimum(distance, second[:, None]) - nearest[:, None]
        change += (weight @ closer)[None, :] + owner @ (after_loss - closer)
    return change
