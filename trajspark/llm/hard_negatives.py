"""Hard negatives of anchors, by the threshold algorithm on sorted lists of components.

Candidates are dealt into blocks. A block keeps one list for every dimension, sorted by
that component. For an anchor the lists are read from the end that its component's sign
asks for, all to the same depth. Every row met is scored in full (integers, exact). No row
that is not yet met can score more than the threshold, the sum of anchor component times
last value read; reading stops once it falls strictly below all scores sought. Anchors are
dealt into blocks too, and every block of anchors meets every block of candidates: the best
positives of all blocks come first; their scores set the windows that the second pass
looks for negatives in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.llm.tables import written

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW_PERCENT, HIGH_PERCENT = 50, 95

CANDIDATE_ROWS = 8192
ANCHOR_ROWS = 512
#: Depth of the first reading of the lists; every further one is twice as deep.
FIRST_DEPTH = 32
#: Scaled components beyond it count as it, so that scores stay within 64 bits.
LARGEST = 1 << 26
#: Scores of up to this size are exact as doubles.
EXACT = 1 << 53


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """``row``, ``vec_id``, ``label`` and scaled integer components ``v`` of the rows that take part."""
    value = F.col("embedding").cast("array<double>")
    broken = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform(value, lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)))
    known = vectors.filter(F.col("vec_id").isNotNull() & label.isNotNull() & F.col("embedding").isNotNull() & ~broken)
    return known.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("bigint").alias("vec_id"),
        label.cast("bigint").alias("label"),
        whole.alias("v"),
    )


class Lists:
    """A block of candidates with its sorted lists."""

    def __init__(self, v: np.ndarray):
        self.rows = v
        self.order = np.ascontiguousarray(np.argsort(v, axis=0, kind="stable").T.astype(np.int32))
        self.value = np.ascontiguousarray(np.take_along_axis(v.T, self.order, axis=1))

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Rows newly met, their scores, and the threshold for all others, from one depth to the next."""
        total = len(self.rows)
        rising, falling = np.flatnonzero(anchor < 0), np.flatnonzero(anchor > 0)
        seen = np.zeros(total, dtype=bool)
        met, depth, to = 0, 0, min(FIRST_DEPTH, total)
        while met < total:
            fresh = np.zeros(total, dtype=bool)
            fresh[self.order[falling, total - to : total - depth]] = True
            fresh[self.order[rising, depth:to]] = True
            if not len(rising) and not len(falling):
                fresh[:] = True  # all scores are zero
            rows = np.flatnonzero(fresh & ~seen)
            seen[rows] = True
            met += len(rows)
            threshold = anchor[falling] @ self.value[falling, total - to] + anchor[rising] @ self.value[rising, to - 1]
            yield rows, self.rows[rows] @ anchor, -np.inf if met == total else threshold
            depth, to = to, min(2 * to, total)


def _vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Components as rows of ``width``, those of shorter vectors filled up with zeros."""
    lists = column.combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), width), dtype=np.int64)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), at] = lists.flatten().to_numpy()
    return out


def _block(candidates: pa.Table, anchors: pa.Table) -> tuple[Lists, np.ndarray]:
    """Lists of the candidates, and the anchors' vectors, as numbers whose scores are exact."""
    width = max([0, *(int(max(t.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))) for t in (candidates, anchors))])
    x, a = _vectors(candidates.column("v"), width), _vectors(anchors.column("v"), width)
    largest = int(np.abs(x).max(initial=0)) * int(np.abs(a).max(initial=0)) * width
    if largest <= EXACT:
        x, a = x.astype(np.float64), a.astype(np.float64)
    return Lists(x), a


def _best(score: np.ndarray, names: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` highest scores, ties by name."""
    if len(score) > 8 * count:
        places = np.flatnonzero(score >= np.partition(score, len(score) - count)[len(score) - count])
    else:
        places = np.arange(len(score))
    return places[np.lexsort((names[places], -score[places]))][:count]


def _last(score: np.ndarray, count: int) -> float:
    """The lowest of the ``count`` highest scores; below all while there are fewer."""
    return np.partition(score, len(score) - count)[len(score) - count] if len(score) >= count else -np.inf


def _positives(count: int):
    """Best rows of each anchor's label in a block."""

    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if candidates.num_rows and anchors.num_rows:
            lists, vectors = _block(candidates, anchors)
            names, label = candidates.column("vec_id").to_numpy(), candidates.column("label").to_numpy()
            keys = zip(*(anchors.column(c).to_pylist() for c in ("row", "vec_id", "label")))
            for (row, name, own), anchor in zip(keys, vectors):
                same = (label == own) & (names != name)
                rows, score = np.zeros(0, dtype=np.int64), np.zeros(0)
                for fresh, value, threshold in lists.read(anchor):
                    wanted = same[fresh]
                    rows, score = np.append(rows, fresh[wanted]), np.append(score, value[wanted])
                    if threshold < _last(score, count):
                        break
                best = _best(score, names[rows], count)
                out += [(row, int(n), int(s)) for n, s in zip(names[rows[best]], score[best])]
        return _table(out, ["row", "positive_id", "positive_score"])

    return run


def _negatives(count: int, low: int, high: int):
    """Best rows of other labels in each window of an anchor, in a block."""

    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if candidates.num_rows and anchors.num_rows:
            lists, vectors = _block(candidates, anchors)
            names, label = candidates.column("vec_id").to_numpy(), candidates.column("label").to_numpy()
            keys = zip(*(anchors.column(c).to_pylist() for c in ("row", "label", "scores")))
            for (row, own, scores), anchor in zip(keys, vectors):
                # 100 * negative from low * positive to high * positive, in whole numbers
                windows = [(i, -(-low * p // 100), high * p // 100) for i, p in enumerate(scores)]
                windows = [w for w in windows if w[1] <= w[2]]
                least = min((w[1] for w in windows), default=0)
                rows, score = np.zeros(0, dtype=np.int64), np.zeros(0)
                for fresh, value, threshold in lists.read(anchor) if windows else ():
                    wanted = (label[fresh] != own) & (value >= least)
                    rows, score = np.append(rows, fresh[wanted]), np.append(score, value[wanted])
                    if all(threshold < max(_last(_within(score, a, b), count), a) for _, a, b in windows):
                        break
                for i, a, b in windows:
                    inside = np.flatnonzero((score >= a) & (score <= b))
                    best = inside[_best(score[inside], names[rows[inside]], count)]
                    out += [(row, i, int(n), int(s)) for n, s in zip(names[rows[best]], score[best])]
        return _table(out, ["row", "place", "negative_id", "negative_score"])

    return run


def _within(score: np.ndarray, low: int, high: int) -> np.ndarray:
    return score[(score >= low) & (score <= high)]


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


def _dealt(rows: DataFrame, name: str, size: int, count: int) -> tuple[DataFrame, int]:
    """``rows`` with their block ``name``, blocks having about ``size`` rows."""
    blocks = max(1, -(-count // size))
    return rows.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), blocks


def _meet(candidates: DataFrame, anchors: DataFrame, blocks: tuple[int, int], function, schema: str) -> DataFrame:
    """Apply ``function`` to every block of candidates with every block of anchors."""
    here, there = blocks
    each = F.explode(F.sequence(F.lit(0), F.lit(there - 1))).alias("ab")
    other = F.explode(F.sequence(F.lit(0), F.lit(here - 1))).alias("cb")
    left = candidates.select("*", each).groupBy("cb", "ab")
    # new names for columns that both sides have from one table
    right = anchors.toDF(*anchors.columns).select("*", other).groupBy("cb", "ab")
    return left.cogroup(right).applyInArrow(function, schema)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW_PERCENT,
    high: int = HIGH_PERCENT,
    candidate_rows: int = CANDIDATE_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label`` (or the expression ``label``);
    ``is_anchor`` is a condition on ``vec_id``. Scores are inner products of the components'
    ``floor(256 * x)``; equal ones are ranked by ``vec_id``. The positives of an anchor are its
    best rows of the same label; its negatives for one are the best rows of other labels
    whose score is ``low`` to ``high`` percent of the positive's.

    Rows without ``vec_id``, label or vector, or with a null or non-finite component, take no
    part. Shorter vectors count as filled up with zeros, components beyond 2**18 as that.
    Repeated rows count each, as candidates and as anchors; rows with the anchor's own
    ``vec_id`` are none of its positives. An anchor without positives or negatives gives no
    rows, and so does an empty table. Other columns are ignored.
    """
    rows = written(usable(vectors, F.col("label") if label is None else label), "scaled")
    total = rows.count()
    chosen = rows.filter(is_anchor)
    candidates, here = _dealt(rows, "cb", candidate_rows, total)
    anchors, there = _dealt(chosen, "ab", anchor_rows, chosen.count())
    met = _meet(candidates, anchors, (here, there), _positives(positives), "row bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    best = met.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < positives)
    best = written(best.select("row", F.col("place").cast("bigint").alias("place"), "positive_id", "positive_score"), "positives")

    listed = F.array_sort(F.collect_list(F.struct("place", "positive_score")))
    windows = best.groupBy("row").agg(F.transform(listed, lambda w: w["positive_score"]).alias("scores"))
    asked = anchors.join(windows, "row").select("row", "label", "v", "ab", "scores")
    schema = "row bigint, place bigint, negative_id bigint, negative_score bigint"
    found = _meet(candidates, asked, (here, there), _negatives(negatives, low, high), schema)
    order = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = best.join(chosen.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return ranked.join(named, ["row", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
