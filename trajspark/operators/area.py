"""Tables behind the abundance charts: stacked shares by trajectory, treatment, response, patient."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.names import is_listed, trajectory_number
from trajspark.functions.slots import slots, total
from trajspark.operators.abundance import clone_stats
from trajspark.operators.joins import lookup_join
from trajspark.operators.ordering import ordered_rank
from trajspark.operators.selection import on_allowlist
from trajspark.session import materialize
from trajspark.schema import CLONE, K, OTHER, PATIENT, RESPONSE, TIMEPOINT, TRB_AA, TREATMENT, present, require

# The response groups and the week whose rows carry labels.
RESPONSE_GROUPS = {"CR": "R", "PR": "R", "SD": "NR", "PD": "NR"}
LABEL_WEEK = 3


def labelled(df: DataFrame) -> DataFrame:
    require(df, K)
    return df.filter(F.col(K) != OTHER)


def drop_last_trajectory(df: DataFrame) -> DataFrame:
    """Drop the trajectory with the highest number; ``Other`` stays."""
    last = df.agg(F.max(trajectory_number())).scalar()
    return df.filter(F.coalesce(trajectory_number() < last, F.lit(True)))


def ranked_clones(clones: DataFrame, running: Mapping[str, str] | None = None) -> DataFrame:
    """Labelled clones with ``clone_rank``, their place by size within the trajectory, and running sums."""
    return ordered_rank(labelled(clones), [K], ["n_max", CLONE], rank="clone_rank", running=running)


def stacked_clones(clones: DataFrame, running: Mapping[str, str] | None = None) -> DataFrame:
    """``ranked_clones`` with ``clone_ord``, the place over all trajectories."""
    ranked = materialize(ranked_clones(clones, running))
    # one row per trajectory, so the window without partitions is small
    sizes = ranked.groupBy(K).agg(F.max("clone_rank").alias("_size"))
    earlier = Window.orderBy(trajectory_number(), K).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(K, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    placed = lookup_join(ranked, offsets, [K], "inner")
    return placed.withColumn("clone_ord", F.col("_before") + F.col("clone_rank")).drop("_before")


def long_shares(clones: DataFrame, timepoints: Sequence[int], extra: Sequence[str] = ()) -> DataFrame:
    """Long rows of ranked clones, with ``rank_cl``, the row's place by size in its trajectory."""
    rows = clone_stats(clones, timepoints, [*present(clones, ["clone_rank", "clone_ord"]), *extra])
    place = F.array_position(F.array(*[F.lit(t) for t in timepoints]), F.col(TIMEPOINT))
    return rows.withColumn("rank_cl", (F.col("clone_rank") - 1) * len(timepoints) + place)


def area_base(clones: DataFrame, timepoints: Sequence[int]) -> DataFrame:
    """Labelled long rows with a share, ranked by size and with the stacking order of clones."""
    return long_shares(stacked_clones(clones), timepoints).filter(F.col("perc").isNotNull())


def rank_by_column(rows: DataFrame, column: str) -> DataFrame:
    """Rank by size within the column's value and clone; a clone has few rows."""
    require(rows, column, CLONE, "n_max", TIMEPOINT)
    w = Window.partitionBy(column, CLONE).orderBy("n_max", TIMEPOINT)
    return rows.withColumn("rank_cl", F.row_number().over(w).cast("bigint"))


def order_by_column(clones: DataFrame, column: str) -> DataFrame:
    """``stacked_clones`` in the order of another column first; nulls last."""
    require(clones, column)
    stacked = stacked_clones(clones).withColumnRenamed("clone_ord", "_ord")
    marked = stacked.withColumn("_null", F.col(column).isNull())
    # each clone has one row, so ordering by clones orders their long rows too
    return ordered_rank(marked, [], ["_null", column, "_ord"], rank="clone_ord").drop("_null", "_ord")


def recode_response(df: DataFrame) -> DataFrame:
    """Responders and non-responders; rows without a response are dropped."""
    require(df, RESPONSE)
    entries = [F.lit(x) for pair in RESPONSE_GROUPS.items() for x in pair]
    group = F.coalesce(F.try_element_at(F.create_map(*entries), F.col(RESPONSE)), F.col(RESPONSE))
    return df.filter(F.col(RESPONSE).isNotNull()).withColumn(RESPONSE, group)


def patients_per_treatment(clones: DataFrame) -> DataFrame:
    """Per treatment, its patients and the factor that scales it to the smallest treatment."""
    counted = clones.groupBy(TREATMENT).agg(F.countDistinct(PATIENT).alias("npatients"))
    fewest = counted.agg(F.min("npatients")).scalar()
    return counted.select(TREATMENT, "npatients", (fewest / F.col("npatients")).alias("_scale"))


def filter_clones(
    clones: DataFrame,
    selected: Sequence[str] | None = None,
    drop_null: str | None = None,
    values: tuple[str, Sequence] | None = None,
    allowlist: DataFrame | None = None,
    patient: str | None = None,
    tcrb: Sequence[str] | None = None,
) -> DataFrame:
    """The filters of the charts, applied to clone rows before anything is summed.

    ``selected`` keeps trajectories, ``drop_null`` names a column that must have a value,
    ``values`` is a column and the values to keep, ``allowlist`` a table of patients and
    TRB sequences, ``patient`` and ``tcrb`` keep one patient and listed TRB sequences.
    """
    out = clones
    if selected is not None:
        out = out.filter(is_listed(K, selected))
    if drop_null is not None:
        require(out, drop_null)
        out = out.filter(F.col(drop_null).isNotNull())
    if values is not None:
        require(out, values[0])
        out = out.filter(is_listed(values[0], values[1]))
    if allowlist is not None:
        out = on_allowlist(out, allowlist)
    if patient is not None:
        out = out.filter(F.col(PATIENT) == F.lit(patient))
    if tcrb is not None:
        require(out, TRB_AA)
        out = out.filter(is_listed(TRB_AA, tcrb))
    return out


def area_shares(
    clones: DataFrame,
    timepoints: Sequence[int],
    by: Sequence[str] = (PATIENT, TREATMENT, K),
    summary: Callable[[Column], Column] = F.sum,
    normalize: bool = False,
    exclude_last: bool = False,
    split_response: bool = False,
    **filters,
) -> DataFrame:
    """Shares summed by timepoint and ``by``.

    ``summary`` is any aggregate over a column: a built-in one, or a grouped pandas
    function. ``normalize`` scales each treatment by its number of patients to that of
    the treatment with the fewest; both are counted before the ``filters``.
    """
    kept = labelled(clones)
    if exclude_last:
        kept = drop_last_trajectory(kept)
    chosen = filter_clones(kept, **filters)
    keys = list(by)
    if split_response:
        chosen = recode_response(chosen)
        if RESPONSE not in keys:
            keys.append(RESPONSE)
    if normalize and TREATMENT not in keys:
        raise ValueError("normalize needs treatment among the keys")
    rows = clone_stats(chosen, timepoints).filter(F.col("perc").isNotNull())
    out = rows.groupBy(TIMEPOINT, *keys).agg(summary(F.col("perc")).alias("perc"))
    if normalize:
        scaled = lookup_join(out, patients_per_treatment(kept), [TREATMENT], "inner")
        out = scaled.select(TIMEPOINT, *keys, (F.col("perc") * F.col("_scale")).alias("perc"), "npatients")
    return out


def patient_order(clones: DataFrame, treatments: Sequence[str] | None = None) -> DataFrame:
    """Patients numbered by treatment, in its declared order if given, then by name."""
    pairs = labelled(clones).select(PATIENT, TREATMENT).distinct()
    if not treatments:
        return ordered_rank(pairs, [], [TREATMENT, PATIENT], rank="patient_ord")
    place = F.array_position(F.array(*[F.lit(t) for t in treatments]), F.col(TREATMENT))
    marked = pairs.withColumn("_place", F.when(place > 0, place).otherwise(len(treatments) + 1))
    return ordered_rank(marked, [], ["_place", TREATMENT, PATIENT], rank="patient_ord").drop("_place")


def running_labels(clones: DataFrame, timepoints: Sequence[int], week: int = LABEL_WEEK, **filters) -> DataFrame:
    """Rows of one week with the running share within the trajectory, in stacking order.

    The sum runs over all rows of the trajectory that pass the filters. One pass ranks the
    clones and sums what each adds; the sum at a row is that of the clones before it and of
    the clone's own rows up to the week.
    """
    shares = [F.coalesce(p, F.lit(0.0)) for p in slots("perc", len(timepoints))]
    held = clones.withColumn("_adds", total(shares))
    if filters:
        chosen = filter_clones(clones, **filters).select(CLONE, F.lit(True).alias("_chosen"))
        held = held.join(chosen, CLONE, "left").withColumn("_adds", F.when(F.col("_chosen"), F.col("_adds")).otherwise(0.0))
    stacked = stacked_clones(held, running={"_upto": "_adds"})
    if filters:
        stacked = stacked.filter("_chosen").drop("_chosen")
    later = total([F.lit(0.0), *[s for t, s in zip(timepoints, shares) if t > week]])
    summed = stacked.withColumn("csum", F.col("_upto") - later)
    rows = long_shares(summed, timepoints, extra=("csum",)).filter(F.col("perc").isNotNull())
    return rows.filter(F.col(TIMEPOINT) == week)
