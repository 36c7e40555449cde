"""Clone identity: key of a cell, cells with several keys, attaching clones to cells."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.operators.joins import lookup_join
from trajspark.operators.ordering import ordered_rank
from trajspark.schema import BARCODE, CLONE, PATIENT, TRA_NT, TRB_AA, TRB_NT, require
from trajspark.session import materialize

SEPARATOR = ":"
# How several clones of one cell are joined, the mark of a missing
# amino-acid sequence, and which columns hold receptor sequences.
COMBINED = "|"
MISSING_AA = "0"
RECEPTOR_COLUMNS = r"^TR[A,B]|TCR"

#: Clones of a barcode that are joined in one step.
RUN_CLONES = 1000
#: Combined keys beyond this size are not broadcast.
BROADCAST_BYTES = 64 << 20


def nucleotide_key(missing_chain: str = "drop") -> Column:
    """Patient and both nucleotide chains.

    Null if a chain is missing; ``missing_chain='literal'`` writes ``NA`` for it instead.
    """
    if missing_chain not in ("drop", "literal"):
        raise ValueError("missing_chain must be 'drop' or 'literal'")
    chains = [F.col(TRA_NT), F.col(TRB_NT)]
    if missing_chain == "literal":
        chains = [F.coalesce(c, F.lit("NA")) for c in chains]
    return F.concat(F.col(PATIENT), F.lit(SEPARATOR), chains[0], F.lit(SEPARATOR), chains[1])


def amino_acid_key() -> Column:
    """Patient and TRB amino-acid sequence; null if it is missing or contains ``0``."""
    usable = F.when(~F.col(TRB_AA).contains(MISSING_AA), F.col(TRB_AA))
    return F.concat(F.col(PATIENT), F.lit(SEPARATOR), usable)


def clone_key(chains: str = "nt", missing_chain: str = "drop") -> Column:
    if chains == "nt":
        return nucleotide_key(missing_chain)
    if chains == "aa":
        return amino_acid_key()
    raise ValueError("chains must be 'nt' or 'aa'")


def with_clone_key(cells: DataFrame, chains: str = "nt", missing_chain: str = "drop") -> DataFrame:
    """Add ``clone_id`` from the row's own sequences, without looking at other rows."""
    require(cells, PATIENT, *([TRA_NT, TRB_NT] if chains == "nt" else [TRB_AA]))
    return cells.withColumn(CLONE, clone_key(chains, missing_chain))


def drop_receptor_columns(cells: DataFrame) -> DataFrame:
    """Drop the receptor sequence columns, by name."""
    return cells.drop(*[c for c in cells.columns if re.search(RECEPTOR_COLUMNS, c, re.IGNORECASE)])


def ambiguous_cells(cells: DataFrame, chains: str = "nt", missing_chain: str = "drop") -> DataFrame:
    """One row: how many keyed rows there are beyond one per barcode."""
    keyed = with_clone_key(cells, chains, missing_chain).filter(F.col(CLONE).isNotNull())
    per_barcode = keyed.groupBy(BARCODE).agg(F.count(F.lit(1)).alias("_rows"))
    return per_barcode.agg(F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).cast("bigint").alias("n_ambiguous"))


def combined_clones(keyed: DataFrame) -> DataFrame:
    """Per barcode, its distinct clones in order, joined with ``|``.

    A barcode may have any number of clones: pairs are made distinct and ranked without
    gathering a barcode, ``RUN_CLONES`` neighbours are joined at a time, then the runs.
    """
    pairs = keyed.filter(F.col(CLONE).isNotNull()).select(BARCODE, CLONE).distinct()
    ranked = ordered_rank(pairs, [BARCODE], [CLONE], rank="_place")
    run = F.floor((F.col("_place") - 1) / RUN_CLONES).alias("_run")
    runs = ranked.groupBy(BARCODE, run).agg(F.array_join(F.array_sort(F.collect_list(CLONE)), COMBINED).alias("_text"))
    listed = F.array_sort(F.collect_list(F.struct("_run", "_text")))
    return runs.groupBy(BARCODE).agg(F.array_join(F.transform(listed, lambda r: r["_text"]), COMBINED).alias(CLONE))


def assign_clones(
    cells: DataFrame,
    chains: str = "nt",
    ambiguity: str = "combine",
    missing_chain: str = "drop",
    unique_barcodes: bool = False,
) -> DataFrame:
    """Give every cell its ``clone_id``; null if it has none. The number of rows never changes.

    ``ambiguity='combine'``: a barcode with several clones gets all of them, joined.
    ``ambiguity='drop'``: a barcode that has more than one keyed row gets none.

    Almost every barcode has one row and needs no second look. Those with several rows
    are found by counting barcodes alone. Only they are looked at again and joined
    back, so the cells themselves need not be shuffled by barcode.
    ``unique_barcodes=True`` skips the search for them.
    """
    require(cells, BARCODE)
    if ambiguity not in ("combine", "drop"):
        raise ValueError("ambiguity must be 'combine' or 'drop'")
    keyed = with_clone_key(cells.drop(CLONE), chains, missing_chain)
    if unique_barcodes:
        return keyed

    # a barcode with one keyed row matters only if other rows of it have no key
    counted = keyed.groupBy(BARCODE).agg(F.count(CLONE).alias("_keyed"), F.count(F.lit(1)).alias("_rows"))
    least = F.col("_keyed") > (1 if ambiguity == "drop" else 0)
    repeated = materialize(counted.filter((F.col("_rows") > 1) & least).select(BARCODE))
    rows = repeated.count()
    if rows == 0:
        return keyed
    if ambiguity == "drop":
        return lookup_join(
            keyed, repeated.withColumn("_repeated", F.lit(True)), [BARCODE], "left", rows=rows
        ).select(
            *[c for c in keyed.columns if c != CLONE],
            F.when(F.col("_repeated").isNull(), F.col(CLONE)).alias(CLONE),
        )
    own = lookup_join(keyed.select(BARCODE, CLONE), repeated, [BARCODE], "left_semi", rows=rows)
    joint = materialize(combined_clones(own).withColumnRenamed(CLONE, "_joint"))
    size = joint.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("_joint")), F.lit(0)).alias("bytes")).first()
    # rows of any length: by their bytes, not only by their number
    most = None if size["bytes"] <= BROADCAST_BYTES else 0
    return lookup_join(keyed, joint, [BARCODE], "left", max_rows=most, rows=size["rows"]).select(
        *[c for c in keyed.columns if c != CLONE], F.coalesce("_joint", CLONE).alias(CLONE)
    )


def cells_with_clone(cells: DataFrame) -> DataFrame:
    require(cells, CLONE)
    return cells.filter(F.col(CLONE).isNotNull())
