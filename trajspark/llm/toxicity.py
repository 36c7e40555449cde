"""Toxicity by a factorization machine over hashed terms.

Terms are words (letters, digits and what is outside ASCII; A to Z in lower case) and
their first ``PREFIX`` bytes, hashed to ``2 ** HASH_BITS`` cells. The model is fitted on a
bounded sample of labelled documents, in one task. A cell takes part in two ways. Alone: at
least ``MIN_DOCUMENTS`` of them hold it and its share differs between the classes by more than
``MIN_Z`` standard errors (at most ``MAX_TERMS``). In company: of the ``PAIR_TERMS`` most frequent
cells, both of a pair whose share of toxic documents is more than ``MIN_PAIR_Z`` standard
errors from the sum of what each of the two adds (at most ``MAX_PAIRS``), although neither may
tell anything alone. On them a factorization machine is trained: a weight for each term and,
through its factors, a weight for each pair of terms. Every document is then scored where it
lies, with the model of fixed size broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.llm import words as W
from trajspark.llm.tables import give_back, lists, map_arrow

HASH_BITS = 20
PREFIX = 5
SAMPLE = 20_000
MIN_DOCUMENTS = 5
MIN_Z = 4.0
MAX_TERMS = 4096
PAIR_TERMS = 4096
MIN_PAIR_Z = 8.0
MAX_PAIRS = 256
#: Different documents that hold both of a pair, at least; width of the blocks that are compared.
MIN_TOGETHER = 20
PAIR_BLOCK = 512
FACTORS = 8
PASSES = 150
RATE = 0.05
DECAY = 1e-4
SEED = 7
FOLDS = 5

_NO_LETTER = np.ones(256, dtype=bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _NO_LETTER[_lo:_hi] = False


def _cells(block: W.Block) -> tuple[np.ndarray, np.ndarray]:
    """Document and cell of every term of a block, with repeats."""
    found = W.find_words(block, _NO_LETTER)
    shift = np.uint64(64 - HASH_BITS)
    doc = np.repeat(np.arange(len(found.counts)), found.counts)
    whole = W.stretch_hashes(block.data, found.start, found.end, lower=True)
    head = W.stretch_hashes(block.data, found.start, np.minimum(found.end, found.start + PREFIX), lower=True)
    cells = np.concatenate([whole, W.mix(head ^ np.uint64(1))]) >> shift
    return np.concatenate([doc, doc]), cells.astype(np.int64)


def _distinct(doc: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique((doc << HASH_BITS) | cell)
    return keys >> HASH_BITS, keys & ((1 << HASH_BITS) - 1)


@dataclass(frozen=True)
class Model:
    """The cells that count and their parameters."""

    cells: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def scores(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Probability of the toxic class for ``rows`` documents; (``row``, ``term``) are their distinct terms."""
        return _probability(_outputs(self.bias, self.weight, self.factor, row, term, rows)[0])


def _probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _outputs(bias, weight, factor, row, term, rows) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of the machine and the sums of factors for each row; ``row`` is sorted."""
    linear = np.bincount(row, weights=weight[term], minlength=rows)
    sums = np.zeros((rows, factor.shape[1]))
    squares = np.zeros(rows)
    for f in range(factor.shape[1]):
        v = factor[term, f]
        sums[:, f] = np.bincount(row, weights=v, minlength=rows)
        squares += np.bincount(row, weights=v * v, minlength=rows)
    return bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums


def chosen_cells(row: np.ndarray, cell: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The cells that tell the classes apart by themselves."""
    ones, zeros = max(1, int(label.sum())), max(1, int((1 - label).sum()))
    size = 1 << HASH_BITS
    in_ones = np.bincount(cell, weights=label[row], minlength=size)
    in_all = np.bincount(cell, minlength=size)
    share = in_all / len(label) if len(label) else in_all
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / ones + 1 / zeros))
    z = np.abs(in_ones / ones - (in_all - in_ones) / zeros) / error
    z[in_all < MIN_DOCUMENTS] = 0
    best = np.argsort(-z, kind="stable")[:MAX_TERMS]
    return np.sort(best[z[best] > MIN_Z])


def paired_cells(row: np.ndarray, cell: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Cells of the pairs that tell more together than the two add alone; equal documents count once."""
    mixed = W.mix(cell.astype(np.uint64) + np.uint64(1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
    edges = np.searchsorted(row, np.arange(len(label) + 1))
    _, first = np.unique(np.stack([sums[edges[1:]] - sums[edges[:-1]], label.astype(np.uint64)], 1), axis=0, return_index=True)
    number = np.full(len(label), -1)
    number[first] = np.arange(len(first))
    row, cell, label = number[row], cell[number[row] >= 0], label[first]
    row = row[row >= 0]
    held = np.bincount(cell, minlength=1 << HASH_BITS)
    cells = np.argsort(-held, kind="stable")[:PAIR_TERMS]
    cells = np.sort(cells[held[cells] >= MIN_TOGETHER])
    if not len(cells) or not 0 < label.sum() < len(label):
        return np.zeros(0, dtype=np.int64)
    held, toxic = held[cells], np.bincount(cell, weights=label[row], minlength=1 << HASH_BITS)[cells]
    place = np.full(1 << HASH_BITS, -1, dtype=np.int32)
    place[cells] = np.arange(len(cells))
    at = place[cell]
    row, at = row[at >= 0], at[at >= 0]
    prior, is_toxic = label.mean(), label == 1
    # a share of few documents is never taken as surer than the share of all would be
    spread = prior * (1 - prior)

    def block(lo: int) -> np.ndarray:
        x = np.zeros((len(label), min(PAIR_BLOCK, len(cells) - lo)), dtype=np.float32)
        inside = (at >= lo) & (at < lo + PAIR_BLOCK)
        x[row[inside], at[inside] - lo] = 1
        return x

    def share(part, whole):
        p = (part + prior) / (whole + 1)
        return p, np.maximum(p * (1 - p), spread) / (whole + 1)

    found: list[tuple[float, int, int]] = []
    for lo in range(0, len(cells), PAIR_BLOCK):
        left = block(lo)
        left_toxic = left[is_toxic]
        for other in range(lo, len(cells), PAIR_BLOCK):
            right = left if other == lo else block(other)
            both, both_toxic = left.T @ right, left_toxic.T @ right[is_toxic]
            a, b = slice(lo, lo + left.shape[1]), slice(other, other + right.shape[1])
            n_a, n_b, t_a, t_b = held[a, None], held[None, b], toxic[a, None], toxic[None, b]
            p_a, v_a = share(t_a - both_toxic, n_a - both)
            p_b, v_b = share(t_b - both_toxic, n_b - both)
            p_0, v_0 = share(label.sum() - t_a - t_b + both_toxic, len(label) - n_a - n_b + both)
            added = np.clip(p_a + p_b - p_0, 0, 1)
            error = np.sqrt(v_a + v_b + v_0 + np.maximum(added * (1 - added), spread) / np.maximum(both, 1))
            z = np.abs(both_toxic / np.maximum(both, 1) - added) / error
            i, j = np.nonzero((z > MIN_PAIR_Z) & (both >= MIN_TOGETHER))
            ahead = i + lo < j + other
            i, j = i[ahead], j[ahead]
            found += zip((-z[i, j]).tolist(), (i + lo).tolist(), (j + other).tolist())
            found = sorted(found)[:MAX_PAIRS]
    return cells[np.unique([k for _, i, j in found for k in (i, j)]).astype(np.int64)]


def fit(row: np.ndarray, cell: np.ndarray, label: np.ndarray) -> Model:
    """Train on distinct (``row``, ``cell``) of labelled documents by Adam on the log loss."""
    cells = np.union1d(chosen_cells(row, cell, label), paired_cells(row, cell, label))
    at = np.searchsorted(cells, cell)
    hit = at < len(cells)
    hit[hit] = cells[at[hit]] == cell[hit]
    row, term, rows, terms = row[hit].astype(np.int64), at[hit], len(label), len(cells)
    prior = (label.sum() + 0.5) / (rows + 1)
    values = [np.array([np.log(prior / (1 - prior))]), np.zeros(terms)]
    values.append(np.random.default_rng(SEED).normal(0, 0.05, (terms, FACTORS)))
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, PASSES + 1) if rows else ():
        bias, weight, factor = values
        out, sums = _outputs(bias[0], weight, factor, row, term, rows)
        slope = (_probability(out) - label) / rows
        each = slope[row]
        down_weight = np.bincount(term, weights=each, minlength=terms) + DECAY * weight
        down_factor = np.empty_like(factor)
        mass = np.bincount(term, weights=each, minlength=terms)
        for f in range(FACTORS):
            down_factor[:, f] = np.bincount(term, weights=each * sums[row, f], minlength=terms) - mass * factor[:, f]
        down = [np.array([slope.sum()]), down_weight, down_factor + DECAY * factor]
        for i, g in enumerate(down):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            values[i] = values[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(cells, float(values[0][0]), values[1], values[2])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out fold."""
    known = (
        labels.filter("doc_id is not null and toxic is not null")
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def terms(batch):
        for block in W.blocks(batch.column(0)):
            doc, cell = _distinct(*_cells(block))
            counts = np.bincount(doc, minlength=block.last - block.first)
            label = batch.column(1).slice(block.first, block.last - block.first)
            yield pa.RecordBatch.from_arrays([label, lists(cell.astype(np.int32), counts)], ["toxic", "cells"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        label = table.column("toxic").to_numpy().astype(float)
        counts = table.column("cells").combine_chunks().value_lengths().to_numpy()
        cell = table.column("cells").combine_chunks().flatten().to_numpy()
        model = fit(np.repeat(np.arange(len(label), dtype=np.int32), counts), cell, label)
        del table, cell
        give_back()
        return pa.table(
            {
                "cells": lists(model.cells.astype(np.int64), np.array([len(model.cells)])),
                "bias": [model.bias],
                "weight": lists(model.weight, np.array([model.weight.size])),
                "factor": lists(model.factor.ravel(), np.array([model.factor.size])),
            }
        )

    # at most ``sample`` rows of two numbers are broadcast
    rows = docs.join(F.broadcast(known), "doc_id").select("text", "toxic")
    shown = map_arrow(rows, terms, "toxic int, cells array<int>")
    fitted = shown.groupBy(F.lit(1).alias("all")).applyInArrow(
        learn, "cells array<bigint>, bias double, weight array<double>, factor array<double>"
    )
    found = fitted.collect()
    if not found:
        return Model(np.zeros(0, dtype=np.int64), -3.0, np.zeros(0), np.zeros((0, FACTORS)))
    cells = np.array(found[0].cells, dtype=np.int64)
    return Model(cells, found[0].bias, np.array(found[0].weight), np.array(found[0].factor).reshape(-1, FACTORS))


def held_out(doc_id: str):
    """Documents that no label is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; columns of these names are replaced."""
    docs = docs.drop("held_out", "score", "predicted")
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(plain, labels, sample)
    place = np.full(1 << HASH_BITS, -1, dtype=np.int32)
    place[model.cells] = np.arange(len(model.cells))
    shared = docs.sparkSession.sparkContext.broadcast((model, place))
    at = docs.columns.index("text")

    def score(batch):
        model, place = shared.value
        parts = []
        for block in W.blocks(batch.column(at)):
            doc, cell = _cells(block)
            hit = place[cell] >= 0
            doc, cell = _distinct(doc[hit], cell[hit])
            parts.append(model.scores(doc, place[cell], block.last - block.first))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts))], [*batch.schema.names, "score"])

    rows = docs.withColumn("held_out", held_out("doc_id"))
    out = map_arrow(rows, score, T.StructType([*rows.schema, T.StructField("score", T.DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Score every document: ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (score >= 0.5).

    One row for each row of ``docs``. A null or empty text scores what a document without
    any term scores. A null ``doc_id`` is scored and not held out. Labels that repeat count
    once, as toxic if any is; null labels are left out. Without labels every score is the
    same and below 0.5. An empty table gives none. A very long text is scored as a whole, in one
    row. Other columns are ignored.
    """
    found = scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels, sample)
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", "score", "predicted")
