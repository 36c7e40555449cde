"""SimHash fingerprints of texts and their near duplicates, by tiled exact comparison.

Different fingerprints are put into tiles by the number of bits set in each of four (or
eight) parts. Two fingerprints that differ in at most ``radius`` bits have numbers that
differ by at most ``radius`` in sum, so pairs of tiles beyond it are skipped. The
others are compared in full: exclusive-or of all fingerprints of two tiles, and the bits
of the result counted. Copies share a fingerprint and are compared once. A pair of tiles
hands on the links that connect its fingerprints, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm import words as W
from trajspark.llm.components import components
from trajspark.llm.tables import map_arrow, written

SHINGLE = 3
RADIUS = 3
SEED = 42
BITS = 64

#: Fingerprints of a tile on average at most; cells with more are cut.
TILE = 1024
#: Rows of a tile that are compared with another at once.
ROWS = 256
#: From this number of fingerprints on, tiles are made by eight parts instead of four.
FINE_FROM = 1 << 25
#: Sizes of so many possible cells are broadcast.
FEW_CELLS = 100_000
SHINGLES_AT_ONCE = 1 << 17
#: A key with more than one in so many rows does not go through the shuffle of a join.
HOT_SHARE = 1000


def _fingerprints(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for block in W.blocks(batch.column(1)):
        found = W.find_words(block)
        text, start, end = _spaced(block, found)
        count = np.where(found.counts > 0, np.maximum(found.counts - SHINGLE + 1, 1), 0)
        first = W.rows_between(found.bounds[:-1], found.bounds[:-1] + count)
        owner = np.repeat(np.arange(len(count)), count)
        last = np.minimum(first + SHINGLE, found.bounds[1:][owner]) - 1
        votes = np.zeros((len(count), BITS), dtype=np.int64)
        for at in range(0, len(first), SHINGLES_AT_ONCE):
            part = slice(at, at + SHINGLES_AT_ONCE)
            stretches = zip(start[first[part]].tolist(), end[last[part]].tolist())
            hashes = np.array([xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in stretches], dtype="<u8")
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            edges = np.flatnonzero(np.diff(owner[part], prepend=-1))
            votes[owner[part][edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
        prints = np.packbits(2 * votes > count[:, None], axis=1, bitorder="little").view("<i8").ravel()
        ids = batch.column(0).slice(block.first, block.last - block.first)
        yield pa.RecordBatch.from_arrays([ids, pa.array(prints)], ["doc_id", "fp"])


def _spaced(block: W.Block, found: W.Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a block in lower case with one space after each, and where they start and end."""
    size = found.end - found.start
    end = np.cumsum(size + 1) - 1
    start = end - size
    data = np.full(int((size + 1).sum()), ord(" "), dtype=np.uint8)
    data[W.rows_between(start, end)] = W.LOWER[block.data[W.rows_between(found.start, found.end)]]
    return data.tobytes(), start, end


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the fingerprint ``fp`` (64 bits as a long) of every row."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(texts, _fingerprints, "doc_id bigint, fp bigint")


def near_steps(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of bit counts within ``radius``; of a step and its opposite only one."""
    return sorted(
        step
        for step in product(range(-radius, radius + 1), repeat=parts)
        if sum(map(abs, step)) <= radius and step >= (0,) * parts
    )


def links(prints: DataFrame, parts: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (``a``, ``b``) that connect all fingerprints of ``prints`` (``fp``, distinct) within ``radius`` bits."""
    width = BITS // parts
    base = width + 2 * radius + 1  # numbers of neighbouring cells do not run into each other

    def cell(batch):
        bits = np.bitwise_count(batch.column(0).to_numpy().view(f"<u{width // 8}").reshape(-1, parts)).astype(np.int64)
        code = bits @ base ** np.arange(parts, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code)], ["fp", "cell"])

    placed = written(map_arrow(prints.select("fp"), cell, "fp bigint, cell bigint"), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("cuts"))
    if (width + 1) ** parts <= FEW_CELLS:
        sizes = F.broadcast(sizes)
    # no two tiles of a cell share a fingerprint; a tile is one row
    tiles = written(
        placed.join(sizes, "cell")
        .groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("cuts")).alias("cut"))
        .agg(F.collect_list("fp").alias("fps")),
        "tiles",
    )
    steps = [int(sum(s * base**i for i, s in enumerate(step))) for step in near_steps(parts, radius)]
    other = tiles.select(F.col("cell").alias("near"), F.col("cut").alias("cut_b"), F.col("fps").alias("fps_b"))
    met = tiles.select("cell", "cut", "fps", F.explode(F.array(*[F.lit(s) for s in steps])).alias("step"))
    met = met.withColumn("near", F.col("cell") + F.col("step")).join(other, "near")
    met = met.filter((F.col("step") != 0) | (F.col("cut") <= F.col("cut_b")))

    def compare(batch):
        a, b = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
            pairs = [np.zeros((2, 0), dtype=np.int64)]
            for at in range(0, len(x), ROWS):
                differ = np.bitwise_count((x[at : at + ROWS, None] ^ y[None, :]).view(np.uint64))
                near = np.nonzero(differ <= radius)
                pairs.append(np.stack([x[near[0] + at], y[near[1]]]))
            left, right = np.concatenate(pairs, axis=1)
            left, right = connecting(left[left != right], right[left != right])
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])

    return map_arrow(met.select("fps", "fps_b"), compare, "a bigint, b bigint")


def connecting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links ``a`` to ``b`` connect, fewer than their ends."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, x, label[y])
        np.minimum.at(least, y, label[x])
        least = least[least]
        if (least == label).all():
            break
        label = least
    rest = label != np.arange(len(nodes))
    return nodes[label[rest]], nodes[rest]


def simhash_groups(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` of every row of ``docs``.

    Fingerprints that differ in at most ``radius`` bits are linked; ``component_id`` is the
    smallest ``doc_id`` that links reach. A null or empty text, or one without words, has
    fingerprint zero, which is linked like any other; a very long text counts in full.
    Repeated rows have one fingerprint and stay as rows. A null ``doc_id`` stays null and
    names no component, which is null if no row of it has a ``doc_id``. Other columns are
    ignored. An empty table gives no rows.
    """
    rows = written(fingerprints(docs), "prints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    size = prints.agg(F.count(F.lit(1)).alias("prints"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    parts = parts or (4 if size["prints"] < FINE_FROM else 8)
    found = components(written(links(prints, parts, radius, tile), "links"))
    linked = written(prints.join(found.withColumnRenamed("node", "fp"), "fp"), "linked")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = join_counted(linked.select("fp", "component"), written(least, "least"), "component", size["prints"])
    alone = prints.withColumnRenamed("least", "own")
    all_named = alone.join(named.select("fp", "component_id"), "fp", "left").select(
        "fp", "n", F.coalesce("component_id", "own").alias("component_id")
    )
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return join_counted(rows, written(all_named, "named"), "fp", size["rows"]).select("doc_id", digits, "component_id")


def join_counted(rows: DataFrame, counted: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``counted``, which has every ``key`` once, with its number of rows ``n``.

    At most ``HOT_SHARE`` keys can have more than that share of ``total`` rows: they are
    broadcast, and their rows stay where they are.
    """
    hot = F.col("n") * HOT_SHARE > F.lit(total)
    often = counted.filter(hot).drop("n").withColumn("_often", F.lit(True))
    met = rows.join(F.broadcast(often), key, "left")
    others = met.filter("_often is null").select(rows.columns).join(counted.filter(~hot).drop("n"), key)
    return met.filter("_often").drop("_often").unionByName(others)
