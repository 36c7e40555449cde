"""Substring dedup by seed and extend.

A window is ``WINDOW`` consecutive words. Its seed is the smallest hash among its runs of
``SEED`` words (winnowing), so equal windows have equal seeds at the same place.
Neighbouring windows with one seed form a stretch: the seed extended to the left and to
the right as far as it stays the seed, about one stretch for twenty words. Documents meet
on seeds. Stretches that are equal as a whole are settled by their digest: only the
smallest document keeps them. Stretches of one seed that differ, as at the two ends of a
passage, are extended window by window, each different stretch once, and the smallest
document of each window keeps it. Neighbouring windows together are the maximal repeats.

Everything is counted per seed, digest or window, never per pair of documents, so a
passage shared by many documents costs one row for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm import words as W
from trajspark.llm.tables import map_arrow, split, written

WINDOW = 50
SEED = 8

U64 = np.uint64
_PLACE = U64((1 << 28) - 1)


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys."""
    done = 1
    while done < width:
        step = min(done, width - done)
        keys = np.minimum(keys[:-step], keys[step:])
        done += step
    return keys


def _window_starts(found: W.Words, window: int) -> np.ndarray:
    """First words of all windows of a block."""
    return W.rows_between(found.bounds[:-1], found.bounds[1:] - window + 1)


def _stretches(docs: DataFrame, window: int, seed: int) -> DataFrame:
    def stretch(batch):
        for block in W.blocks(batch.column(2)):
            found = W.find_words(block)
            starts = _window_starts(found, window)
            if not len(starts):
                continue
            hashes = W.stretch_hashes(block.data, found.start, found.end)
            seeds = W.run_hashes(hashes, seed)
            # the place breaks ties to the left, wherever the window stands
            keys = (seeds & ~_PLACE) | np.arange(len(seeds), dtype=U64)
            place = (_smallest(keys, window - seed + 1)[starts] & _PLACE).astype(np.int64)
            new = np.ones(len(starts), dtype=bool)
            new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
            at = np.flatnonzero(new)
            first, place = starts[at], place[at]
            count = np.diff(np.append(at, len(starts)))
            sums = np.zeros(len(hashes) + 1, dtype=U64)
            np.cumsum(hashes * W.powers("base", len(hashes)), out=sums[1:])
            whole = (sums[first + count + window - 1] - sums[first]) * W.powers("inverse", len(hashes) + 1)[first]
            digest = W.mix(whole + (place - first).astype(U64) * U64(0x9E3779B97F4A7C15) + (count.astype(U64) << U64(40)))
            doc = np.searchsorted(found.bounds, first, side="right") - 1
            rows = pa.array(doc + block.first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(seeds[place].view(np.int64)),
                    pa.array(digest.view(np.int64)),
                    pa.array((first - found.bounds[doc]).astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                ],
                ["doc_id", "version", "seed", "digest", "start", "windows"],
            )

    schema = "doc_id bigint, version bigint, seed bigint, digest bigint, start int, windows int"
    return map_arrow(docs, stretch, schema)


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """A row for each window of the listed stretches of each document."""

    def expand(batch):
        for block in W.blocks(batch.column(2)):
            found = W.find_words(block)
            hashes = W.run_hashes(W.stretch_hashes(block.data, found.start, found.end), window)
            rows, starts = _listed(batch.column(3).slice(block.first, block.last - block.first), 1)
            places = starts + found.bounds[:-1][rows]
            take = pa.array(rows + block.first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take),
                    batch.column(1).take(take),
                    pa.array(hashes[places].view(np.int64)),
                    pa.array(starts.astype(np.int32)),
                ],
                ["doc_id", "version", "hash", "start"],
            )

    return map_arrow(docs, expand, "doc_id bigint, version bigint, hash bigint, start int")


def _listed(stretches: pa.Array, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """Document row and number of every word in ``[start, start + windows + extra - 1)`` of its listed stretches."""
    counts = np.array([0 if s is None else s for s in pa.compute.list_value_length(stretches).to_pylist()], dtype=np.int64)
    flat = stretches.flatten()
    start = flat.field(0).to_numpy().astype(np.int64)
    windows = flat.field(1).to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(counts)), counts)
    size = windows + extra - 1
    return np.repeat(rows, size), W.rows_between(start, start + size)


def _without(docs: DataFrame, window: int) -> DataFrame:
    """Every document without the words of its listed stretches, and where they stood."""

    def cut(batch):
        for block in W.blocks(batch.column(1)):
            found = W.find_words(block)
            gone = np.zeros(len(found.start), dtype=bool)
            rows, numbers = _listed(batch.column(2).slice(block.first, block.last - block.first), window)
            gone[numbers + found.bounds[:-1][rows]] = True
            kept = np.flatnonzero(~gone)
            size = found.end[kept] - found.start[kept] + 1
            ends = np.cumsum(size)
            at = W.rows_between(found.start[kept], found.end[kept] + 1)
            text = np.append(block.data, np.uint8(0x20))[at]
            text[ends - 1] = 0x20
            edges = np.concatenate([[0], ends])[np.searchsorted(kept, found.bounds)]
            whole = text.tobytes()
            texts = [whole[lo : max(lo, hi - 1)] for lo, hi in zip(edges[:-1], edges[1:])]
            # repeats: maximal runs of removed words within a document
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            inner = found.bounds[(found.bounds > 0) & (found.bounds < len(gone))]
            opens[inner] = gone[inner]
            closes = gone.copy()
            closes[:-1] &= ~gone[1:]
            closes[inner - 1] = gone[inner - 1]
            first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            doc = np.searchsorted(found.bounds, first, side="right") - 1
            spans = pa.StructArray.from_arrays(
                [pa.array(first - found.bounds[doc]), pa.array(last - first)], ["start", "length"]
            )
            removed = np.concatenate([[0], np.cumsum(gone)])[found.bounds]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(found.counts)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(block.first, block.last - block.first),
                    pa.array(found.counts),
                    pa.array(np.diff(removed)),
                    pa.ListArray.from_arrays(pa.array(offsets), spans),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "repeats", "kept_text"],
            )

    schema = (
        "doc_id bigint, n_words bigint, n_removed bigint, repeats array<struct<start:bigint,length:bigint>>, kept_text string"
    )
    return map_arrow(docs, cut, schema)


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Remove every word of a window that also starts in a document with a smaller ``doc_id``.

    One row for each row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``repeats``
    (start and length in words of the removed maximal repeats) and ``kept_text`` (the other
    words, joined by one space). Windows are judged on the input.

    A null or empty text has no words. Rows with one ``doc_id`` are not smaller than each
    other, so they remove nothing from each other. A row with a null ``doc_id`` neither
    loses words nor makes others lose any. Other columns are ignored.
    """
    docs = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("version"),
        F.col("text").cast("string").alias("text"),
    )
    found = written(_stretches(docs.filter("doc_id is not null"), window, seed), "stretches")
    alike = found.groupBy("seed", "digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    alike = written(alike, "alike")
    seeds = (
        alike.groupBy("seed")
        .agg(F.min("first").alias("lo"), F.max("last").alias("hi"), F.count(F.lit(1)).alias("kinds"))
        .filter("lo < hi")
        .select("seed", "kinds")
    )
    met = alike.join(seeds, "seed").select("seed", "digest", "first", "kinds")
    met = written(found.join(met, ["seed", "digest"]).drop("seed", "digest"), "met")

    stretch = F.struct("start", "windows")
    ends = met.filter("doc_id = first and kinds > 1").groupBy("doc_id", "version").agg(F.collect_list(stretch).alias("s"))
    ends = written(ends, "ends")
    some, _ = split(docs, ends, "doc_id")
    windows = written(_windows(some.join(ends, ["doc_id", "version"]), window), "windows")
    owners = windows.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    single = windows.join(owners, "hash").filter("doc_id > lo").select("doc_id", "version", "start", F.lit(1).alias("windows"))
    gone = met.filter("doc_id > first").select("doc_id", "version", "start", "windows").union(single)
    gone = written(gone.groupBy("doc_id", "version").agg(F.collect_set(stretch).alias("s")), "gone")
    # only documents that may lose words are shuffled
    some, others = split(docs, gone, "doc_id")
    some = some.join(gone, ["doc_id", "version"], "left").select("doc_id", "text", "s")
    others = others.select("doc_id", "text", F.lit(None).cast(gone.schema["s"].dataType).alias("s"))
    return _without(some, window).union(_without(others, window))
