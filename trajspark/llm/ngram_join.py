"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its word shingles; two documents link if their Jaccard
similarity reaches a threshold. Shingles are put in one order for all documents: those
that are rare in the corpus first, then the frequent ones, each class by hash. At least
one of the first ``e + 1`` shingles of a set, ``e`` being the number it may lose, is
among those of a linked set. Rare shingles are indexed singly. Frequent ones are dealt
into classes and indexed in pairs within their class; a prefix is extended until losing
``e`` shingles leaves a single one or a pair, because a class of m shingles loses its
last pair only with m - 1 of them. The number of classes follows the size of the set, so
that pairs stay in proportion to it; a set uses the classes of its own size step and of
the next, and thereby shares one of them with every set it can link to.

Which shingles are frequent is read from two tables of counters of fixed size over all
documents. A counter holds what its many rare shingles add up to, which grows with the
corpus but varies little (by the root of the sum), and what a frequent one adds. So a
shingle is frequent if both its counters exceed the median by six times the spread below
the median and by ``frequent``: the limit follows the noise, not the sum. Shared counters
cost time, never a link.

Sets that are equal are merged first. Index entries with one set are dropped. Of the rest
every set is compared with the heaviest set of each entry, and linked sets are joined to
components. Only sets of different components in one entry remain. These are compared in
square blocks of bounded size by parity bitmaps, whose distance never exceeds that of the
sets, and the few pairs that may link are verified. So no link is lost, and a group of
copies is never expanded into its pairs. A set that many others are compared with travels
once for each block of its pairs, not once for each pair.

A group (copies of one text, pairs of one set) with more than one in ``SHARE`` of all rows
is split; there are fewer than ``SHARE`` of those, so their table may be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajspark.llm import words as W
from trajspark.llm.components import components
from trajspark.llm.tables import IdFilter, give_back, lists, map_arrow, set_aside, sorted_groups, split, written

SHINGLE = 5
PERCENT = 80
COUNTERS = 1 << 19
COUNTER_ROWS = 2
COUNTER_CHUNK = 1 << 12
FREQUENT = 64
BLOCK_ROWS = 512
SHARE = 2000
PAIR_BLOCK = 512
CLASS_SIZE = 8
SIZE_STEP = 1.25

U64 = np.uint64
_CELLS = COUNTER_ROWS * COUNTERS


def shingle_sets(texts: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of every block: its first row, all distinct shingles sorted within each document, and their numbers.

    Text in lower case (A to Z only). A document of fewer words is one shingle.
    """
    for block in W.blocks(texts):
        found = W.find_words(block)
        hashes = W.stretch_hashes(block.data, found.start, found.end, lower=True)
        counts = found.counts
        full = W.run_hashes(hashes, length)
        short = np.flatnonzero((counts > 0) & (counts < length))
        numbers = np.where(counts >= length, counts - length + 1, np.minimum(counts, 1))
        at = W.rows_between(found.bounds[:-1], found.bounds[:-1] + numbers)
        shingles = np.zeros(len(hashes), dtype=U64)
        shingles[: len(full)] = full
        for d in short:
            lo, hi = found.bounds[d], found.bounds[d + 1]
            shingles[lo] = W.run_hashes(hashes[lo:hi], hi - lo)[0] ^ U64(hi - lo)
        values = shingles[at]
        bounds = np.concatenate([[0], np.cumsum(numbers)])
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            values[lo:hi].sort()
        fresh = np.ones(len(values), dtype=bool)
        fresh[1:] = values[1:] != values[:-1]
        fresh[bounds[:-1][numbers > 0]] = True
        kept = np.add.reduceat(fresh, bounds[:-1][numbers > 0]) if len(values) else np.zeros(0, dtype=np.int64)
        distinct = np.zeros(len(numbers), dtype=np.int64)
        distinct[numbers > 0] = kept
        yield block.first, values[fresh], distinct


def _cells(values: np.ndarray) -> Iterator[np.ndarray]:
    """The cell of every shingle in each table of counters; the tables lie one after the other."""
    for row in range(COUNTER_ROWS):
        yield ((values >> U64(64 - 19 * (row + 1))) & U64(COUNTERS - 1)).astype(np.int64) + row * COUNTERS


def is_frequent(values: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Which shingles are frequent in every table of counters."""
    found = np.ones(len(values), dtype=bool)
    for at in _cells(values):
        found &= cells[at].astype(bool)
    return found


def above_noise(counters: np.ndarray, frequent: int) -> np.ndarray:
    """Which counters of one table hold more than rare shingles add up to, by over ``frequent``.

    The spread is taken below the median, where no frequent shingle reaches.
    """
    low, middle = np.quantile(counters, [0.16, 0.5])
    return counters > middle + 6 * (middle - low) + frequent


def frequent_cells(docs: DataFrame, length: int, frequent: int) -> np.ndarray:
    """Which of the counters are frequent: one bit for each, whatever the number of documents."""

    def count(batches):
        cells = np.zeros(_CELLS, dtype=np.int64)
        for batch in batches:
            for _, values, _ in shingle_sets(batch.column(0), length):
                for row, at in enumerate(_cells(values)):
                    table = cells[row * COUNTERS : (row + 1) * COUNTERS]
                    table += np.bincount(at - row * COUNTERS, minlength=COUNTERS)
        chunks = np.flatnonzero(cells.reshape(-1, COUNTER_CHUNK).any(axis=1))
        for chunk in chunks:
            part = cells[chunk * COUNTER_CHUNK : (chunk + 1) * COUNTER_CHUNK]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([int(chunk)], pa.int32()), "counts": [part.tolist()]})

    def total(batches):
        for group in sorted_groups(batches, 1):
            counts = sum(b.column(1).flatten().to_numpy().reshape(-1, COUNTER_CHUNK).sum(axis=0) for b in group)
            yield pa.RecordBatch.from_pydict({"chunk": group[0].column(0)[:1], "counts": [counts.tolist()]})

    schema = "chunk int, counts array<bigint>"
    parts = docs.select("text").mapInArrow(count, schema)
    totals = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(total, schema)
    cells = np.zeros(_CELLS, dtype=np.int64)
    for row in totals.toLocalIterator():
        cells[row.chunk * COUNTER_CHUNK : (row.chunk + 1) * COUNTER_CHUNK] = row.counts
    return np.packbits(np.concatenate([above_noise(table, frequent) for table in cells.reshape(COUNTER_ROWS, -1)]))


def _size_class(n: int) -> int:
    """Sizes that differ by at most a quarter fall in one step or in neighbouring steps."""
    step, bound = 0, SIZE_STEP
    while n >= bound:
        step, bound = step + 1, bound * SIZE_STEP
    return step


def index_keys(values: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """Keys under which one set (sorted shingles, and which are frequent) is indexed."""
    n = len(values)
    lost = n * (100 - percent) // 100
    rare = values[~common][: lost + 1]
    if len(rare) > lost or n == 1:
        return rare
    keys = [rare]
    ordered = values[common]
    for step in (_size_class(n), _size_class(n) + 1):
        classes = max(1, int(SIZE_STEP**step / CLASS_SIZE))
        deal = (W.mix(ordered) % U64(classes)).astype(np.int64)
        # position of each shingle within its class: all but the first of a class count
        order = np.argsort(deal, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], deal[order][1:] != deal[order][:-1]]))
        place = np.empty(len(deal), dtype=np.int64)
        place[order] = np.arange(len(deal)) - np.repeat(starts, np.diff(np.append(starts, len(deal))))
        end = int(np.searchsorted(np.cumsum(place > 0), lost + 1 - len(rare))) + 1
        order = order[order < end]
        hi = np.arange(len(order))
        first = W.rows_between(hi - place[order], hi)
        second = np.repeat(hi, place[order])
        salt = U64(step * 0x9E3779B97F4A7C15 % (1 << 64))
        keys.append(W.mix(W.mix(ordered[order][first] + salt) + ordered[order][second]))
    return np.concatenate(keys)


def parity_bits(values: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set, with 2 to 4 bits for each shingle."""
    size = max(64, 1 << (2 * len(values) - 1).bit_length())
    return np.packbits(np.bincount((values & U64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1)


def _index(docs: DataFrame, length: int, percent: int, bits) -> DataFrame:
    def index(batch):
        ids = batch.column(0)
        cells = np.unpackbits(bits.value)
        for first, values, counts in shingle_sets(batch.column(1), length):
            common = is_frequent(values, cells)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            sums = np.zeros((2, len(values) + 1), dtype=U64)
            np.cumsum(W.mix(values), out=sums[0, 1:])
            np.cumsum(W.mix(values ^ U64(0x5851F42D4C957F2D)), out=sums[1, 1:])
            digest = sums[:, bounds[1:]] - sums[:, bounds[:-1]]
            keys = [
                index_keys(values[lo:hi], common[lo:hi], percent) if hi > lo else values[:0]
                for lo, hi in zip(bounds[:-1], bounds[1:])
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, len(counts)),
                    pa.array(counts),
                    pa.array(digest[0].view(np.int64)),
                    pa.array(digest[1].view(np.int64)),
                    lists(np.concatenate(keys).view(np.int64), np.array([len(k) for k in keys])),
                ],
                ["doc_id", "n", "d1", "d2", "keys"],
            )

    schema = "doc_id bigint, n bigint, d1 bigint, d2 bigint, keys array<bigint>"
    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), index, schema)


def _shared(postings: DataFrame, percent: int) -> DataFrame:
    """Entries with another set of a size that may link, from a partition sorted by key and size."""

    def keep(batches):
        tail = None
        for batch in _with_end(batches):
            # the last row of a batch waits for its successor
            rows = batch if tail is None else pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
            key, n = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            near = (key[1:] == key[:-1]) & (100 * n[:-1] >= percent * n[1:])
            shared = np.zeros(len(key), dtype=bool)
            shared[1:] = near
            shared[:-1] |= near
            if tail is not None and tail_shared:
                shared[0] = True
            tail, tail_shared = rows.slice(len(key) - 1), bool(shared[-1])
            yield rows.slice(0, len(key) - 1).filter(pa.array(shared[:-1]))
        if tail is not None and tail_shared:
            yield tail

    def _with_end(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch

    return postings.repartition("key").sortWithinPartitions("key", "n", "rep").mapInArrow(keep, postings.schema)


def _of_sets(docs: DataFrame, ids: DataFrame, length: int, bitmaps: bool) -> DataFrame:
    """Sorted shingles, or parity bitmaps, of the documents whose ``rep`` is in ``ids``."""
    wanted = IdFilter(ids, "rep")

    def sets(batch):
        batch = batch.filter(wanted.keep(batch.column(2)))
        names = batch.column(0)
        for first, values, counts in shingle_sets(batch.column(1), length):
            bounds = np.concatenate([[0], np.cumsum(counts)])
            if bitmaps:
                bits = [parity_bits(values[lo:hi]).tobytes() if hi > lo else b"" for lo, hi in zip(bounds[:-1], bounds[1:])]
                column = pa.array(bits, pa.binary())
            else:
                column = lists(values.view(np.int64), counts)
            yield pa.RecordBatch.from_arrays([names.slice(first, len(counts)), pa.array(counts), column], ["rep", "n", "set"])

    rows = docs.filter("doc_id is not null").select("doc_id", "text", IdFilter.cell("doc_id").alias("cell"))
    kind = "binary" if bitmaps else "array<bigint>"
    return map_arrow(rows, sets, f"rep bigint, n bigint, set {kind}").join(ids, "rep")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()


def _large(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys of more than one in ``SHARE`` of ``rows`` (a written table), with their number ``m``: fewer than ``SHARE``."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    return counted.filter(F.col("m") > max(PAIR_BLOCK, rows.count() // SHARE))


def _compared(pairs: DataFrame, sets: DataFrame, passes: Callable[[int, np.ndarray, int, np.ndarray], bool]) -> DataFrame:
    """The ``pairs`` (``a``, ``b``; a written table) for which ``passes(n of a, set of a, n of b, set of b)`` holds.

    The set of ``a`` comes once for a block of its pairs, ahead of the sets of ``b`` in a sorted partition.
    """
    large = _large(pairs, "a").select("a", F.ceil(F.col("m") / PAIR_BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).alias("block")
    dealt = pairs.join(F.broadcast(large), "a", "left").select("a", "b", block)
    members = dealt.join(sets.withColumnRenamed("rep", "b"), "b").select("a", "block", F.lit(1).alias("turn"), "b", "n", "set")
    heads = dealt.select("a", "block").distinct().join(sets.withColumnRenamed("rep", "a"), "a")
    heads = heads.select("a", "block", F.lit(0).alias("turn"), F.col("a").alias("b"), "n", "set")

    def compare(batches):
        group, heads = None, {}
        for batch in batches:
            first, block, turn, second, n = (batch.column(c).to_numpy() for c in range(5))
            kept = np.zeros(batch.num_rows, dtype=bool)
            for i, found in enumerate(batch.column(5)):
                if isinstance(found, pa.ListScalar):
                    found = found.values.to_numpy()
                else:
                    found = np.frombuffer(found.as_buffer(), dtype=np.uint8)
                if turn[i] == 0:
                    if group != (first[i], block[i]):
                        group, heads = (first[i], block[i]), {}
                    # one head, or one for each different text of a doc_id; copied, as it outlives the batch
                    heads[found.tobytes()] = (int(n[i]), found.copy())
                else:
                    kept[i] = any(passes(*head, int(n[i]), found) for head in heads.values())
            yield pa.RecordBatch.from_arrays([pa.array(first[kept]), pa.array(second[kept])], ["a", "b"])
        give_back()

    rows = heads.union(members).repartition("a", "block").sortWithinPartitions("a", "block", "turn")
    return rows.mapInArrow(compare, "a bigint, b bigint").distinct()


def possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose bitmaps allow a link."""

    def near(na, x, nb, y):
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        gap = int(np.bitwise_count(x ^ y).sum(dtype=np.int64))
        return gap * (100 + percent) <= (100 - percent) * (na + nb)

    return _compared(pairs, bits, near)


def verified(docs: DataFrame, pairs: DataFrame, length: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets reach the threshold."""

    def link(na, x, nb, y):
        x, y = x.view(U64), y.view(U64)
        small, large = (x, y) if len(x) <= len(y) else (y, x)
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        both = int(np.count_nonzero(large[at] == small))
        return 100 * both >= percent * (na + nb - both)

    return _compared(pairs, written(_of_sets(docs, _ends(pairs), length, bitmaps=False), "sets"), link)


def _pair(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _stars(postings: DataFrame, percent: int) -> DataFrame:
    """Every set of an entry with the entry's heaviest set: the one with the most company in all entries."""
    company = postings.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    weight = postings.join(company, "key").groupBy("rep").agg(F.sum("m").alias("weight"))
    hubs = (
        postings.join(weight, "rep")
        .groupBy("key")
        .agg(F.max(F.struct("weight", (-F.col("rep")).alias("order"), F.col("rep").alias("hub"), F.col("n").alias("hub_n"))).alias("top"))
        .select("key", "top.hub", "top.hub_n")
    )
    small, large = F.least("n", "hub_n"), F.greatest("n", "hub_n")
    met = postings.join(hubs, "key").filter((F.col("rep") != F.col("hub")) & (100 * small >= percent * large))
    # two sets may be each other's hub: the pair is compared once
    once = met.groupBy(*_pair(F.col("rep"), F.col("hub"))).agg(F.min("hub").alias("hub"))
    return once.select(F.col("hub").alias("a"), F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("b"))


def _hamming_pairs(group: list[pa.RecordBatch], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different components in one block whose bitmaps allow a link."""
    rows = pa.Table.from_batches(group)
    side_i, side_j, rep, n, label = (rows.column(c).to_numpy() for c in ("i", "j", "rep", "n", "label"))
    block = rows.column("block").to_numpy()
    order = np.argsort(n, kind="stable")
    rep, n, label, block = rep[order], n[order], label[order], block[order]
    bits = [np.frombuffer(b.as_py(), dtype=np.uint8) for b in rows.column("set").take(pa.array(order))]
    one_block = side_i[0] == side_j[0]
    width = np.array([len(b) for b in bits])
    for k in range(len(rep) - 1):
        hi = int(np.searchsorted(n, n[k] * 100 // percent, side="right"))
        near = np.arange(k + 1, hi)
        near = near[label[near] != label[k]]
        if not one_block:
            near = near[block[near] != block[k]]
        hit = []
        for w in np.unique(width[near]):
            same = near[width[near] == w]
            other = np.stack([bits[i] for i in same])
            while other.shape[1] > width[k]:
                half = other.shape[1] // 2
                other = _fold(other, half)
            gap = np.bitwise_count(other ^ bits[k]).sum(axis=1, dtype=np.int64)
            # with g shingles on one side only: 100 * (s - g) >= percent * (s + g), s being both sizes
            total = n[same] + n[k]
            hit.append(same[gap * (100 + percent) <= (100 - percent) * total])
        hit = np.concatenate(hit) if hit else near[:0]
        if len(hit):
            yield np.minimum(rep[hit], rep[k]), np.maximum(rep[hit], rep[k])


def _fold(packed: np.ndarray, half: int) -> np.ndarray:
    """The bitmaps at half their size: the upper half laid over the lower."""
    return packed[:, :half] ^ packed[:, half:]


def _rest(postings: DataFrame, labels: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs across components that share an entry and that the bitmaps do not rule out."""
    marked = postings.join(labels, postings["rep"] == labels["node"], "left").select(
        "key", "rep", "n", F.coalesce("component", "rep").alias("label")
    )
    open_ = (
        marked.groupBy("key")
        .agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        .filter("lo <> hi")
        .select("key", F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("blocks"))
    )
    dealt = marked.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    squares = dealt.select("key", "rep", "n", "label", "block", other.alias("o")).select(
        "key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "rep", "n", "label", "block"
    )
    rows = squares.join(bits.select("rep", "set"), "rep").select("key", "i", "j", "rep", "n", "label", "block", "set")

    def compare(batches):
        for group in sorted_groups(batches, 3):
            for a, b in _hamming_pairs(group, percent):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(compare, "a bigint, b bigint").distinct()


def _same_document(linked: DataFrame, members: DataFrame) -> DataFrame:
    """Links that keep together the texts of a ``doc_id`` that has several."""
    text = ["d1", "d2", "n"]
    seen = F.struct(*text)
    several = linked.groupBy("doc_id").agg(F.min(seen).alias("low"), F.max(seen).alias("high")).filter("low <> high")
    rows = linked.join(several.select("doc_id"), "doc_id", "left_semi").select("doc_id", *text).distinct()
    found = rows.join(members, text).filter("doc_id <> rep")
    return found.select(*_pair(F.col("doc_id"), F.col("rep"))).distinct()


def ngram_jaccard_join(
    docs: DataFrame, length: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT
) -> tuple[DataFrame, DataFrame]:
    """Documents with their component, and the links that were found between representatives.

    The first table has a row for each row of ``docs``: ``doc_id``, ``n_shingles`` and
    ``component_id``, the smallest ``doc_id`` reachable by links of at least ``percent``
    per cent. Copies are represented by their smallest ``doc_id``. The second table has
    ``a`` and ``b``: links enough to connect every component.

    A document without words, or null, has no shingles and is its own component. Rows with
    one ``doc_id`` count as one document that has the links of all its texts. A null
    ``doc_id`` takes no part: its component is null. Other columns are ignored. An empty
    table gives empty tables.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = docs.sparkSession.sparkContext.broadcast(frequent_cells(docs, length, frequent))
    index = written(_index(docs, length, percent, bits), "index")
    linked = index.filter("doc_id is not null and n > 0")
    reps = linked.groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "keys")).alias("first"))
    entries = reps.select(F.explode("first.keys").alias("key"), "n", F.col("first.doc_id").alias("rep"))
    postings = written(_shared(entries, percent), "postings")

    text = ["d1", "d2", "n"]
    members = linked.groupBy(*text).agg(F.min("doc_id").alias("rep"))
    known = postings.select("rep").distinct()
    parity = written(_of_sets(docs, known, length, bitmaps=True), "bits")
    near = written(possible(written(_stars(postings, percent), "hubs"), parity, percent), "near")
    stars = written(verified(docs, near, length, percent).union(_same_document(linked, members)), "stars")
    groups = components(stars)
    near = written(_rest(postings, groups, parity, percent), "near")
    rest = written(verified(docs, near, length, percent), "rest")
    links = stars.union(rest)
    if not rest.isEmpty():
        groups = components(links)

    named = members.join(groups, members["rep"] == groups["node"], "left").select(
        *text, F.coalesce("component", "rep").alias("component")
    )
    large = written(named.join(F.broadcast(_large(index, *text).select(*text)), text), "large")
    some, whole = index.filter("doc_id is not null and n > 0"), index.filter("doc_id is null or n = 0")
    parts = [
        some.join(F.broadcast(large), text),
        some.join(F.broadcast(large), text, "left_anti").join(named, text),
        whole.withColumn("component", F.col("doc_id")),
    ]
    found = reduce(DataFrame.union, [p.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")) for p in parts])
    return found, links


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of ``found``: the one with the smallest ``doc_id``.

    Of rows with one ``doc_id`` one stays. Rows with a null ``doc_id`` stay. Only rows that
    may have to go are shuffled. All columns stay, whatever their names.
    """
    docs, back = set_aside(docs, "doc_id", "text")
    same = F.max(F.col("component_id") == F.col("doc_id")).alias("first")
    seen = found.filter("doc_id is not null").groupBy("doc_id").agg(same, F.count(F.lit(1)).alias("rows"))
    touched = written(seen.filter("not first or rows > 1").select("doc_id", "first"), "touched")
    some, others = split(docs, touched.withColumnRenamed("doc_id", "_id"), "doc_id", "_id")
    marked = some.join(touched.select(F.col("doc_id").alias("_id"), F.col("first").alias("_first")), F.col("doc_id") == F.col("_id"), "left")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    listed = marked.filter("_id is not null and _first").withColumn("_place", place).filter("_place = 1")
    out = others.union(marked.filter("_id is null").select(docs.columns)).union(listed.select(docs.columns))
    return out.select(*back)
