"""Spelling variants: words one edit apart, found by scanning sorted vocabulary.

Two words one edit apart agree up to the edit and after it, so one half of the shorter
agrees in full. Words are grouped by the first and by the last half of the shorter length;
a pair is looked for in the first group that holds both. A group that is too large is cut
again in the same way, by half of what is left between the shared ends, until it is small
or one character is left, of which there are few.

Within a group the words lie sorted by what is between the shared ends. The list is scanned
depth by depth: a range of words with a common prefix shares one row of the edit matrix for
each word it is compared with (three cells, as more than one edit does not matter). The
lengths of common prefixes with the word before cut a range into those of the next depth.
A range whose row holds no cell below two is left with all its words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.llm.tables import map_arrow, written
from trajspark.llm.words import rows_between

LEAST_LENGTH = 6
LEAST_COUNT = 5
TIMES = 5
DELETE_EVERY = 199

#: A larger group of words is cut again, unless one character is left to differ.
GROUP_WORDS = 4096
#: Words of whole groups that are scanned together, and words compared with a group at once.
SCAN_WORDS = 8192
PAIRS_AT_ONCE = 500_000
FLUSH_WORDS = 200_000

# Letters of words, and A to Z with their small letters.
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
FAR = 3


def marked_word(doc_id: int | None, run: str, every: int = DELETE_EVERY) -> str:
    """``run`` in lower case, without one letter where the digest of document and run says so."""
    word = run.lower() if run.isascii() else run.translate(_LOWER)
    digest = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if digest % every == 0:
        at = digest % len(word)
        word = word[:at] + word[at + 1 :]
    return word


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n`` of all words of at least ``LEAST_LENGTH`` letters that occur ``least_count`` times.

    Words are counted by document, then by batch, before they are shuffled.
    """

    def count(batch):
        seen: dict[str, int] = {}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for run, n in Counter(_RUN.findall(text.as_py() or "")).items():
                word = marked_word(doc_id, run)
                if len(word) >= LEAST_LENGTH:
                    seen[word] = seen.get(word, 0) + n
            if len(seen) >= FLUSH_WORDS:
                yield _counted(seen)
                seen = {}
        yield _counted(seen)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = map_arrow(texts, count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _counted(seen: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])


# Groups. A group's words agree in their first ``p`` and last ``s`` letters, the shortest
# have ``m`` letters, the others one more. ``below`` bounds the common prefix of the pairs
# that the group is asked for; pairs that agree further are found in another group.
KEYS = ("m", "p", "s", "below", "head", "tail")


def _middle() -> Column:
    """Letters of the shortest words of a group between the shared ends."""
    return F.col("m") - F.col("p") - F.col("s")


def _halves(rows: DataFrame) -> DataFrame:
    """Both groups that a word of a group is in after one more cut."""
    half = F.floor(_middle() / 2).cast("int")
    below = F.least("below", F.col("p") + half)
    first = rows.select("word", "n", "l", "m", (F.col("p") + half).alias("p"), "s", "below")
    last = rows.select("word", "n", "l", "m", "p", (F.col("s") + _middle() - half).alias("s"), below.alias("below"))
    head = F.substring(F.col("word"), F.lit(1), F.col("p")).alias("head")
    tail = F.substring(F.col("word"), F.col("l") - F.col("s") + 1, F.col("s")).alias("tail")
    return first.union(last).select("word", "n", "l", "m", "p", "s", "below", head, tail)


def groups(words: DataFrame, largest: int = GROUP_WORDS) -> list[DataFrame]:
    """Tables of words with the key of their group; every pair to look for is in exactly one group."""
    length = F.char_length("word")
    shortest = F.explode(F.array(length, length - 1))  # a word is the shorter of a pair, or the longer
    now = words.select("word", "n", length.alias("l"), shortest.alias("m")).select(
        "*", F.lit(0).alias("p"), F.lit(0).alias("s"), (F.col("m") + 1).alias("below")
    )
    done = []
    while True:
        now = written(_halves(now), "spelling")
        sizes = now.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_words"))
        large = written(sizes.filter((F.col("_words") > largest) & (_middle() > 1)).select(*KEYS), "large")
        if large.isEmpty():
            done.append(now)
            return done
        done.append(now.join(large, list(KEYS), "left_anti"))
        now = now.join(large, list(KEYS), "left_semi").select("word", "n", "l", "m", "p", "s", "below")


class SortedList:
    """Whole groups of words, each sorted by its middle; one byte is one letter."""

    def __init__(self, words: list[str], group: np.ndarray, m: np.ndarray, p: np.ndarray, s: np.ndarray, below: np.ndarray):
        size = np.array([len(w) for w in words], dtype=np.int64)
        self.data = np.frombuffer("".join(words).encode("latin-1") + b"\0", dtype=np.uint8)
        self.start = np.cumsum(size) - size + p
        self.length = size - p - s  # of the middle
        self.group, self.size, self.p, self.below = group, size, p, below
        self.shortest = size == m
        self.common = self._common()

    def letter(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Letter ``at`` of the middles; 0, which no word has, outside."""
        inside = (at >= 0) & (at < self.length[rows])
        found = self.data[np.where(inside, self.start[rows] + at, 0)]
        return np.where(inside, found, 0)

    def _common(self) -> np.ndarray:
        """Length of the common prefix of every middle and the one before, 0 at the start of a group."""
        common = np.zeros(len(self.group), dtype=np.int64)
        rows = np.flatnonzero(self.group[1:] == self.group[:-1]) + 1
        depth = 0
        while len(rows):
            depths = np.full(len(rows), depth)
            here = self.letter(rows, depths)
            rows = rows[(here != 0) & (here == self.letter(rows - 1, depths))]
            common[rows] += 1
            depth += 1
        return common

    def agreement(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of two different words."""
        agree = np.zeros(len(a), dtype=np.int64)
        rows = np.arange(len(a))
        while len(rows):
            x, y, at = a[rows], b[rows], agree[rows]
            rows = rows[(at < self.size[x]) & (at < self.size[y])]
            x, y, at = a[rows], b[rows], agree[rows]
            rows = rows[self.data[self.start[x] - self.p[x] + at] == self.data[self.start[y] - self.p[y] + at]]
            agree[rows] += 1
        return agree

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query (a row) and a row of its group, one edit apart, that the group is asked for."""
        bounds = np.flatnonzero(np.append(np.diff(self.group, prepend=-1) != 0, True))
        own = np.searchsorted(bounds, queries, side="right") - 1
        used, node = np.unique(own, return_inverse=True)
        # ranges of words with a common prefix, and rows of the edit matrix of query and range
        lo, hi = bounds[used], bounds[used + 1]
        query = queries
        left = np.full(len(query), FAR, dtype=np.int8)
        here = np.zeros(len(query), dtype=np.int8)
        right = np.where(self.length[query] > 0, 1, FAR).astype(np.int8)
        found_a, found_b = [], []
        depth = 0
        while len(query):
            # the word that ends here is the first of its range
            ends = self.length[lo] == depth
            at = np.flatnonzero(ends[node])
            more = self.length[query[at]] - depth
            cost = np.select([more == -1, more == 0, more == 1], [left[at], here[at], right[at]], FAR)
            a, b = query[at], lo[node[at]]
            hit = (cost == 1) & (self.shortest[a] | self.shortest[b])
            found_a.append(a[hit])
            found_b.append(b[hit])
            # ranges of the next depth begin where the common prefix ends
            rows = rows_between(lo + ends, hi)
            parent = np.repeat(np.arange(len(lo)), hi - lo - ends)
            begins = np.ones(len(rows), dtype=bool)
            if len(rows):
                begins[1:] = (self.common[rows[1:]] <= depth) | (parent[1:] != parent[:-1])
            first = np.flatnonzero(begins)
            child_lo, child_of = rows[first], parent[first]
            child_hi = child_lo + np.diff(np.append(first, len(rows)))
            count = np.bincount(child_of, minlength=len(lo))
            place = np.cumsum(count) - count
            # every pair of a query and a range meets the ranges within it
            pair = np.repeat(np.arange(len(query)), count[node])
            child = rows_between(place[node], place[node] + count[node])
            q, c = query[pair], self.letter(child_lo[child], np.full(len(child), depth))
            size = self.length[q]
            to_left = np.minimum(left[pair] + (self.letter(q, np.full(len(q), depth - 1)) != c), here[pair] + 1)
            to_here = np.minimum(np.minimum(here[pair] + (self.letter(q, np.full(len(q), depth)) != c), right[pair] + 1), to_left + 1)
            to_right = np.minimum(right[pair] + (self.letter(q, np.full(len(q), depth + 1)) != c), to_here + 1)
            to_left = np.where(depth <= size, to_left, FAR)
            to_here = np.where(depth + 1 <= size, to_here, FAR)
            to_right = np.where(depth + 2 <= size, to_right, FAR)
            stay = np.minimum(np.minimum(to_left, to_here), to_right) <= 1
            left, here, right = (v[stay].astype(np.int8) for v in (to_left, to_here, to_right))
            query = q[stay]
            used, node = np.unique(child[stay], return_inverse=True)
            lo, hi = child_lo[used], child_hi[used]
            depth += 1
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        asked = self.agreement(a, b) < self.below[a]
        return a[asked], b[asked]


def _whole(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Slices of about ``least`` rows that end where a group ends."""
    held, rows, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = np.append(change, batch.num_rows)
        if held and keys[0] != last and rows >= least:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
        lo = 0
        while lo < batch.num_rows:
            at = np.searchsorted(edges, lo + max(least - rows, 1))
            hi = int(edges[min(at, len(edges) - 1)])
            held.append(batch.slice(lo, hi - lo))
            rows += hi - lo
            lo = hi
            if lo < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of every word, by group: their number and the best of them."""
    for table in _whole(batches, SCAN_WORDS):
        digest = table.column("_key").to_numpy()
        heads = [table.column(c).to_pylist() for c in ("head", "tail")]
        m, p, s, below = (table.column(c).to_numpy().astype(np.int64) for c in ("m", "p", "s", "below"))
        words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        same = (digest[1:] == digest[:-1]) & (m[1:] == m[:-1]) & (p[1:] == p[:-1]) & (s[1:] == s[:-1]) & (below[1:] == below[:-1])
        for ends in heads:
            same &= np.fromiter((x == y for x, y in zip(ends[1:], ends)), dtype=bool, count=len(same))
        group = np.concatenate([[0], np.cumsum(~same)])
        size = np.bincount(group)
        several = size[group] > 1
        if not several.any():
            continue
        listed = SortedList(words, group, m, p, s, below)
        # as many queries at once as keep the pairs with the first letters few
        todo = np.flatnonzero(several)
        cost = np.cumsum(np.minimum(size[group[todo]], 256))
        cuts = np.searchsorted(cost, np.arange(PAIRS_AT_ONCE, cost[-1] + PAIRS_AT_ONCE, PAIRS_AT_ONCE), side="left") + 1
        pairs = [listed.near(part) for part in np.split(todo, cuts[cuts < len(todo)]) if len(part)]
        a, b = (np.concatenate(side) for side in zip(*pairs))
        if not len(a):
            continue
        order = np.lexsort((-n[b], a))  # a stable order: of equal counts, see ``best`` below
        a, b = a[order], b[order]
        edges = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        owner = a[edges]
        near = np.diff(np.append(edges, len(a)))
        most = np.repeat(n[b[edges]], near)
        tied = n[b] == most
        best = {}
        for i, j in zip(a[tied].tolist(), b[tied].tolist()):
            if i not in best or words[j] < words[best[i]]:
                best[i] = j
        chosen = [best[i] for i in owner.tolist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([words[i] for i in owner.tolist()], pa.string()),
                pa.array(near.astype(np.int64)),
                pa.array(n[np.array(chosen)].astype(np.int64)),
                pa.array([words[j] for j in chosen], pa.string()),
            ],
            ["word", "n_near", "form_n", "form"],
        )


def near_words(words: DataFrame, largest: int = GROUP_WORDS) -> DataFrame:
    """``word``, ``n_near``, and its best near word ``form`` with ``form_n``, for words that have near words.

    ``words`` has distinct ``word`` (letters up to U+00FF, at least three) and ``n``.
    """
    found = None
    for part in groups(words, largest):
        key = F.xxhash64(*KEYS)
        middle = F.substring(F.col("word"), F.col("p") + 1, F.col("l") - F.col("p") - F.col("s"))
        placed = part.select(key.alias("_key"), *KEYS, middle.alias("_middle"), "word", "n")
        together = placed.repartition("_key").sortWithinPartitions("_key", *KEYS, "_middle")
        near = together.mapInArrow(_scan, "word string, n_near bigint, form_n bigint, form string")
        found = near if found is None else found.union(near)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form")
    )


def spelling_variants(docs: DataFrame, times: int = TIMES, least_count: int = LEAST_COUNT, largest: int = GROUP_WORDS) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of the vocabulary of ``docs``.

    ``form`` is the most frequent word one edit away (ties: the smaller), if it occurs
    ``times`` as often; ``root`` follows the forms to the last. A null or empty text has no
    words, a very long one is read whole. Repeated rows count each. A null ``doc_id`` gives
    an empty number in the digest. Other columns are ignored. An empty table gives no rows.
    """
    words = written(vocabulary(docs, least_count), "vocabulary")
    near = near_words(words, largest)
    known = written(
        words.join(near, "word", "left").select(
            "word",
            F.when(F.col("form_n") >= times * F.col("n"), F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(F.col("form_n") >= times * F.col("n"), F.col("form_n")).alias("form_n"),
        ),
        "variants",
    )
    # counts grow by ``times`` with every step, so chains are short; each round doubles the step
    moved = written(known.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = moved.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        step = moved.join(further, "root", "left")
        new = written(step.select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("_moved")), "roots")
        moved = new.select("word", "root")
        if new.filter("_moved").isEmpty():
            break
    return known.join(moved, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
