"""Secret scans: fixed patterns, and values in a credential context that are hard to guess.

Three patterns find assigned secrets, access keys and long hexadecimal runs. Besides, a
value that follows a credential word is judged by the number of guesses that it takes: a
dynamic program splits it into common words, dates, repeats, keyboard walks and brute
force at least cost. Placeholders and simple phrases are cheap; a value that costs at least
``10 ** MIN_GUESSES`` guesses is a secret, whatever characters it has. Every such value is
judged, also one within a match of a pattern.

Words cost by their rank: a short list of words of passwords comes first, then the most
frequent words of the documents themselves (at most ``MAX_WORDS``, which are broadcast).
Words that stand where a value would stand are not counted.

Texts without a credential word, a key prefix or a hexadecimal run are passed over by a
scan of their bytes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm import words as W
from trajspark.llm.tables import map_arrow, set_aside, written

MIN_GUESSES = 8.0
MIN_VALUE = 6
LONGEST_MATCH = 40
SEGMENT_COST = 0.3
#: Of a letter in brute force: two bits, as in running text; other characters are one of ten.
LETTER_COST = 0.6
MASK = "[SECRET]"
#: Words of the documents that are known to the guesser: how many, how often seen, their bytes.
MAX_WORDS = 20_000
MIN_SEEN = 20
MIN_WORD, LONGEST_WORD = 3, 24

# The three patterns, the shortest match of each, and their order.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

# Credential words, and what stands between one and its value.
CONTEXT = re.compile(
    r"(?<![A-Za-z])(?:password|passwd|passphrase|passcode|pwd|secret|token|api[ _-]?key|access[ _-]?key|credentials?)"
    r"[\"']?\x20*(?:[:=]|=>|\x20is\x20)\x20*(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"',;]+))",
    re.ASCII | re.IGNORECASE,
)
HINTS = (b"passw", b"passp", b"passc", b"pwd", b"secret", b"token", b"api", b"access", b"credential")

# Common words of passwords and placeholders, the most common first.
COMMON_WORDS = (
    "password passwd pass admin root user test guest login welcome letmein monkey dragon master shadow sunshine "
    "princess football baseball superman batman iloveyou trustno hello freedom whatever qwerty secret token key "
    "changeme change example sample dummy default demo your here none null true false placeholder insert enter my "
    "the this that value string redacted hidden removed server database public private access api prod production "
    "dev staging local host summer winter spring autumn january february march april may june july august "
    "september october november december monday friday sunday love god money happy lucky star tiger flower blue "
    "red green black white cheese coffee computer internet soccer hockey killer pepper ginger cookie orange"
).split()
# Rows along which keys follow each other, and letters that stand for others.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujmikolp")
LEET = str.maketrans("0134578@$!", "oieastbasi")
# Years, months and days as they are written, and how many of each there are.
YEAR, MONTH, DAY, BETWEEN = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"[-/._]?"
DATES = (
    (re.compile(YEAR, re.ASCII), 140),
    (re.compile(YEAR + BETWEEN + MONTH, re.ASCII), 140 * 12),
    (re.compile(YEAR + BETWEEN + MONTH + BETWEEN + DAY, re.ASCII), 140 * 366),
    (re.compile(DAY + BETWEEN + MONTH + BETWEEN + YEAR, re.ASCII), 140 * 366),
)

_NEXT = {pair for row in WALKS for way in (row, row[::-1]) for pair in zip(way, way[1:])}


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of the words that a guesser tries, and their lengths."""

    ranks: dict[str, int]
    lengths: tuple[int, ...]


def vocabulary(words: Iterable[str] = ()) -> Vocabulary:
    """The common words, then ``words``, the most frequent first."""
    ranks = {word: rank for rank, word in enumerate(dict.fromkeys([*COMMON_WORDS, *words]), start=1)}
    return Vocabulary(ranks, tuple(sorted({len(w) for w in ranks})))


COMMON = vocabulary()


def guess_cost(value: str, known: Vocabulary = COMMON) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation of ``value`` takes."""
    low = value.lower() if len(value.lower()) == len(value) else value
    plain = low.translate(LEET)
    n = len(value)
    best = [0.0] + [math.inf] * n
    # how many characters from each place on equal those one period later
    same = {period: [0] * (n + 1) for period in range(1, 9)}
    for period, run in same.items():
        for i in range(n - period - 1, -1, -1):
            run[i] = run[i + 1] + 1 if low[i] == low[i + period] else 0

    def reach(end: int, cost: float) -> None:
        if cost < best[end]:
            best[end] = cost

    for i in range(n):
        base = best[i] + (SEGMENT_COST if i else 0.0)
        # brute force
        spent = base
        for j in range(i, min(n, i + LONGEST_MATCH)):
            spent += LETTER_COST if low[j].isalpha() else 1.0
            reach(j + 1, spent)
        for size in known.lengths:
            word = plain[i : i + size]
            if len(word) == size and word in known.ranks:
                cost = math.log10(known.ranks[word] + 1)
                cost += 0.3 * (value[i : i + size] != low[i : i + size]) + 0.3 * (word != low[i : i + size])
                reach(i + size, base + cost)
        for pattern, ways in DATES:
            if found := pattern.match(value, i):
                reach(found.end(), base + math.log10(ways))
        walk = i + 1
        while walk < min(n, i + LONGEST_MATCH) and (low[walk - 1], low[walk]) in _NEXT:
            walk += 1
            if walk - i >= 3:
                reach(walk, base + math.log10(47 * (walk - i)))
        for period, run in same.items():
            times = run[i] // period + 1
            # a long run ends after few repeats or with its last, so that it takes linear time
            for k in {*range(2, min(times, LONGEST_MATCH) + 1), times} if times > 1 else ():
                reach(i + k * period, base + period + math.log10(k))
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of the matches of the three patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= MIN_HEX]
    return sorted(out)


def judged_values(text: str, known: Vocabulary = COMMON) -> list[tuple[int, int, float]]:
    """Start, end and guess cost of every value of ``MIN_VALUE`` characters after a credential word."""
    found = (m.span(m.lastindex) for m in CONTEXT.finditer(text))
    return [(start, end, guess_cost(text[start:end], known)) for start, end in found if end - start >= MIN_VALUE]


def guessed_spans(judged: list[tuple[int, int, float]], least: float) -> list[tuple[int, int, int]]:
    """The values that cost at least ``least``, as spans."""
    return [(start, 3, end) for start, end, cost in judged if cost >= least]


_LETTERS = np.zeros(256, dtype=bool)
for _lo, _hi in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _LETTERS[_lo:_hi] = True
_STOPS, _ASSIGNS = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_STOPS[list(b".,;:!?")] = True
_ASSIGNS[list(b":=>")] = True


def _word_counts(block: W.Block) -> tuple[pa.Array, np.ndarray]:
    """The words of letters alone in a block, A to Z in lower case, and how often each occurs.

    One mark may follow a word. A word after ``:``, ``=`` or ``>`` may be a value and is left out.
    """
    found = W.find_words(block)
    start, end = found.start, found.end
    value = np.zeros(len(start), dtype=bool)
    value[1:] = _ASSIGNS[block.data[end[:-1] - 1]]
    value[found.bounds[:-1][found.counts > 0]] = False
    if len(end):
        end = end - _STOPS[block.data[end - 1]]
    letters = np.concatenate([[0], np.cumsum(_LETTERS[block.data])])
    size = end - start
    good = ~value & (letters[end] - letters[start] == size) & (size >= MIN_WORD) & (size <= LONGEST_WORD)
    start, end = start[good], end[good]
    _, one, counts = np.unique(W.stretch_hashes(block.data, start, end, lower=True), return_index=True, return_counts=True)
    start, end = start[one], end[one]
    data = W.LOWER[block.data[W.rows_between(start, end)]]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(one), pa.py_buffer(offsets), pa.py_buffer(data)), counts


def corpus_words(docs: DataFrame, most: int = MAX_WORDS, seen: int = MIN_SEEN) -> list[str]:
    """The ``most`` frequent words of all texts, the most frequent first, ties in byte order."""

    def count(batch):
        for block in W.blocks(batch.column(0)):
            words, counts = _word_counts(block)
            yield pa.RecordBatch.from_arrays([words, pa.array(counts, pa.int64())], ["word", "n"])

    counted = map_arrow(docs.select(F.col("text").cast("string").alias("text")), count, "word string, n bigint")
    total = written(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= seen), "words")
    # eight steps for each doubling of a count: the driver gets the steps that ``most`` words fill, not more
    step = F.floor(8 * F.log2("n")).cast("int")
    room, least = most, 0
    for r in total.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        room, least = room - r.words, r.step
        if room <= 0:
            break
    return [r.word for r in total.filter(step >= least).orderBy(F.desc("n"), "word").limit(most).collect()]


def _suspects(block: W.Block) -> np.ndarray:
    """Documents of a block that may hold a secret."""
    data = W.LOWER[block.data].tobytes()
    places = []
    for hint in (*HINTS, b"akia"):
        at = data.find(hint)
        while at >= 0:
            places.append(at)
            at = data.find(hint, at + len(hint))
    is_hex = ((block.data >= 0x30) & (block.data <= 0x39)) | ((block.data >= 0x61) & (block.data <= 0x66))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], is_hex.astype(np.int8), [0]])))
    start, end = edges[::2], edges[1::2]
    long = end - start >= MIN_HEX
    # a run of bytes may cross from one document to the next: all that it touches are looked at
    first = np.searchsorted(block.offsets, start[long], side="right") - 1
    last = np.searchsorted(block.offsets, end[long] - 1, side="right") - 1
    hinted = np.searchsorted(block.offsets, np.array(places, dtype=np.int64), side="right") - 1
    return np.unique(np.concatenate([hinted, W.rows_between(first, last + 1)])).astype(np.int64)


def _found(texts: pa.Array, known: Vocabulary) -> Iterator[tuple[int, str, list, list]]:
    """Row, text, base spans and judged values of every text that has any."""
    texts = texts.cast(pa.large_string()).fill_null("")
    for block in W.blocks(texts):
        for d in _suspects(block).tolist():
            text = texts[block.first + d].as_py()
            base = base_spans(text)
            judged = judged_values(text, known)
            if base or judged:
                yield block.first + d, text, base, judged


def _per_row(fields: pa.Array, per_row: list[list]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(row) for row in per_row])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), fields)


def _judged_lists(per_row: list[list]) -> pa.Array:
    flat = [v for row in per_row for v in row]
    columns = zip(("start", "end", "cost"), (pa.int64(), pa.int64(), pa.float64()))
    arrays = {name: pa.array([v[k] for v in flat], kind) for k, (name, kind) in enumerate(columns)}
    return _per_row(pa.StructArray.from_arrays(list(arrays.values()), list(arrays)), per_row)


def _span_lists(per_row: list[list]) -> pa.Array:
    flat = [s for row in per_row for s in row]
    values = pa.StructArray.from_arrays(
        [
            pa.array([KINDS[k] for _, k, _ in flat], pa.string()),
            pa.array([s for s, _, _ in flat], pa.int64()),
            pa.array([e for _, _, e in flat], pa.int64()),
        ],
        ["kind", "start", "end"],
    )
    return _per_row(values, per_row)


def _shared(docs: DataFrame, known: Vocabulary | None):
    """The vocabulary, from the documents themselves if none is given, at most ``MAX_WORDS`` of them, broadcast."""
    return docs.sparkSession.sparkContext.broadcast(known or vocabulary(corpus_words(docs)))


def scan(docs: DataFrame, min_guesses: float = MIN_GUESSES, known: Vocabulary | None = None) -> DataFrame:
    """Secrets of every document: ``doc_id``, ``base`` (spans of the patterns), ``spans`` (all), ``judged``.

    A span has ``kind``, ``start`` and ``end`` (code points, end exclusive); spans are in
    the order of their start, then of their kind. ``judged`` has ``start``, ``end`` and ``cost``
    of every value after a credential word. One row for each row of ``docs``. A null or
    empty text has none; an empty table gives none. A very long text is scanned as a whole, in
    one row and in linear time. Repeated rows and null ids are scanned like others (each counts
    for the words). Other columns are ignored. Without ``known``, words are counted first.
    """
    words = _shared(docs, known)

    def find(batch):
        base: list[list] = [[] for _ in range(batch.num_rows)]
        spans: list[list] = [[] for _ in range(batch.num_rows)]
        values: list[list] = [[] for _ in range(batch.num_rows)]
        for row, _, first, judged in _found(batch.column(1), words.value):
            base[row], values[row] = first, judged
            spans[row] = sorted(first + guessed_spans(judged, min_guesses))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), _span_lists(base), _span_lists(spans), _judged_lists(values)],
            ["doc_id", "base", "spans", "judged"],
        )

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    values = "array<struct<start:bigint,end:bigint,cost:double>>"
    return map_arrow(rows, find, f"doc_id bigint, base {span}, spans {span}, judged {values}")


def redact(docs: DataFrame, min_guesses: float = MIN_GUESSES, known: Vocabulary | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` (spans that overlap: their union) replaced by ``[SECRET]``.

    All rows and columns stay, whatever their names; a null text stays null, an empty table
    empty; repeated rows are masked alike, very long texts as a whole.
    """
    words = _shared(docs, known)
    docs, back = set_aside(docs, "text")
    at = docs.columns.index("text")

    def mask(batch):
        texts = batch.column(at)
        changed: dict[int, str] = {}
        for row, text, base, judged in _found(texts, words.value):
            out, end = [], 0
            for start, _, stop in sorted(base + guessed_spans(judged, min_guesses)):
                if start >= end:
                    out += [text[end:start], MASK]
                end = max(end, stop)
            changed[row] = "".join([*out, text[end:]])
        if changed:
            marked = np.zeros(batch.num_rows, dtype=bool)
            marked[list(changed)] = True
            new = pa.array([changed[r] for r in sorted(changed)], texts.type)
            batch = batch.set_column(at, batch.schema.field(at), pa.compute.replace_with_mask(texts, pa.array(marked), new))
        yield batch

    return map_arrow(docs, mask, docs.schema).select(*back)
