"""Edit-aware token counts.

The text of a document is cut into pieces at places where the vocabulary's own splitting
always cuts. The pieces are the leaves of a segment tree that holds characters and tokens
of every subtree. An edit finds the leaves that it touches by their characters, takes in
neighbours until the region starts and ends at such a place again, encodes only the
region, and updates the sums above it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm import tokens
from trajspark.llm.tables import map_arrow

LEAF = 512
#: An edit: replace the code points from the first to before the second by the text.
Edit = tuple[int, int, str]

# All white space, and the white space before which a text may be cut.
_SPACES = "\x09-\x0d\x20\x85\xa0  -     　"
_CUT = re.compile(f"(?<=[^{_SPACES}])(?=[\x20\x09-\x0d])")
_SPACE = re.compile(f"[{_SPACES}]")

# Personal data that the query masks.
MAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PHONE = re.compile(r"\+?[0-9][0-9()\x20.-]{7,16}[0-9]")


def count_tokens(texts: list[str], path: str, ranks: str) -> list[int]:
    out: list[int] = []
    for _, _, bounds in tokens.token_blocks(pa.array(texts, pa.large_string()), path, ranks):
        out += np.diff(bounds).tolist()
    return out


def pieces(text: str) -> list[str]:
    """The text in leaves of ``LEAF`` characters or a little more."""
    out, start = [], 0
    while found := _CUT.search(text, start + LEAF):
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


class CountTree:
    """Characters and tokens of a document, by leaves; ``count`` gives the tokens of texts."""

    def __init__(self, leaves: Sequence[str], counts: Sequence[int], count: Callable[[list[str]], list[int]]):
        self.count = count
        self.leaves = list(leaves)
        self.size = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.chars = [0] * (2 * self.size)
        self.tokens = [0] * (2 * self.size)
        self.encoded = 0
        for i, (leaf, n) in enumerate(zip(self.leaves, counts)):
            self.chars[self.size + i], self.tokens[self.size + i] = len(leaf), n
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _set(self, i: int, leaf: str, tokens: int) -> None:
        self.leaves[i] = leaf
        node = self.size + i
        self.chars[node], self.tokens[node] = len(leaf), tokens
        while node := node // 2:
            self._sum(node)

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a code point (the last with text for the end), and the characters before it."""
        node, before = 1, 0
        while node < self.size:
            left = 2 * node
            node = left
            if place - before >= self.chars[left] and self.chars[left + 1]:
                before += self.chars[left]
                node = left + 1
        return node - self.size, before

    def _beside(self, i: int, step: int) -> int | None:
        i += step
        while 0 <= i < len(self.leaves) and not self.leaves[i]:
            i += step
        return i if 0 <= i < len(self.leaves) else None

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace ``[start, end)`` of the text as it is now; places beyond its end mean its end."""
        whole = self.chars[1]
        start = min(max(start, 0), whole)
        end = min(max(end, start), whole)
        first, before = self._find(start)
        last, last_before = self._find(max(start, end - 1))
        region = self.leaves[first][: start - before] + new + self.leaves[last][end - last_before :]
        while (left := self._beside(first, -1)) is not None and not (region and _CUT.match(self.leaves[left][-1] + region, 1)):
            region, first = self.leaves[left] + region, left
        while (right := self._beside(last, 1)) is not None and (not region or _SPACE.match(region[-1]) or not _CUT.match(region[-1] + self.leaves[right], 1)):
            region, last = region + self.leaves[right], right
        self.encoded += len(region)
        tokens = self.count([region])[0]
        for i in range(first + 1, last + 1):
            if self.leaves[i]:
                self._set(i, "", 0)
        self._set(first, region, tokens)

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)


def mail_spans(text: str) -> list[tuple[int, int]]:
    """Mail addresses, found from their hosts back, so that a long run of letters takes linear time."""
    found, last = [], 0
    for m in MAIL_HOST.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in MAIL_NAME:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            last = m.end()
    return found


def mask_personal_data(text: str) -> list[Edit]:
    """Edits that replace mail addresses and phone numbers, from the last to the first."""
    found = [(start, end, "<email>") for start, end in mail_spans(text)] if "@" in text else []
    taken = [(s, e) for s, e, _ in found]
    found += [
        (m.start(), m.end(), "<phone>") for m in PHONE.finditer(text) if not any(s < m.end() and m.start() < e for s, e in taken)
    ]
    return sorted(found, reverse=True)


def edited_counts(
    docs: DataFrame,
    edits: str | Callable[[str], list[Edit]] = "edits",
    tokenizer: str = tokens.TOKENIZER,
    ranks: str = tokens.RANKS,
) -> DataFrame:
    """Tokens before and after the edits of every document.

    ``edits`` is a function of the text or a column of arrays of structs (start, end, text),
    applied in their order, each to the text as it is then. One row for each row of ``docs``:
    ``doc_id``, ``tokens_before``, ``tokens``, ``n_edits``, ``encoded_chars`` (characters that
    were encoded again) and ``edited_chars`` (length of the text at the end).

    A null or empty text has no tokens and can be inserted into. Null edits are none; a null
    replacement is empty. Places beyond the text mean its end. Repeated rows and null ids are
    counted like others. Other columns are ignored.
    """
    by_column = isinstance(edits, str)

    def count(batch):
        def tokens_of(texts: list[str]) -> list[int]:
            return count_tokens(texts, tokenizer, ranks)

        texts = [t or "" for t in batch.column(1).to_pylist()]
        if by_column:
            todo = [
                [(e["start"] or 0, e["end"] or 0, e["text"] or "") for e in row or [] if e] for row in batch.column(2).to_pylist()
            ]
        else:
            todo = [edits(t) for t in texts]
        cut = [pieces(t) if e else [t] for t, e in zip(texts, todo)]
        sizes = tokens_of([p for some in cut for p in some])
        out, at = [], 0
        for text, some, changes in zip(texts, cut, todo):
            own = sizes[at : at + len(some)]
            at += len(some)
            if changes:
                tree = CountTree(some, own, tokens_of)
                for change in changes:
                    tree.edit(*change)
                out.append((sum(own), tree.total, len(changes), tree.encoded, tree.chars[1]))
            else:
                out.append((sum(own), sum(own), 0, 0, len(text)))
        columns = [pa.array(c, pa.int64()) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *columns], ["doc_id", "tokens_before", "tokens", "n_edits", "encoded_chars", "edited_chars"]
        )

    def split(batch):
        for at in range(0, batch.num_rows, 256):  # bounds what is held as Python strings
            yield from count(batch.slice(at, 256))

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *([F.col(edits).cast("array<struct<start:bigint,end:bigint,text:string>>").alias("edits")] if by_column else []),
    )
    schema = "doc_id bigint, tokens_before bigint, tokens bigint, n_edits bigint, encoded_chars bigint, edited_chars bigint"
    return map_arrow(rows, split, schema)
