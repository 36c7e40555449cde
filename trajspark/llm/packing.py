"""Packing of documents into sequences by bounded-space best fit.

Every partition packs its own documents with a fixed number of open windows: full windows
are cut off a document, the rest goes into the open window that it fills best. If it fits
in none and no more may be opened, the fullest is filled up with the head of the piece (a
gap of up to ``waste`` ids is left) and emitted. The windows that are open at the end of
a partition, a bounded number, are merged: those of ``FAN_IN`` partitions are packed
anew, the largest pieces first, until one group is left, which closes its windows one
after the other. Only its last window has more than ``waste`` ids of padding.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm import tokens
from trajspark.llm.tables import give_back, sorted_groups, written

LENGTH = 2048
OPEN_WINDOWS = 64
WASTE = 16
FAN_IN = 32
END_ID = 1

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, part int"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("part", pa.int32()),
    ]
)
FLUSH_ROWS = 500


class Windows:
    """The open windows of one partition. A piece is (doc_id, start, length, ids, doc_tokens)."""

    def __init__(self, part: int, step: int, length: int, limit: int, waste: int):
        self.part, self.length, self.limit, self.waste = part, length, limit, waste
        self.next_id = (step << 58) | (part << 32)
        self.free: list[tuple[int, int]] = []  # free ids and number of each open window, sorted
        self.held: dict[int, list[tuple]] = {}
        self.opened = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.rows.append((*piece, self.next_id, offset, self.part))
            offset += piece[2]
        self.next_id += 1

    def add(self, piece: tuple) -> None:
        """Place a piece of at most a window's length."""
        doc, start, size, ids, total = piece
        if size == self.length:
            self.emit([piece])
            return
        at = bisect_left(self.free, (size, -1))
        if at == len(self.free):
            if len(self.free) < self.limit:
                self.opened += 1
                self.held[self.opened] = [piece]
                insort(self.free, (self.length - size, self.opened))
                return
            gap, number = self.free.pop(0)
            pieces = self.held.pop(number)
            if gap > self.waste:
                pieces.append((doc, start, gap, ids[: 4 * gap], total))
                piece = (doc, start + gap, size - gap, ids[4 * gap :], total)
            self.emit(pieces)
            self.add(piece)
            return
        gap, number = self.free.pop(at)
        self.held[number].append(piece)
        if gap == size:
            self.emit(self.held.pop(number))
        else:
            insort(self.free, (gap - size, number))

    def leave(self) -> None:
        """Hand out the open windows' pieces without a sequence."""
        for _, number in self.free:
            self.rows += [(*piece, None, None, self.part) for piece in self.held[number]]
        self.free, self.held = [], {}

    def close(self) -> None:
        """Fill sequences one after the other with what is open."""
        pieces = [piece for _, number in self.free for piece in self.held[number]]
        self.free, self.held = [], {}
        now, room = [], self.length
        for doc, start, size, ids, total in pieces:
            while size:
                head = min(size, room)
                now.append((doc, start, head, ids[: 4 * head], total))
                start, size, ids, room = start + head, size - head, ids[4 * head :], room - head
                if not room:
                    self.emit(now)
                    now, room = [], self.length
        if now:
            self.emit(now)

    def taken(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            columns = zip(*self.rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
            self.rows = []


def pack(
    docs: DataFrame,
    tokenizer: str = tokens.TOKENIZER,
    length: int = LENGTH,
    open_windows: int = OPEN_WINDOWS,
    waste: int = WASTE,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` ids.

    A document is its ids and ``end_id``. Every id is in one piece: ``doc_id``, ``start``
    (ids of the document before the piece), ``length``, ``ids`` (unsigned 32-bit little-endian),
    ``doc_tokens``, ``sequence_id`` and ``offset`` in the sequence.

    A null or empty text is ``end_id`` alone. Repeated rows are packed each; a null ``doc_id``
    stays null. Other columns are ignored. An empty table gives no pieces.
    """

    def first(batches):
        windows = Windows(TaskContext.get().partitionId(), 0, length, open_windows, waste)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for block, ids, bounds in tokens.token_blocks(batch.column(1), tokenizer):
                for d in range(len(bounds) - 1):
                    data = np.append(ids[bounds[d] : bounds[d + 1]], np.uint32(end_id)).astype("<u4").tobytes()
                    total, name = len(data) // 4, names[block.first + d]
                    for at in range(0, total, length):
                        part = data[4 * at : 4 * (at + length)]
                        windows.add((name, at, len(part) // 4, part, total))
                yield from windows.taken(FLUSH_ROWS)
        windows.leave()
        yield from windows.taken()
        give_back()

    def again(step: int, last: bool):
        def run(batches):
            for group in sorted_groups(batches, 1):
                rows = pa.Table.from_batches(group).to_pylist()
                windows = Windows(rows[0]["part"], step, length, open_windows, waste)
                for r in rows:
                    windows.add((r["doc_id"], r["start"], r["length"], r["ids"], r["doc_tokens"]))
                windows.close() if last else windows.leave()
                yield from windows.taken()

        return run

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    now = written(docs.mapInArrow(first, SCHEMA), "packed")
    done = [now.filter("sequence_id is not null")]
    parts = (now.agg(F.max("part")).first()[0] or 0) + 1
    step = 0
    while True:
        step, parts = step + 1, -(-parts // FAN_IN)
        open_ = now.filter("sequence_id is null").select(
            F.expr(f"part div {FAN_IN}").cast("int").alias("part"), "doc_id", "start", "length", "ids", "doc_tokens"
        )
        order = ["part", F.desc("length"), "doc_id", "start", F.crc32("ids")]
        now = open_.repartition("part").sortWithinPartitions(*order).mapInArrow(again(step, parts == 1), SCHEMA)
        if parts == 1:
            return _union([*done, now])
        now = written(now, "packed")
        done.append(now.filter("sequence_id is not null"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out.drop("part")
