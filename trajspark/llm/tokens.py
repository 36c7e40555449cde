"""Token ids of whole texts by a public byte-level BPE vocabulary.

Texts are cut where white space follows another character: the vocabulary's own splitting
never joins such a pair, so the ids of a text are those of its chunks, one after the
other. Every different chunk is encoded once per worker and kept in a bounded cache. Texts
with white space outside ASCII or with the text of a special token go whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from trajspark.llm import words as W

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CACHED_CHUNKS = 1_500_000

# UTF-8 of white space outside ASCII, and the special token of the vocabulary.
_WHOLE = re.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|endoftext\|>"
)
_encoders: dict[tuple[str, str], "Encoder"] = {}


class Encoder:
    """A vocabulary and the chunks it has met, by hash; they are forgotten when there are too many.

    Whole texts go to the tokenizer of the JSON file. Chunks go to the same vocabulary as
    ranks, many in one call; the byte lengths of the ids tell where each chunk ends.
    """

    def __init__(self, path: str, ranks: str):
        self.path = path
        with open(ranks, "rb") as lines:
            pieces = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.chunks = tiktoken.Encoding(
            "chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pieces, special_tokens={}
        )
        self.bytes_of = np.zeros(max(pieces.values()) + 1, dtype=np.int64)
        for word, rank in pieces.items():
            self.bytes_of[rank] = len(word)
        self._forget()

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """Loaded when the first whole text needs it."""
        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.place = np.zeros(0, dtype=np.int64)
        self.start = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _encoded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, and how many each has."""
        sizes = np.zeros(len(start), dtype=np.int64)
        parts: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(start)
        # chunks from white space to another character can stand side by side
        joint = np.flatnonzero(W.SEPARATORS[data[start]] & ~W.SEPARATORS[data[end - 1]])
        if len(joint):
            text = data[W.rows_between(start[joint], end[joint])].tobytes().decode()
            ids = self.chunks.encode_to_numpy(text).astype(np.uint32)
            edges = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(end[joint] - start[joint])) + 1
            sizes[joint] = np.diff(edges, prepend=0)
        alone = np.setdiff1d(np.arange(len(start)), joint)
        for i in alone.tolist():
            text = data[start[i] : end[i]].tobytes().decode()
            parts[i] = np.array(self.chunks.encode_ordinary(text), dtype=np.uint32)
            sizes[i] = len(parts[i])
        out = np.zeros(int(sizes.sum()), dtype=np.uint32)
        ends = np.cumsum(sizes)
        if len(joint):
            out[W.rows_between(ends[joint] - sizes[joint], ends[joint])] = ids
        for i in alone.tolist():
            out[ends[i] - sizes[i] : ends[i]] = parts[i]
        return out, sizes

    def chunk_ranges(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of every chunk lie in ``self.ids``."""
        hashes = W.stretch_hashes(data, start, end)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHED_CHUNKS:
            self._forget()
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != distinct[inside]
        if new.any():
            ids, sizes = self._encoded(data, start[first[new]], end[first[new]])
            base = int(self.start[-1])
            while len(self.ids) < base + len(ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[base : base + len(ids)] = ids
            place = np.arange(len(self.start) - 1, len(self.start) - 1 + len(sizes))
            self.start = np.concatenate([self.start, base + np.cumsum(sizes)])
            self.hashes = np.insert(self.hashes, at[new], distinct[new])
            self.place = np.insert(self.place, at[new], place)
            at = np.searchsorted(self.hashes, distinct)
        place = self.place[at][inverse]
        return self.start[place], self.start[place + 1]


def encoder(path: str, ranks: str = RANKS) -> Encoder:
    """The worker's encoder for a vocabulary."""
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks)
    return _encoders[path, ranks]


def chunk_starts(block: W.Block) -> np.ndarray:
    """Starts of documents that have text, and of white space after another character."""
    space = W.SEPARATORS[block.data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    begins, ends = block.offsets[:-1], block.offsets[1:]
    cut[begins[begins < ends]] = True
    return np.flatnonzero(cut)


def token_blocks(
    texts: pa.Array, path: str = TOKENIZER, ranks: str = RANKS
) -> Iterator[tuple[W.Block, np.ndarray, np.ndarray]]:
    """Of every block: the ids of its documents, and their bounds."""
    coder = encoder(path, ranks)
    for block in W.blocks(texts):
        count = len(block.offsets) - 1
        start = chunk_starts(block)
        end = np.append(start[1:], len(block.data))[: len(start)]
        owner = np.searchsorted(block.offsets, start, side="right") - 1
        found = [m.start() for m in _WHOLE.finditer(block.data.tobytes())]
        whole = np.unique(np.searchsorted(block.offsets, np.array(found, dtype=np.int64), side="right") - 1)
        plain = ~np.isin(owner, whole)
        lo, hi = coder.chunk_ranges(block.data, start[plain], end[plain])
        ids = coder.ids[W.rows_between(lo, hi)]
        sizes = np.bincount(owner[plain], weights=hi - lo, minlength=count).astype(np.int64)
        if len(whole):
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            for d in whole.tolist():
                parts[d] = coder.whole(block.data[block.offsets[d] : block.offsets[d + 1]].tobytes().decode())
            ids = np.concatenate(parts)
            sizes = np.array([len(p) for p in parts], dtype=np.int64)
        yield block, ids, np.concatenate([[0], np.cumsum(sizes)])
