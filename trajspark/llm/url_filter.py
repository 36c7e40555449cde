"""URL filters by a sorted digest array.

The entries of a list, each a host and the start of a path, are hashed with 64-bit xxhash
and sorted. The array, with the entries' full strings behind it, is cut by ranges of keys
into files of bounded size that Spark hands to every executor, where they are mapped into
memory; a list may have any number of files. For every URL the keys of its host, of all parent domains and of the path starts that entries have are
looked up by one vectorised binary search per batch. A hit counts only if the stored
string is the same. Among the hits the longest entry wins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm.tables import map_arrow
from trajspark.session import shared_path

#: Entries of one file; more than these only where their keys are equal.
SHARD_ENTRIES = 1_000_000

# The rules, with their verdicts.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Entries that decide where no rule fits: advertising and spam, as the names of the sites tell.
SPAM_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED = tuple((f"{name}.example.{top}/", "block") for name in SPAM_NAMES for top in ("com", "net", "org"))

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    stop = min((i for i in (rest.find(c, end) for c in "?#") if i >= 0), default=len(rest))
    return rest[:end].translate(_LOWER), rest[end:stop]


def digest(entry: str) -> int:
    return xxhash.xxh64_intdigest(entry.encode())


def build(entries: Sequence[str], codes: Sequence[int], shard: int = SHARD_ENTRIES) -> Iterator[tuple[int, bytes]]:
    """The sorted digest array of ``entries`` in files, each with its first key.

    A file has the number of its entries, their keys, ``codes`` (above 0), ends and strings.
    """
    keys = np.fromiter(map(digest, entries), dtype=np.uint64, count=len(entries))
    order = np.argsort(keys, kind="stable")
    keys, codes = keys[order], np.asarray(codes, dtype=np.uint64)[order]
    lo = 0
    while lo < len(keys):
        # entries with one key stay in one file
        hi = int(np.searchsorted(keys, keys[min(lo + shard, len(keys)) - 1], side="right"))
        stored = [entries[i].encode() for i in order[lo:hi].tolist()]
        ends = np.cumsum([len(s) for s in stored], dtype=np.uint64)
        head = (np.array([hi - lo], np.uint64), keys[lo:hi], codes[lo:hi], ends)
        yield int(keys[lo]), b"".join([*[part.tobytes() for part in head], *stored])
        lo = hi


def share(spark: SparkSession, data: bytes) -> str:
    """Put ``data`` in a file of the shared folder that every executor fetches; its name."""
    path = shared_path(spark, "digests")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


class DigestArray:
    """The mapped files, in the order of their first keys."""

    def __init__(self, paths: Sequence[str], firsts: Sequence[int]):
        self.firsts = np.array(firsts, dtype=np.uint64)
        self.shards = [self._mapped(p) for p in paths]

    @staticmethod
    def _mapped(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = np.memmap(path, dtype=np.uint8, mode="r")
        count = int(data[:8].view(np.uint64)[0])
        keys, codes, ends = data[8 : 8 + 24 * count].view(np.uint64).reshape(3, count)
        return keys, codes, ends, data[8 + 24 * count :]

    def find(self, probes: Sequence[str]) -> np.ndarray:
        """Code of the entry that equals each probe, or 0."""
        out = np.zeros(len(probes), dtype=np.int64)
        wanted = np.fromiter(map(digest, probes), dtype=np.uint64, count=len(probes))
        shard = np.searchsorted(self.firsts, wanted, side="right") - 1
        for s, (keys, codes, ends, strings) in enumerate(self.shards):
            here = np.flatnonzero(shard == s)
            lo = np.searchsorted(keys, wanted[here], side="left")
            hi = np.searchsorted(keys, wanted[here], side="right")
            for i in np.flatnonzero(hi > lo).tolist():
                probe = probes[here[i]].encode()
                for k in range(lo[i], hi[i]):  # more than one only where two entries share a key
                    begin = int(ends[k - 1]) if k else 0
                    if strings[begin : int(ends[k])].tobytes() == probe:
                        out[here[i]] = int(codes[k])
        return out


def probes(host: str, path: str, longest_host: int, path_lengths: Sequence[int]) -> list[str]:
    """The entries that would fit: the host and its parent domains, with every path start of a known length."""
    names = [host] if len(host) <= longest_host else []
    dot = host.find(".", max(0, len(host) - longest_host - 1))
    while dot >= 0:
        names.append(host[dot + 1 :])
        dot = host.find(".", dot + 1)
    starts = [path[:n] for n in path_lengths if n <= len(path)]
    return [name + start for name in names for start in starts]


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    listed: Sequence[tuple[str, str]] = LISTED,
    default: str = "allow",
    shard: int = SHARD_ENTRIES,
) -> DataFrame:
    """Judge every URL: ``page_id``, ``host``, ``path``, ``rule`` and ``verdict``.

    The longest rule that fits gives ``rule`` and ``verdict``. Else ``rule`` is null, and the
    longest entry of ``listed`` that fits gives the verdict, or ``default``. Of two equally
    long ones the one with the longer host wins. Entries are ``host/path``, in any number.

    One row for each row of ``pages``, repeated ones included. A null URL, or one without
    ``://``, has an empty host and path, which no entry fits; a very long one is judged whole.
    Other columns are ignored. An empty table gives no rows.
    """
    if len({e for e, _ in rules}) < len(rules) or len({e for e, _ in listed}) < len(listed):
        raise ValueError("an entry is listed twice")
    # an entry's code tells its verdict as a rule and as a listed entry; 0 is none
    verdicts = [None, *sorted({v for _, v in (*rules, *listed)})]
    number = {v: i for i, v in enumerate(verdicts)}
    code = {e: number[v] for e, v in rules}
    for e, v in listed:
        code[e] = code.get(e, 0) + number[v] * len(verdicts)
    longest_host = max((len(e.partition("/")[0]) for e in code), default=0)
    path_lengths = sorted({len(e) - len(e.partition("/")[0]) for e in code})
    files = [(share(pages.sparkSession, data), first) for first, data in build(list(code), list(code.values()), shard)]

    def judge(batch):
        array = DigestArray([SparkFiles.get(name) for name, _ in files], [first for _, first in files])
        split = [parts(u) for u in batch.column(1).to_pylist()]
        asked = [probes(h, p, longest_host, path_lengths) for h, p in split]
        hits = array.find([x for some in asked for x in some])
        found, given, at = [], [], 0
        for some in asked:
            fits = [(e, int(c)) for e, c in zip(some, hits[at : at + len(some)]) if c]
            at += len(some)
            fits.sort(key=lambda f: (len(f[0]), f[0].find("/")), reverse=True)
            rule = next(((e, verdicts[c % len(verdicts)]) for e, c in fits if c % len(verdicts)), (None, None))
            entry = next((verdicts[c // len(verdicts)] for _, c in fits if c // len(verdicts)), default)
            found.append(rule[0])
            given.append(rule[1] or entry)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([h for h, _ in split]), pa.array([p for _, p in split]), pa.array(found, pa.string()), pa.array(given)],
            ["page_id", "host", "path", "rule", "verdict"],
        )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    return map_arrow(rows, judge, "page_id bigint, host string, path string, rule string, verdict string")
