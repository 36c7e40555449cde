"""Spelling variants, SimHash groups and hard negatives against plain versions."""

import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trajspark.llm import hard_negatives, oracles, queries, simhash, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF_DIR = "/root/testdata/sf0.001"
CLASHES = "word n form root near _key m p s l fp cell cut fps a b component row v label2 score scores place cb ab".split()


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def documents(spark, texts):
    extra = ", ".join(f"{c} string" for c in CLASHES)
    rows = [(i, t, *["x"] * len(CLASHES)) for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, {extra}").repartition(3)


# spelling


def plain_variants(texts):
    counts = {}
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    # one edit: equal after a wildcard for a letter, or after a deletion
    shape = {}
    for w in counts:
        for k in range(len(w)):
            shape.setdefault((w[:k], w[k + 1 :]), set()).add(w)
    near = {w: set() for w in counts}
    for (head, tail), words in shape.items():
        for w in words:
            near[w] |= words - {w}
        if head + tail in counts:
            near[head + tail] |= words
            for w in words:
                near[w].add(head + tail)
    forms = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= 5 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, n, len(near[w]), counts[forms[w]] if forms[w] else None))
    return out


def spelling_texts():
    rng = np.random.default_rng(7)
    stems = ["".join(rng.choice(list("abcé"), int(rng.integers(5, 9)))) for _ in range(60)]
    texts = []
    for i in range(1, 120):
        words = []
        for _ in range(int(rng.integers(0, 120))):
            w = stems[min(int(rng.exponential(9)), 59)]
            if rng.random() < 0.3:
                k = int(rng.integers(0, len(w)))
                w = [w[:k] + w[k + 1 :], w[:k] + "b" + w[k + 1 :], w[:k] + "B" + w[k:]][int(rng.integers(0, 3))]
            words.append(w)
        texts.append((i, " ".join(words)))
    chain = ["aaaaaab"] * 5 + ["aaaaabb"] * 25 + ["aaaabbb"] * 125 + ["aaabbbb"] * 625
    long = ["x" * 3000] * 5 + ["x" * 3001] * 5 + ["x" * 1500 + "y" + "x" * 1499] * 30
    return texts + [(200, " ".join(chain)), (201, " 1".join(long)), (None, "Straße " * 6), (202, None), (203, ""), texts[3], texts[3]]


@pytest.mark.parametrize("largest", [4096, 3])
def test_spelling_equals_all_pairs(spark, largest):
    texts = spelling_texts()
    got = spelling.spelling_variants(documents(spark, texts), largest=largest).collect()
    want = plain_variants(texts)
    assert len(got) == len(want) > 100
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert any(r.root not in (r.word, r.form) for r in got)


def test_spelling_of_an_empty_table(spark):
    assert spelling.spelling_variants(documents(spark, [(1, "few words")]).limit(0)).count() == 0
    assert spelling.spelling_variants(documents(spark, [(1, None), (2, "word " * 9)])).count() == 0


# SimHash


def plain_fingerprint(text):
    words = [w.encode() for w in WORD.findall(lowered(text or ""))]
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius):
    """Smallest name reached by links, for a list of (name, fingerprint)."""
    values = np.array([p for _, p in prints], dtype=np.uint64)
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values) <= radius):
            a, b = sorted((group[i], group[int(j)]))
            if a != b:
                group = [a if g == b else g for g in group]
    least = {}
    for g, (name, _) in zip(group, prints):
        if name is not None:
            least[g] = min(name, least.get(g, name))
    return [least.get(g) for g in group]


def simhash_texts():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}É" for i in range(400)]
    texts = []
    for i in range(40):
        base = rng.choice(vocabulary, int(rng.integers(1, 400)))
        texts.append((10 * i + 5, " ".join(base)))
        for k in range(1, 5):
            changed = base.copy()
            changed[rng.integers(0, len(base), k)] = "other"
            texts.append((10 * i + 5 - k, "\n\t ".join(changed)))
    long = " ".join(rng.choice(vocabulary, 300_000))
    more = [(1000, None), (1001, ""), (None, " \n"), (None, "Only TWO"), (1002, "only two"), (1003, long), (999, long.upper()), (1003, long)]
    return texts + more


def test_simhash_equals_all_pairs(spark):
    texts = simhash_texts()
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.simhash_groups(documents(spark, texts)).collect())
    prints = [(i, plain_fingerprint(t)) for i, t in texts]
    want = sorted((i or -1, f"{p:016x}", c) for (i, p), c in zip(prints, plain_groups(prints, 3)))
    assert got == want
    assert len({c for _, _, c in want}) < len({p for _, p, _ in want})  # links join different fingerprints


@pytest.mark.parametrize("parts", [2, 4, 8])
def test_links_connect_all_that_are_near(spark, parts):
    rng = np.random.default_rng(parts)
    start = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    values = set(start.tolist()) | {0, (1 << 64) - 1, 1, 7, 15}
    for v in start.tolist():
        for _ in range(12):
            v ^= 1 << int(rng.integers(0, 64))
            v ^= 1 << int(rng.integers(0, 64))
            values.add(v)
    signed = sorted(int(np.uint64(v).view(np.int64)) for v in values)
    frame = spark.createDataFrame([(v,) for v in signed], "fp bigint").repartition(3)
    for tile in (5, 1024):
        found = [(r.a, r.b) for r in simhash.links(frame, parts, 3, tile).collect()]
        named = [(v, int(np.int64(v).view(np.uint64))) for v in signed]
        want = plain_groups(named, 3)
        group = {v: v for v in signed}
        for a, b in found:
            assert bin((a ^ b) & (2**64 - 1)).count("1") >= 1
            low, high = sorted((group[a], group[b]))
            if low != high:
                group = {k: low if g == high else g for k, g in group.items()}
        assert [group[v] for v in signed] == want


def test_a_fingerprint_in_most_rows(spark):
    texts = [(i, "the same few words here") for i in range(5, 3000)] + [(i, f"text number {i} {i * 7} and {i * 13} too") for i in range(3000, 3400)]
    got = simhash.simhash_groups(documents(spark, texts)).collect()
    assert len(got) == len(texts)
    assert {r.component_id for r in got if r.doc_id < 3000} == {5}


def test_simhash_of_an_empty_table(spark):
    assert simhash.simhash_groups(documents(spark, [(1, "x")]).limit(0)).count() == 0


# hard negatives


def plain_negatives(rows):
    """Rows are (vec_id, vector, label)."""
    kept = []
    for name, vector, label in rows:
        if name is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        kept.append((name, [int(np.floor(256 * float(x))) for x in vector], (label + 1) % 10 if name % 7 == 0 else label))
    out = []
    for name, v, label in kept:
        if name % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), other, own) for other, w, own in kept)
        for minus, positive, _ in [s for s in scored if s[2] == label and s[1] != name][:5]:
            p = -minus
            inside = [(o, -m) for m, o, own in scored if own != label and 50 * p <= -100 * m <= 95 * p]
            out += [(name, positive, k + 1, o, p, s) for k, (o, s) in enumerate(inside[:3])]
    return sorted(out)


def vector_rows():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(4, 6))
    rows = []
    for i in range(700):
        v = centres[i % 4] + rng.normal(size=6) * 0.5
        rows.append((i, [float(x) for x in v], int(rng.integers(0, 4))))
    rows += [(5 * i + 700, [0.0] * 6, i % 3) for i in range(60)]
    rows += [(i + 1400, rows[i][1], 3) for i in range(100)]
    rows += [(2000, None, 1), (2050, [None] * 6, 1), (2100, [float("nan")] * 6, 1), (2150, [float("inf")] * 6, 1)]
    rows += [(None, [1.0] * 6, 1), (2200, [1.0] * 6, None), (2250, [1.0, 2.0], 2), (2300, [], 2), (2350, [-9e8] * 3, 2)]
    return rows


def as_vectors(spark, rows):
    extra = ", ".join(f"{c} string" for c in CLASHES)
    found = [(i, v, y, *["x"] * len(CLASHES)) for i, v, y in rows]
    return spark.createDataFrame(found, f"vec_id bigint, embedding array<double>, label int, {extra}").repartition(3)




def mined(vectors, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0, label, **options).collect()
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found)


@pytest.mark.parametrize("options", [{}, {"candidate_rows": 64, "anchor_rows": 3}])
def test_hard_negatives_equal_all_pairs(spark, options):
    rows = vector_rows()
    usual = [r for r in rows if r[0] != 2350]
    got = mined(as_vectors(spark, usual), **options)
    assert got == plain_negatives(usual) and len(got) > 100
    # huge components count as the largest; nothing fails
    assert len(mined(as_vectors(spark, rows), **options)) > 100


def test_repeated_vectors_and_empty_tables(spark):
    rows = [r for r in vector_rows() if r[0] not in (2350, None)]
    vectors = as_vectors(spark, rows + rows[:50])
    got = mined(vectors)
    assert got == plain_negatives(rows + rows[:50])
    assert mined(vectors.limit(0)) == []
    assert mined(vectors.filter("vec_id = 50")) == []


def test_reading_stops_before_the_end():
    rng = np.random.default_rng(2)
    v = np.rint(rng.normal(size=(4000, 3)) * 256)
    v[:20] += 3000
    met, reads = 0, 0
    for rows, score, threshold in hard_negatives.Lists(v).read(np.array([3.0, 2.0, 1.0])):
        met, reads = met + len(rows), reads + 1
        unseen = np.setdiff1d(np.arange(4000), rows)
        if threshold < np.sort(score)[-5]:
            break
    assert met < 400 and reads == 1
    assert (v[unseen] @ [3, 2, 1]).max() <= threshold


def test_hard_negatives_equal_sql(spark):
    got = queries.op13_hard_negatives(spark, SF_DIR)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_DIR}/embeddings.parquet'")
    want = con.execute(oracles.SQL["op13_hard_negatives"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 0
