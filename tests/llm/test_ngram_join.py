"""The n-gram join where most shingles are frequent, and where one group holds many rows."""

import numpy as np
import pytest

from trajspark.llm import ngram_join
from trajspark.llm.ngram_join import above_noise, frequent_cells, index_keys, is_frequent, shingle_sets


def linked(texts):
    """Number of shingles and smallest id of the component of every text, by comparing all pairs."""
    sets = {}
    for i, text in texts.items():
        words = text.split()
        short = [tuple(words)] if words else []
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else set(short)
    label = {i: i for i in sets}
    order = sorted(sets)
    for a in order:
        for b in order:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if c == high else c for i, c in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


def crowded(seed=5):
    """Texts put together from few passages, with words changed: most shingles are in many of them."""
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(400)])
    passages = [list(rng.choice(vocabulary, 60)) for _ in range(6)]
    texts = {}
    for i in range(1, 181):
        words = []
        for k in rng.choice(6, int(rng.integers(1, 4)), replace=False):
            words += passages[k]
        changed = int(rng.integers(0, 6))
        for at in rng.integers(0, len(words), changed):
            words[at] = f"x{i}"
        texts[i] = " ".join(words)
    for i in range(181, 200):
        texts[i] = texts[i - 150]
    return texts


@pytest.mark.parametrize("frequent", [2, 1 << 40])
def test_frequent_shingles_in_pairs(spark, frequent):
    texts = crowded()
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5).cache()
    cells = np.unpackbits(frequent_cells(docs, 5, frequent))
    in_pairs = 0
    for text in texts.values():
        for _, values, _ in shingle_sets(ngram_join.pa.array([text]), 5):
            common = is_frequent(values, cells)
            in_pairs += int(np.sum(~common)) <= len(values) * 20 // 100
    # all but a few documents have keys of pairs, or none has
    assert in_pairs > 150 if frequent == 2 else in_pairs == 0
    found, links = ngram_join.ngram_jaccard_join(docs, frequent=frequent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == linked(texts)
    assert all(r.a in texts and r.b in texts for r in links.collect())


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        base = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        other = base[rng.random(len(base)) > 0.1]
        other = np.unique(np.concatenate([other, rng.integers(0, 1 << 62, int(rng.integers(0, n // 10 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(base, other))
        if not len(other) or 100 * both < 80 * (len(base) + len(other) - both):
            continue
        share = rng.random()
        keys = []
        for values in (base, other):
            common = (values % np.uint64(1000)).astype(np.int64) < 1000 * share
            keys.append(index_keys(values, common, 80))
        assert len(np.intersect1d(*keys))


@pytest.mark.parametrize("mean", [0.2, 30, 100_000])
def test_frequent_counters_whatever_the_mean(mean):
    """The limit stays near the sum of the rare shingles: what stands out by ten spreads is found at every mean."""
    counters = np.random.default_rng(2).poisson(mean, 1 << 16)
    assert above_noise(counters, 64).sum() == 0
    counters[:500] += int(10 * np.sqrt(mean)) + 74
    assert above_noise(counters, 64).sum() == 500


def test_hot_groups_are_split(spark, monkeypatch):
    """Copies of one text and near copies of another, each a third of all rows, above the size that is split."""
    monkeypatch.setattr(ngram_join, "PAIR_BLOCK", 8)
    rng = np.random.default_rng(4)
    vocabulary = np.array([f"w{i}" for i in range(400)])
    copy, near = list(rng.choice(vocabulary, 50)), list(rng.choice(vocabulary, 200))
    texts = {i: " ".join(copy) for i in range(1, 61)}
    for i in range(61, 121):
        words = list(near)
        words[int(rng.integers(0, 200))] = f"x{i}"
        texts[i] = " ".join(words)
    for i in range(121, 181):
        texts[i] = " ".join(rng.choice(vocabulary, 40)) if i % 3 else ""
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(7)
    found, _ = ngram_join.ngram_jaccard_join(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == linked(texts)


def test_one_document_with_several_texts(spark):
    """Its texts are one node: what links to any of them is one component."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, ""), (9, c), (11, c), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found, _ = ngram_join.ngram_jaccard_join(docs)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in found.collect())
    assert got == [(0, 26, 0), (3, 26, 3), (5, 26, 3), (5, 26, 3), (7, 26, 3), (9, 0, 9), (9, 26, 9), (9, 26, 9), (11, 26, 9)]
