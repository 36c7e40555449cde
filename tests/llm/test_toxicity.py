"""The factorization machine where only pairs tell, and on held-out labels against the majority and a plain pair table."""

import zlib

import numpy as np
import pytest

from trajspark.llm import toxicity


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize("alone", [False, True])
def test_pairs(spark, alone):
    """Toxic is one of two words without the other (neither tells alone), or both together."""
    rng = np.random.default_rng(4)
    words, labels = [], []
    for i in range(2500):
        a, b = (int(x) for x in rng.random(2) < (0.4 if alone else 0.5))
        other = rng.choice([f"word{k}x" for k in range(300)], 25)
        words.append((i, " ".join([*["insult"] * a, *other, *["group"] * b])))
        labels.append((i, int(a and b) if alone else int(a != b)))
    docs = spark.createDataFrame(words, "doc_id bigint, text string").repartition(3)
    found = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    label = dict(labels)
    right = [r.predicted == label[r.doc_id] for r in found if r.held_out]
    assert len(right) == sum(map(held_out, label)) and np.mean(right) > 0.97


def terms(label, texts):
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return row, np.array([c for t in texts for c in t], dtype=np.int64), np.array(label, dtype=float)


def test_pair_cells():
    rng = np.random.default_rng(8)
    texts = [np.flatnonzero(rng.random(60) < 0.2) * 31 for _ in range(3000)]
    both = [int((0 in t) != (31 in t)) for t in texts]
    assert toxicity.paired_cells(*terms(both, texts)).tolist() == [0, 31]
    # labels without cause, one word that decides alone, one class, nothing
    assert not len(toxicity.paired_cells(*terms(rng.integers(0, 2, 3000), texts)))
    assert not len(toxicity.paired_cells(*terms([int(0 in t) for t in texts], texts)))
    assert not len(toxicity.paired_cells(*terms(np.ones(3000), texts)))
    assert not len(toxicity.paired_cells(*terms([], [])))
    # copies of one document make no pairs
    copied = texts + [np.arange(40) * 31] * 2000
    assert not len(toxicity.paired_cells(*terms([*rng.integers(0, 2, 3000), *[1] * 2000], copied)))


def test_pairs_in_several_blocks(monkeypatch):
    rng = np.random.default_rng(9)
    texts = [np.flatnonzero(rng.random(50) < 0.3) for _ in range(2000)]
    found = terms([int((3 in t) != (41 in t)) for t in texts], texts)
    assert toxicity.paired_cells(*found).tolist() == [3, 41]
    monkeypatch.setattr(toxicity, "PAIR_BLOCK", 7)
    assert toxicity.paired_cells(*found).tolist() == [3, 41]


def test_held_out_labels(spark):
    root = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{root}/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in labels.filter("toxic is not null").collect()}
    found = toxicity.toxicity(spark.read.parquet(f"{root}/documents.parquet"), labels).filter("held_out").collect()
    judged = [(r.predicted, toxic[r.doc_id]) for r in found if r.doc_id in toxic]
    caught = sum(p and t for p, t in judged)
    assert caught >= 0.8 * sum(t for _, t in judged)
    assert caught >= 0.95 * sum(p for p, _ in judged)
