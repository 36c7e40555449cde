"""Nulls in any column, repeated rows, ties, very long texts and columns that share names with the operators' own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.llm import mixing, neighbours, ngram_join, packing, quality, secrets, substring_dedup
from trajspark.llm import token_counts, toxicity, url_filter

CLASHES = (
    "key rep n set label block score held_out predicted epoch n_tokens full rest before _id _first end_range hash "
    "words base spans part ids t r e s start windows version seed digest component_id node kept row a.b"
).split()
PASSAGE = " ".join(f"w{i % 37}x{i}" for i in range(80))
ROWS = [
    (1, PASSAGE),
    (1, PASSAGE),
    (2, PASSAGE + " tail"),
    (3, None),
    (None, PASSAGE),
    (None, None),
    (4, ""),
    (5, "word"),
    (5, "another text of this id"),
    (6, " ".join(f"long{i % 9973} é" for i in range(200_000))),
    (7, 'pwd = "é" and password: hunter2-Zx9$Lq2!vT end'),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None, None, *[None if k % 2 else "x" for k in range(len(CLASHES))]) for i, t in ROWS]
    clashing = ", ".join(f"`{c}` string" for c in CLASHES)
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {clashing}"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


def ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda i: (i is None, i))


ALL = sorted((i for i, _ in ROWS), key=lambda i: (i is None, i))


def test_join_and_representatives(docs):
    found, _ = ngram_join.ngram_jaccard_join(docs)
    rows = found.collect()
    assert ids(rows) == ALL
    assert {(r.doc_id, r.component_id) for r in rows} == {(i, {2: 1}.get(i, i)) for i, _ in ROWS}
    kept = ngram_join.one_of_each(docs, found)
    assert kept.columns == docs.columns
    assert ids(kept.collect()) == [1, 3, 4, 5, 6, 7, None, None]
    assert {r.key for r in kept.collect()} == {"x"} and {r._id for r in kept.collect()} == {docs.first()._id}


def test_rows_stay(docs):
    for out in (
        quality.quality(docs),
        substring_dedup.substring_dedup(docs),
        token_counts.edited_counts(docs, token_counts.mask_personal_data),
        secrets.scan(docs),
    ):
        assert ids(out.collect()) == ALL


def test_substring_dedup(docs):
    gone = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect() if r.n_removed)
    assert gone == [(2, 81, 80)]


def test_secrets(docs):
    masked = secrets.redact(docs)
    assert masked.columns == docs.columns
    rows = masked.collect()
    assert ids(rows) == ALL
    assert all("hunter2" not in (r.text or "") for r in rows)
    # a run of one character costs the same however long, and takes linear time
    assert secrets.guess_cost("é" * 20_000) < secrets.MIN_GUESSES
    text = "pwd = zQ9%mK7&wX2! " * 2000
    assert len(secrets.guessed_spans(secrets.judged_values(text), secrets.MIN_GUESSES)) == 2000


def test_packing(docs):
    pieces = packing.pack(docs).collect()
    assert sum(p.length for p in pieces if p.start == 0 and p.doc_tokens == 1) == 3
    assert {p.doc_id for p in pieces} == set(ALL)
    first = sorted(p.doc_tokens for p in pieces if p.start == 0)
    assert len(first) == len(ROWS) and sum(first) == sum(p.length for p in pieces)


def test_mixing(docs):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    mixed = mixing.mix(docs, levels, {"lang": {"en": 2}}, 200)
    assert mixed.columns == [c for c in docs.columns if c not in ("n_tokens", "epoch")] + ["n_tokens", "epoch"]
    words = [len((t or "").split()) for _, t in ROWS]
    assert sum(r.n_tokens for r in mixed.collect()) == 2 * sum(words)
    assert {r["key"] for r in mixed.collect()} == {"x"}


def test_toxicity_and_labels(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 0), (99, 1)], "doc_id bigint, toxic int")
    for known in (labels, labels.limit(0)):
        rows = toxicity.toxicity(docs, known).collect()
        assert ids(rows) == ALL and all(0 <= r.score <= 1 for r in rows)
        assert not any(r.held_out for r in rows if r.doc_id is None)


def test_urls(spark):
    rows = [(1, None), (None, "http://a.net/fr/"), (1, "http://a.net/fr/"), (2, "://"), (3, "http://" + "a." * 50_000 + "net/es/x")]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id bigint, url string, verdict string, rule string")
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == len(rows)
    assert [r.rule for r in got if r.page_id == 3] == ["net/es/"]
    assert [(r.host, r.path, r.verdict) for r in got if r.page_id == 2] == [("", "", "allow")]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    same = [float(v) for v in rng.normal(size=8)]
    rows = [(i, same, "x", 1) for i in range(60)]
    rows += [(None, same, None, None), (3, same, "x", 2), (90, None, None, 1), (91, [1.0, None] * 4, "x", 1), (92, [1.0], "x", 1)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, file string, rank int")
    got = neighbours.search(vectors, F.col("vec_id") % 20 == 0).collect()
    for q in (0, 20, 40):
        own = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        assert [v for _, v in own] == [v for v in range(60) if v != q][:20]
    assert {r.query_id for r in got} == {0, 20, 40}
