"""Every stage of the pipeline against a plain version, on its own input."""

import re

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trajspark.llm import oracles, secrets, toxicity
from trajspark.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, secrets, toxic words, nulls and repeats, and labels of most."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(300):
        words = list(rng.choice(vocabulary, int(rng.integers(20, 120))))
        if i % 4 == 0:
            words[5] = "vilething"
        if i % 10 == 3:
            words[7] = "token=abcdEFGH12345678"
        rows.append([i, " ".join(words), ["en", "de", None][i % 3], f"src{i % 5}", None])
    for i in range(300, 330):
        rows.append([i, rows[i - 299][1] + (" more" if i % 2 else ""), "en", "src1", None])
    rows += [[330, None, None, None, None], [331, "", "fr", "src0", 0], [None, "no id", "en", "src2", 5], rows[9], rows[9]]
    rows = [[i, t, la, s, None if t is None else len(t)] for i, t, la, s, _ in rows]
    path = tmp_path_factory.mktemp("pipeline")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int("vilething" in (t or ""))) for i, t, *_ in rows if i is not None and i % 7]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def staged(spark, folder):
    """Input and output of every stage."""
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, folder), name)
        found[name] = (before, docs)
    return found


def sets(rows):
    out = {}
    for r in rows:
        words = WORD.findall((r.text or "").lower())
        out.setdefault(r.doc_id, set()).add(frozenset(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(1, len(words))))))
    return out


def counted(rows):
    return sorted(map(str, rows))


def test_toxicity(spark, folder, staged):
    before, after = staged["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{folder}/labels.parquet"))
    number = {int(c): k for k, c in enumerate(model.cells)}
    want = []
    for row in before.collect():
        terms = set()
        for block in W.blocks(one_text(row.text)):
            terms = {number[int(c)] for c in toxicity._cells(block)[1] if int(c) in number}
        terms = sorted(terms)
        out = model.bias + sum(model.weight[k] for k in terms)
        out += sum(model.factor[a] @ model.factor[b] for i, a in enumerate(terms) for b in terms[i + 1 :])
        if out < 0:
            want.append(row)
    assert after.columns == COLUMNS
    assert counted(after.collect()) == counted(want)
    assert all("vilething" not in (r.text or "") for r in want) and len(want) < before.count()


def one_text(text):
    return pa.array([text], pa.string())


def test_near_duplicates(staged):
    before, after = staged["ngram_join"]
    rows = before.collect()
    found = [(i, s) for i, of in sets(rows).items() if i is not None for s in of if s]
    parent = {r.doc_id: r.doc_id for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in found:
        for b, y in found:
            if a < b and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    want = sorted(i for i in parent if i is not None and root(i) == i)
    kept = after.collect()
    assert after.columns == COLUMNS
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in kept) == 1
    assert set(map(str, kept)) <= set(map(str, rows)) and len(want) < len({r.doc_id for r in rows})


def test_secrets(staged):
    before, after = staged["secrets"]
    known = secrets.vocabulary(secrets.corpus_words(before))

    def plain(text):
        if not text:
            return text
        covered = set()
        base = secrets.base_spans(text)
        judged = secrets.judged_values(text, known)
        for start, _, end in base + secrets.guessed_spans(judged, secrets.MIN_GUESSES):
            covered.update(range(start, end))
        return "".join(
            (secrets.MASK if k - 1 not in covered else "") if k in covered else c for k, c in enumerate(text)
        )

    want = []
    for r in before.collect():
        text = plain(r.text)
        size = len(text) if text is not None and secrets.MASK in text else r.n_chars
        want.append((r.doc_id, text, r.lang, r.source, size))
    assert after.columns == COLUMNS
    assert counted(map(tuple, after.collect())) == counted(want)
    assert any(secrets.MASK in (w[1] or "") for w in want)


def test_mixing(staged):
    before, after = staged["mixing"]
    docs = before.toPandas()
    docs["doc_id"] = docs["doc_id"].astype("Int64")
    query = oracles.mixing_sql("docs", corpus_pipeline.MIX_PERCENT, 2, 11)
    want = duckdb.sql(f"WITH {query} SELECT doc_id, lang, source FROM mixed").fetchall()
    assert after.columns == COLUMNS
    assert counted(tuple(r) for r in after.select("doc_id", "lang", "source").collect()) == counted(want)


def test_packing(spark, folder, staged):
    before, after = staged["packing"]
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect())
    pieces = after.collect()
    assert sum(p.length for p in pieces) == want
    assert {p.doc_id for p in pieces} == {r.doc_id for r in before.collect()}
    assert corpus_pipeline.run(spark, folder).count() == len(pieces)


def test_empty_and_clashing(spark, folder, staged):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for column in ("score", "epoch", "n_tokens", "_id", "rest"):
        docs = docs.selectExpr("*", f"doc_id as {column}")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
            assert out.filter("not (score <=> doc_id and epoch <=> doc_id and rest <=> doc_id and _id <=> doc_id)").isEmpty()
