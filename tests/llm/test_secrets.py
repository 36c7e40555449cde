"""Guess cost against every segmentation, words of the documents against plain counting, spans in and out of patterns."""

import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from trajspark.llm import secrets

KNOWN = secrets.vocabulary(["garden", "violet", "ab", "né"])
SWAPS = dict(zip("0134578@$!", "oieastbasi"))


def of_one_piece(piece, low):
    """The cheapest way to guess a piece at once; ``low`` is the piece in lower case."""
    costs = [sum(0.6 if c.isalpha() else 1.0 for c in low)]
    plain = "".join(SWAPS.get(c, c) for c in low)
    if plain in KNOWN.ranks:
        costs.append(math.log10(KNOWN.ranks[plain] + 1) + 0.3 * (piece != low) + 0.3 * (plain != low))
    year, month, day, gap = "(19|20)[0-9]{2}", "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])", "[-/._]?"
    for form, ways in (
        (year, 140),
        (year + gap + month, 140 * 12),
        (year + gap + month + gap + day, 140 * 366),
        (day + gap + month + gap + year, 140 * 366),
    ):
        if re.fullmatch(form, piece):
            costs.append(math.log10(ways))
    rows = [*secrets.WALKS, *(row[::-1] for row in secrets.WALKS)]
    if len(low) >= 3 and all(any(a + b in row for row in rows) for a, b in zip(low, low[1:])):
        costs.append(math.log10(47 * len(low)))
    for period in range(1, 9):
        times, rest = divmod(len(low), period)
        if times > 1 and not rest and low == low[:period] * times:
            costs.append(period + math.log10(times))
    return min(costs)


def plain_cost(value):
    low, n = value.lower(), len(value)
    best = math.inf
    for cuts in (c for k in range(n) for c in combinations(range(1, n), k)):
        edges = [0, *cuts, n]
        pieces = [of_one_piece(value[a:b], low[a:b]) for a, b in zip(edges, edges[1:])]
        best = min(best, sum(pieces) + 0.3 * (len(pieces) - 1))
    return best


def test_cost_is_the_least_of_all_segmentations():
    rng = np.random.default_rng(5)
    parts = ["garden", "G4rden", "2019", "201912", "07-2001", "1.2.19", "qwe", "zaq", "aa", "abab", "x", "7", "#", "né", "P@ss"]
    values = {"".join(rng.choice(parts, int(rng.integers(1, 5))))[:11] for _ in range(60)}
    for value in sorted(values | {"a", "password", "20191231", "31122019", "aaaaaaaaaa", "x9$Lq2!vTz"}):
        assert secrets.guess_cost(value, KNOWN) == pytest.approx(plain_cost(value)), value


def test_words_of_the_documents(spark):
    texts = ["The garden, the GARDEN; gardens. a1b two", "the\n\tgarden! été", "password: garden token = the x > the", "", None]
    docs = spark.createDataFrame([(t,) for t in texts * 3], "text string").repartition(3)
    want = Counter()
    for text in texts * 3:
        before = ""
        for word in (text or "").split():
            plain = re.sub("[.,;:!?]$", "", word)
            if before[-1:] not in (":", "=", ">") and plain.replace("é", "e").isalpha() and len(plain.encode()) >= 3:
                want[plain.lower()] += 1
            before = word
    ranked = sorted(want, key=lambda w: (-want[w], w.encode()))
    assert secrets.corpus_words(docs, seen=1) == ranked
    assert secrets.corpus_words(docs, most=2, seen=1) == ranked[:2] == ["garden", "the"]
    assert secrets.corpus_words(docs, seen=9) == [w for w in ranked if want[w] >= 9]
    assert secrets.corpus_words(docs.limit(0)) == []


def test_every_value_is_judged(spark):
    texts = {
        1: "password = zQ9mK7wX2vTz4 end",  # also a match of a pattern
        2: "my pwd is internationalization now",
        3: "pwd: xk!2Qz9#vv7&",
        4: "token: changeme123",
    }
    texts |= {i: "internationalization of things" for i in range(10, 40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r.doc_id: r for r in secrets.scan(docs).collect()}
    spans = {i: [(s.kind, texts[i][s.start : s.end]) for s in r.spans] for i, r in found.items()}
    assert spans[1] == [("assign", "password = zQ9mK7wX2vTz4"), ("guess", "zQ9mK7wX2vTz4")]
    assert spans[2] == [] and len(found[2].judged) == 1 and found[2].judged[0].cost < 3
    assert spans[3] == [("guess", "xk!2Qz9#vv7&")]
    assert len(found[4].judged) == 1 and found[4].judged[0].cost < secrets.MIN_GUESSES
    assert spans[10] == [] and not found[10].judged
    masked = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert masked[1] == "[SECRET] end" and masked[2] == texts[2] and masked[3] == "pwd: [SECRET]"
    # words that the documents do not hold cost their letters
    assert secrets.guess_cost("internationalization") >= secrets.MIN_GUESSES
