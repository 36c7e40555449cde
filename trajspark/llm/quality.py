"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Base measures are taken of every document. The rules then form one CASE expression, which
stops at the first rule that rejects. Their order comes from a bounded sample: a rule costs
one unit a document for what the measures give, and one a character for each time it goes
through the text. Next is always the rule that rejects most per cost among the documents that
the rules before it let pass. The order changes the time, never the verdict.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 500
WINDOW = 5

# White space between words, symbols, and the thresholds of the rules.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: A rule is true for a document that it rejects; all count in whole numbers.
RULES: Mapping[str, str] = {
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "digits": "10 * regexp_count(text, '[0-9]') > 3 * word_chars",
    "letterless_words": r"10 * regexp_count(text, '(?<![^\\x20\\x09-\\x0D])[^A-Za-z\\x{80}-\\x{10FFFF}\\x20\\x09-\\x0D]+(?![^\\x20\\x09-\\x0D])') > 3 * n_words",
    "bullets": r"10 * regexp_count(text, '(?<![^\\n])[\\x20\\x09]*[-*\\x{2022}]\\x20') > 9 * n_lines",
    "ellipses": r"10 * regexp_count(text, '(\\.\\.\\.|\\x{2026})(?![^\\n])') > 3 * n_lines",
}


def _measured(docs: DataFrame) -> DataFrame:
    """Measures of every text; columns that later expressions read more than once stand alone.

    A filter on the result would be pushed down and repeat them: write or persist it first.
    """
    words = F.array_remove(F.split("text", SPACE + "+"), "")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = out.withColumns({"words": words, "lines": lines})
    grams = F.expr(
        f"if(size(words) < {WINDOW}, array(), transform(sequence(0, size(words) - {WINDOW}), "
        f"i -> xxhash64({', '.join(f'words[i + {k}]' for k in range(WINDOW))})))"
    )
    out = out.withColumn("grams", grams.cast("array<bigint>"))
    # only texts with a repeated window are sorted
    repeated = F.size(F.array_distinct("grams")) < F.size("grams")
    placed = F.expr("sort_array(transform(grams, (g, i) -> named_struct('g', g, 'i', i)))")
    out = out.withColumn("placed", F.when(repeated, placed))
    twice = F.expr(
        "filter(placed, (p, k) -> coalesce(get(placed, k - 1).g = p.g, false) "
        "or coalesce(get(placed, k + 1).g = p.g, false))"
    )
    out = out.withColumn("starts", F.sort_array(F.transform(twice, lambda p: p["i"])))
    covered = F.expr(
        "aggregate(sequence(0, size(starts) - 1), 0L, "
        f"(n, k) -> n + least({WINDOW}, coalesce(get(starts, k + 1) - starts[k], {WINDOW})))"
    )
    return out.select(
        "doc_id",
        "text",
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("starts") > 0, covered).otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _some(docs: DataFrame, sample: int) -> DataFrame:
    """The ``sample`` documents whose ids have the smallest hashes, found without moving a text.

    If rows with the last of these ids exceed the sample, any of them are in it.
    """
    smallest = docs.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample).collect()
    last = smallest[-1].h if smallest else 0
    return docs.select("doc_id", "text").filter(F.xxhash64("doc_id") <= last).limit(sample)


def scans(rule: str) -> int:
    """How many times a rule goes through the text."""
    return len(re.findall(r"\btext\b", re.sub(r"'[^']*'", "", rule)))


def rule_order(docs: DataFrame, rules: Mapping[str, str] = RULES, sample: int = SAMPLE) -> list[str]:
    """Rules by rejections per cost on ``sample`` documents that pass the base, the best first."""
    names = list(rules)
    flags = F.array(F.lit(False), *[F.coalesce(F.expr(rules[name]), F.lit(False)) for name in names])
    measured = _measured(_some(docs, sample))
    # at most ``sample`` groups of documents that the same rules reject
    groups = (
        measured.groupBy(F.when(~base_failed(), flags).alias("flags"))
        .agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))
        .collect()
    )
    left = sorted((tuple(g.flags[1:]), g.n, g.chars) for g in groups if g.flags is not None)
    order: list[str] = []
    while len(order) < len(names):

        def gain(k: int) -> float:
            cost = sum(n + scans(rules[names[k]]) * chars for _, n, chars in left)
            return (sum(n for rejected, n, _ in left if rejected[k]) + 0.5) / (cost + 1)

        best = max((k for k in range(len(names)) if names[k] not in order), key=gain)
        order.append(names[best])
        left = [group for group in left if not group[0][best]]
    return order


def quality(docs: DataFrame, rules: Mapping[str, str] = RULES, sample: int = SAMPLE) -> DataFrame:
    """Measures and verdict of every document.

    One row for each row of ``docs``: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_lines``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``kept`` and
    ``rejected_by`` (``base``, the first rule in the order used, or null).

    A null or empty text has no words and fails. Repeated rows and null ids are judged like
    others. An empty table gives none. A very long text is measured as a whole, in one row.
    Other columns are ignored. ``sample`` bounds the rows that the order is taken from.
    """
    order = rule_order(docs, rules, sample)
    cascade = F.when(base_failed(), "base")
    for name in order:
        cascade = cascade.when(F.expr(rules[name]), name)
    judged = _measured(docs).withColumn("rejected_by", cascade)
    return judged.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        F.col("rejected_by").isNull().alias("kept"),
        "rejected_by",
    )
