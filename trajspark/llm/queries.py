"""The registered queries of the operators; see ``trajspark.llm.oracles`` for their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import (
    hard_negatives,
    mixing,
    neighbours,
    ngram_join,
    oracles,
    packing,
    quality,
    secrets,
    simhash,
    spelling,
    substring_dedup,
    token_counts,
    toxicity,
    url_filter,
)
from trajspark.llm.tables import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))[0]


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("n_lines", "rejected_by")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_counts(table(spark, sf_dir, "documents"), token_counts.mask_personal_data)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def text(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *[count(k) for k in secrets.KINDS[:3]],
        F.sha2(text("base"), 256).alias("base_sha256"),
        text("spans").alias("spans"),
        F.array_join(
            F.transform("judged", lambda v: F.concat_ws(":", v["start"], v["end"], F.round(v["cost"], 3))), ","
        ).alias("guess_costs"),
    )


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


#: Weights of the mixture; the levels are domain, language and source.
MIX_WEIGHTS = {"lang": {"en": 4, "de": 2, "fr": 2}, "source": {"src0": 3, "src1": 2}}
MIX_PERCENT = 60


def mix_levels() -> dict:
    """The tree of the documents; the number of a source stands for its domain."""
    number = F.regexp_extract("source", "([0-9]+)", 1).try_cast("bigint")
    return {"domain": (number % 3).cast("string"), "lang": F.col("lang"), "source": F.col("source")}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, MIX_PERCENT)
    return mixed.select("doc_id", "lang", "source", "n_tokens", "epoch")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_ngram_join,
        op2_quality,
        op3_substring_dedup,
        op4_token_counts,
        op5_url_filter,
        op6_secrets,
        op7_neighbours,
        op8_toxicity,
        op9_packing,
        op10_mixing,
        op11_spelling,
        op12_simhash,
        op13_hard_negatives,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
