"""A corpus pipeline: toxic documents and near duplicates go, secrets are masked, sources are mixed, the rest is packed.

Every stage works on all that the one before kept, which is written as Parquet and read
again. All but the last return the columns of ``documents``, further ones included,
whatever their names. Rows with a null or empty text pass every stage and are packed as
an end id; a null language or source is a leaf of its own; rows with a null ``doc_id`` are
no copies of each other; of rows with one ``doc_id`` one is kept. Empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import mixing, ngram_join, packing, secrets, toxicity
from trajspark.llm.queries import MIX_WEIGHTS, mix_levels
from trajspark.llm.tables import set_aside, table, written

#: The mixture has as many tokens as its input.
MIX_PERCENT = 100


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic."""
    held, back = set_aside(docs, "doc_id", "text")
    found = toxicity.scored(held, table(spark, sf_dir, "labels"))
    return found.filter("predicted = 0").select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    found, _ = ngram_join.ngram_jaccard_join(docs)
    return ngram_join.one_of_each(docs, written(found, "found"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` follows where one was."""
    masked = secrets.redact(docs)
    length = F.when(F.contains("text", F.lit(secrets.MASK)), F.char_length("text").cast("bigint"))
    return masked.withColumn("n_chars", F.coalesce(length, "n_chars")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by target weights; a document of the second epoch comes twice."""
    held, back = set_aside(docs, "doc_id", "text", "lang", "source")
    return mixing.mix(held, mix_levels(), MIX_WEIGHTS, MIX_PERCENT).select(*back)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained model decides, which SQL cannot express; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
