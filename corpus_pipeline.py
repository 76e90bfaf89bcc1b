"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as
the next stage's documents, so a lost executor costs at most a stage.  All but the last return the columns of
documents.

Defined cases, of every stage: null texts count as empty (they score as texts without hits, are copies of each other,
have fingerprint zero, hold no words and so take no part in the mix); null sources are one source; null ids pass
through, and lose against any id where one row of a group stays; of repeated rows one stays from exact dedup on; other
columns, whatever their names, ride along up to packing; long texts are handled whole; an empty table gives an empty
table; without labels nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact, mixing, packing, simhash, toxicity
from tessera.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model fitted on the labels."""
    return toxicity.accepted_rows(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each normalised text."""
    return exact.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each component of near-equal fingerprints."""
    return simhash.kept_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights, a row for each document and epoch that it takes words of."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Scores, fingerprints, draws and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
