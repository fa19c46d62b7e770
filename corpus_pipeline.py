"""Training-data pipeline over ``documents``: each stage works on all that the stage before it kept.

STAGES lists the stages; ``run`` applies them, each written to the shared checkpoint folder and read
again, so a lost executor costs one stage's open tasks.  All stages but the last return the columns of
``documents``; the last returns them with the piece ids in place of the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covista.llm import decontamination, piece_codec, quality, secret_scan, simhash
from covista.llm.common import cut_lineage, drop_table, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the smallest id."""
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking credentials replaced by a mark and ``n_chars`` to match."""
    return secret_scan.redact(docs, secret_scan.scan(docs), length_col="n_chars")


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids (they decode to the texts) and their number, in place of the texts."""
    coded = piece_codec.encode(docs, MODEL)
    return coded.drop("text").withColumn("n_ids", F.size("ids"))


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("secret scan", without_secrets),
    ("piece ids", as_pieces),
]

# No stage has an SQL form: trained models, hashing, automata.  The tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), "stage")
        drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
