"""The corpus pipeline: five of the text operators in a row.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all that its predecessor
kept and returns a frame that is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orfweave.llm import exact_dedup, mixing, packing, simhash, toxicity
from orfweave.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model learnt from the labels of these documents doesn't find toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_column(docs, model)
    return scored.where(F.col(toxicity.SCORE) < toxicity.THRESHOLD).select(*COLUMNS)


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = exact_dedup.new_index(spark)
    kept = exact_dedup.kept_documents(docs, index).select(*COLUMNS)
    # what is kept reads the classes, not the index
    index.drop()
    return kept


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.kept_documents(docs).select(*COLUMNS)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", _toxicity),
    ("exact dedup", _exact_dedup),
    ("SimHash near-dedup", _near_dedup),
    ("mixing sources to target weights", _mixing),
    ("packing", _packing),
]

#: Fingerprints, the dual of the mix and the model of toxicity are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name.split()[0])
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
