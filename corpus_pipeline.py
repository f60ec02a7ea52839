"""From raw documents to packed training sequences, in stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before it kept, and returns the columns of
documents; the last returns the pieces of packed sequences with their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from visitflow.llm.common import table
from visitflow.llm.packing import pack_documents
from visitflow.llm.quality import keep_good, language_references
from visitflow.llm.queries import WORD_VOCABULARY
from visitflow.llm.simhash import drop_near_duplicates
from visitflow.llm.toxicity import fit_toxicity, keep_clean
from visitflow.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near a language's histograms."""
    return keep_good(docs, language_references(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of severity grade 0; the model is fitted on labelled documents among them."""
    return keep_clean(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: four-word shingles, at most four differing bits."""
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids."""
    return pack_documents(docs, WORD_VOCABULARY, end_id=2)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity),
    ("SimHash near-dedup", simhash_near_dedup),
    ("packing", packing),
]

#: The stages fit models and encode texts, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
