"""Corpus pipeline: documents to packed training sequences.

Each stage calls one operator of ``tarmac.llm`` on all rows that its
predecessor kept. All but the last return the columns of documents; the last
returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarmac.llm import langid, mixing, packing, simhash, toxicity
from tarmac.llm.common import materialise, table
from tarmac.llm.queries import tokenizer_path
from tarmac.session import noted_work_dirs, remove_work_dirs


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; texts without a letter go."""
    return langid.keep_identified(docs, langid.fit_languages(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    return toxicity.keep_harmless(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents repeated, once, or left out."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token windows."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# Learned models, fingerprints and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read
    again before the next one starts. Once it is written, its input and the
    tables that the stage kept for itself are deleted; the tables behind the
    result stay."""
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with noted_work_dirs() as made:
            kept = stage(spark, docs, sf_dir)
            with noted_work_dirs() as out:
                docs = materialise(kept, f"stage-{name}")
        remove_work_dirs(spark, held + [path for path in made if path not in out])
        held = out
    return STAGES[-1][1](spark, docs, sf_dir)
