"""From raw documents to packed sequences: five stages of the llm subpackage.

Each stage takes all that its predecessor kept.  All but the last return the
columns of documents.  A stage's documents are a written table; what earlier
stages wrote for themselves is removed when a stage begins.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from taskframe.llm import queries
from taskframe.llm.frames import drop_tables, noted, read, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# Scratch tables of the stage that ran last.
_own: list[str] = []


def stage(f: Stage) -> Stage:
    """Drops what the stage before kept for itself, whose rows are written by now."""
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(_own, docs)
        with noted(_own):
            return f(spark, docs, sf_dir)
    return run


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a rule rejects."""
    return queries.passing_rules(docs, read(spark, sf_dir, "labels"))


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents scored below the cutoff."""
    scored = queries.with_quality(docs, read(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(docs.columns)


@stage
def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id."""
    return queries.without_duplicates(docs)


@stage
def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data pseudonymised, and n_chars of the new text."""
    return queries.without_personal_data(docs)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return queries.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("simhash", simhash),
    ("pii", pii), ("packing", packing)]
# Tokens, nearest neighbours and fingerprints are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for n, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
