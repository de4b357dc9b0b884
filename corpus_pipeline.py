"""From raw documents to token shards: language, near copies, benchmark passages, mix, ids.

Every stage takes the whole table of what the stage before kept and returns the columns of `documents`; the last one returns what it reads
back from its files. Rows are followed by their content, so null or repeated ids are no trouble.
"""

from __future__ import annotations

import os
import sys
from fractions import Fraction

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from bagframe.llm import store  # noqa: E402
from bagframe.llm.decontaminate import without_contaminated  # noqa: E402
from bagframe.llm.jaccard_join import one_of_each  # noqa: E402
from bagframe.llm.language import fit, recognised  # noqa: E402
from bagframe.llm.mixing import mixed_documents  # noqa: E402
from bagframe.llm.queries import importable, table, vocabulary  # noqa: E402
from bagframe.llm.token_shards import token_digest  # noqa: E402


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the random field recognises."""
    importable(spark)
    return recognised(docs, fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, five-word shingles, Jaccard 0.8 or more: the one with the smallest id."""
    importable(spark)
    return one_of_each(docs, Fraction(8, 10), 5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them."""
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Start, number and checksum of the ids of every document, read back from the shards."""
    importable(spark)
    return token_digest(docs, vocabulary())


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontamination),
          ("mixing sources to target weights", mixing), ("token-ID / binary output", token_output)]

#: SQL cannot express the language model, the schedule of the mix or the token ids; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
