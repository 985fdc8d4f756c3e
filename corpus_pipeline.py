"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), with docs a table read from files, and returns a
DataFrame. The runner writes it as Parquet and reads it again for the next stage. All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.llm.bpe import encode_and_decode, word_vocabulary
from palisade.llm.common import table
from palisade.llm.decontamination import without_leaks
from palisade.llm.near_duplicates import keep_one
from palisade.llm.ranking import keep_good, learn
from palisade.llm.repeats import passages_of, remove_repeats
from palisade.session import written


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking rejects go."""
    return keep_good(docs, learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 51 words that another document has too are cut out; the documents stay."""
    return remove_repeats(docs, passages_of())


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, and the text that they decode to."""
    return encode_and_decode(docs, word_vocabulary())


STAGES = [
    ("quality", drop_bad),
    ("near_duplicates", drop_near_copies),
    ("repeats", cut_repeats),
    ("decontamination", drop_leaks),
    ("tokens", to_tokens),
]

# The stages can't be told in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
