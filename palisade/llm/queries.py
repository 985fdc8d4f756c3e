"""The registered queries of this folder and the SQL that checks them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.llm.bpe import bpe_digests, word_vocabulary
from palisade.llm.common import table
from palisade.llm.decontamination import leak_report
from palisade.llm.hard_negatives import ORACLE as MINE_SQL
from palisade.llm.hard_negatives import mining_report
from palisade.llm.line_blocks import extract
from palisade.llm.mixing import ORACLE as MIX_SQL
from palisade.llm.mixing import mix_report
from palisade.llm.near_duplicates import near_report
from palisade.llm.periodic_runs import run_report
from palisade.llm.quality_rules import ORACLE as RULES_SQL
from palisade.llm.quality_rules import judge as judge_quality
from palisade.llm.ranking import learn, score
from palisade.llm.repeats import repeat_report
from palisade.llm.sharding import shard_report
from palisade.llm.token_files import byte_vocabulary, token_file_report
from palisade.llm.url_equivalence import ORACLE as URL_SQL
from palisade.llm.url_equivalence import judge
from palisade.session import configure, ship_packages

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
Query = Callable[[SparkSession, str], DataFrame]


def prepared(fn: Query) -> Query:
    """The query, run in a session that is configured and has this package on its workers."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        ship_packages(spark, PACKAGE)
        return fn(spark, sf_dir)

    run.__doc__ = fn.__doc__
    return run


def op1_language_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every document by counts and by its distance from its language."""
    return judge_quality(table(spark, sf_dir, "documents"))


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document with the merge automaton and decode it again."""
    return bpe_digests(table(spark, sf_dir, "documents"), word_vocabulary())


def op3_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut strings of 400 bytes that occur elsewhere out of every document."""
    return repeat_report(table(spark, sf_dir, "documents"))


def op4_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return near_report(table(spark, sf_dir, "documents"))


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document by preferences learnt from the labels."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut all documents, in order of doc_id, into 16 shards of equal bytes."""
    return shard_report(table(spark, sf_dir, "documents"))


def op7_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find items of the benchmark in all documents."""
    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents Huffman-coded, and read them back."""
    return token_file_report(table(spark, sf_dir, "documents"), byte_vocabulary())


def op9_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge the url of every page by the rules, or by what its aliases inherit."""
    return judge(table(spark, sf_dir, "pages"))


def op10_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract the main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op11_synchronising_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find the periodic runs of words of every document."""
    return run_report(table(spark, sf_dir, "documents"))


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mine hard negatives for every fiftieth vector from all vectors."""
    return mining_report(table(spark, sf_dir, "embeddings"))


def op13_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to the weights of their sources."""
    return mix_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: prepared(f)
    for f in (
        op1_language_divergence,
        op2_bpe_automaton,
        op3_prefix_doubling,
        op4_prob_minhash,
        op5_pairwise_quality,
        op6_byte_shards,
        op7_latent_retrieval,
        op8_huffman_tokens,
        op9_url_aliases,
        op10_line_blocks,
        op11_synchronising_sets,
        op12_multi_index,
        op13_source_schedule,
    )
}
ORACLES: dict[str, str] = {"op1_language_divergence": RULES_SQL, "op9_url_aliases": URL_SQL, "op12_multi_index": MINE_SQL, "op13_source_schedule": MIX_SQL}
