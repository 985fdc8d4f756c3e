"""Texts that share most of their words, found without comparing all pairs.

Equal sets of words are one set from the start. Words are put in a global order, rarest first. Two sets whose
Jaccard similarity is at least t share a word among the first |x| - ceil(t |x|) + 1 words of either: the prefix. So
only sets that meet in a prefix word, and whose sizes allow the similarity, are candidates; they are compared in full.
As prefixes hold the rarest words, a word that all texts have brings nobody together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.dedup import tokens
from palisade.session import written

SIMILARITY = 0.8


def word_sets(rows: DataFrame, text: Column) -> DataFrame:
    """Add ``words``, the sorted distinct words of a text, and ``set_id``, which is equal for equal sets."""
    words = F.array_sort(tokens(F.coalesce(text, F.lit(""))))
    return rows.withColumn("words", words).withColumn("set_id", F.md5(F.array_join("words", " ").cast("binary")))


def similar_sets(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) with a < b of different sets (set_id, words); empty sets are similar to none."""
    sets = written(sets.select("set_id", "words").where(F.size("words") > 0).distinct(), "similar-sets")
    each = sets.select("set_id", F.size("words").alias("size"), F.explode("words").alias("word"))
    counts = written(each.groupBy("word").count(), "similar-words")
    ranked = each.join(counts, "word").groupBy("set_id", "size").agg(F.sort_array(F.collect_list(F.struct("count", "word"))).alias("ordered"))
    keep = F.col("size") - F.ceil(F.col("size") * F.lit(similarity) - F.lit(1e-9)).cast("int") + 1
    prefixes = ranked.select("set_id", "size", F.explode(F.slice("ordered", F.lit(1), keep)).alias("w")).select("set_id", "size", "w.word")
    prefixes = written(prefixes, "similar-prefixes")
    left, right = (prefixes.select(F.col("set_id").alias(x), F.col("size").alias(f"n_{x}"), "word") for x in "ab")
    fit = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(similarity) - F.lit(1e-9)
    pairs = left.join(right, "word").where((F.col("a") < F.col("b")) & fit).select("a", "b").distinct()
    first, second = (sets.select(F.col("set_id").alias(x), F.col("words").alias(f"words_{x}")) for x in "ab")
    both = F.size(F.array_intersect("words_a", "words_b"))
    share = both / (F.size("words_a") + F.size("words_b") - both)
    found = pairs.join(first, "a").join(second, "b").select("a", "b", share.alias("similarity"))
    return found.where(F.col("similarity") >= similarity)


def classes(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set_id, class_id): the least set of those that links join, directly or over others.

    Each round takes every set's least neighbouring class and then that class's class, so that chains shorten by
    half; minima are combined before the shuffle, so a set with any number of links is no bottleneck.
    """
    links = written(
        pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "class-links"
    )
    now = written(nodes.select("set_id", F.col("set_id").alias("class_id")).distinct(), "classes")
    while True:
        seen = links.join(now, links["b"] == now["set_id"]).groupBy("a").agg(F.min("class_id").alias("near"))
        nearer = now.join(seen, now["set_id"] == seen["a"], "left").select(
            "set_id", F.col("class_id").alias("old"), F.least("class_id", "near").alias("class_id")
        )
        nearer = written(nearer, "classes-near")
        up = nearer.select(F.col("set_id").alias("c"), F.col("class_id").alias("up"))
        after = nearer.join(up, nearer["class_id"] == up["c"]).select("set_id", "old", F.least("class_id", "up").alias("class_id"))
        after = written(after, "classes")
        now = after.select("set_id", "class_id")
        if after.where("old <> class_id").isEmpty():
            return now


def similar_classes(rows: DataFrame, row_id: str, text: Column, similarity: float = SIMILARITY) -> DataFrame:
    """(row id, set_id, class_id, n_similar) of every row: its class of similar texts, and to how many other sets
    of words its own is similar. Rows of equal words are of one class and are not expanded into pairs."""
    known = written(word_sets(rows.select(F.col(row_id), text.alias("__text")), F.col("__text")).select(row_id, "words", "set_id"), "similar-rows")
    pairs = written(similar_sets(known, similarity), "similar-pairs")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    found = classes(known.select("set_id").distinct(), pairs).join(degree, "set_id", "left")
    return known.select(row_id, "set_id").join(found, "set_id").select(
        row_id, "set_id", "class_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_similar")
    )
