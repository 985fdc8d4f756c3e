"""Mixing sources to target weights, by a low-discrepancy schedule of equal blocks.

Every source has a weight. The mix takes ``SHARE`` times the words of all documents, split by
the weights, and no source gives more than ``MOST`` times what it has: what a source can't give
is shared among the others by weight (:func:`targets`).

The mix is a sequence of slots. Slot k belongs to the source in whose part of the unit interval
the van der Corput point of k falls (the binary digits of k, mirrored behind the point); the
parts are as long as the targets. So any stretch of the sequence holds the sources in their
proportions, but for about log2(stretch) slots. A source's slots are numbered in order, and its
words, documents in shuffled order, are cut into as many equal blocks: slot number r takes block
r. After its last word a source begins anew with its first, and no target reaches a third lap.

All of it is DataFrame expressions. Texts are read to count their words and never shuffled for
it. A source may hold any share of the rows: rows are laid out by range of (source, shuffled
key), summed by partition, and partitions are summed over one row each. Only the table of sources,
one row each, passes through a single window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import column, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
# Words of a slot, before blocks are made equal.
BLOCK = 1024
# Binary digits of a point; slots numbered in one window; equal cells of the unit interval.
DIGITS = 52
CHUNK = 1024
CELL = DIGITS - 10

WORD = "[^\\x20\\x09-\\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    marks = F.translate(F.regexp_replace(text, WORD, "w"), WHITE, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def shuffled(doc_id: Column) -> Column:
    """What a source's documents are ordered by: a digest of the id."""
    return F.substring(F.md5(F.concat(F.lit("mix:"), doc_id.cast("string")).cast("binary")), 1, 16)


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, doc_id, source, size, key): one row a document, told apart by ``row``.

    ``key`` shuffles the documents of a source, and reruns agree on it. Rows that are equal in
    id and size keep the order they are read in.
    """
    rows = docs.select(
        column(id_col).alias("doc_id"),
        column(source_col).alias("source"),
        word_count(column(text_col)).alias("size"),
        shuffled(column(id_col)).alias("key"),
    )
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")


def targets(
    rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """(source, number, weight, source_size, target, words) of every source of (source, size).

    Sources are numbered by code point, null last, and weighted by ``weights`` in turn. A target
    is the least of ``most`` times the source's size and level * weight, with the level at
    which the targets add up: sources are taken in order of the size that a unit of weight
    stands for, and each level leaves out those that are full before. ``words`` is the
    target rounded. Sources without words have target 0.
    """
    each = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("number"), F.lit(len(weights))) + 1).cast("int"))
    # One row a source.
    each = each.withColumn("number", (number - 1).cast("long")).withColumn("weight", weight.cast("long"))
    full = F.col("source_size") * most
    order = Window.orderBy(full.cast("double") / F.col("weight"), "number")
    before = F.coalesce(F.sum(full).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = (F.lit(share) * total.cast("double") - before.cast("double")) / left.cast("double")
    each = each.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy()))
    target = F.least(full.cast("double"), F.col("level") * F.col("weight"))
    return each.select(
        "source", "number", "weight", "source_size", target.alias("target"), F.floor(target + 0.5).cast("long").alias("words")
    )


def point(slot: Column) -> Column:
    """The van der Corput point of a slot's number, as an integer below 2^DIGITS."""
    return F.conv(F.reverse(F.lpad(F.bin(slot), DIGITS, "0")), 2, 10).cast("long")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, number, rank, slots): the source of every slot, how many of its slots come before,
    and how many it has.

    There are as many slots as the words of all targets fill, and one more at the end for each
    source that has words but got no slot. Slots meet the parts of the unit interval that share
    their cell, one of 1,024 equal ones; points fall evenly into cells.
    """
    spark = sources.sparkSession
    in_all = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    sources = sources.where("words > 0").select("number", "words").withColumn("until", F.sum("words").over(in_all))
    sources = written(sources, "mix-parts")
    words = sources.agg(F.max("until")).first()[0] or 0
    slots = -(-words // block)
    edge = lambda c: F.floor(c / F.lit(float(max(words, 1))) * F.lit(float(1 << DIGITS))).cast("long")
    parts = (
        sources.select("number", edge(F.col("until") - F.col("words")).alias("low"), edge(F.col("until")).alias("high"))
        .where("high > low")
        .withColumn("cell", F.explode(F.sequence(F.shiftright("low", CELL), F.shiftright(F.col("high") - 1, CELL))))
    )
    points = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("point"))
    points = points.withColumn("cell", F.shiftright("point", CELL))
    dealt = written(
        points.join(parts, "cell").where("point >= low and point < high").select("slot", "number"), "mix-slots"
    )
    late = sources.join(dealt.select("number").distinct(), "number", "left_anti").select(
        (F.row_number().over(Window.orderBy("number")) - 1 + F.lit(slots)).cast("long").alias("slot"), "number"
    )
    dealt = dealt.unionByName(late).withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    # A chunk is complete in its partition, so the window needs no further shuffle.
    inside = Window.partitionBy("chunk", "number").orderBy("slot")
    ranked = dealt.repartition("chunk").withColumn("here", (F.row_number().over(inside) - 1).cast("long"))
    ranked = written(ranked, "mix-ranked")
    earlier = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # One row a chunk and source.
    counts = ranked.groupBy("chunk", "number").agg(F.count("*").alias("n"))
    counts = counts.select(
        "chunk",
        "number",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("number")).alias("slots"),
    )
    return ranked.join(counts, ["chunk", "number"]).select(
        "slot", "number", (F.col("before") + F.col("here")).alias("rank"), "slots"
    )


def laid_out(rows: DataFrame) -> DataFrame:
    """Add ``start``: the words of the same source before this document, in shuffled order."""
    order = ["key", "doc_id", "size", "row"]
    laid = rows.repartitionByRange("source", *order).withColumn("part", F.spark_partition_id())
    laid = written(laid, "mix-layout")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a partition and source.
    totals = laid.groupBy("part", "source").agg(F.sum("size").alias("words"))
    totals = totals.select(
        F.col("part").alias("p"), F.col("source").alias("s"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("part", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.withColumn("here", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    match = (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))
    return placed.join(totals, match).withColumn("start", F.col("before") + F.col("here")).drop("p", "s", "before", "here")


def mixture(rows: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, place, row, doc_id, source, begin, end): the mix, in order of (slot, place).

    Each row is a stretch of a document's words, ``begin`` to before ``end``; ``place`` is the number of
    words before it in its slot. A document appears once in each lap and block that it reaches;
    those without words never do.
    """
    plan = schedule(sources, block)
    plan = written(plan, "mix-schedule")
    widths = plan.groupBy("number").agg(F.max("slots").alias("n"))
    use = sources.where("words > 0").join(widths, "number")
    use = use.select(
        F.col("source").alias("s"), "number", "source_size", "words", F.ceil(F.col("words") / F.col("n")).cast("long").alias("width")
    )
    placed = laid_out(rows).where("size > 0").join(use, F.col("source").eqNullSafe(F.col("s")))
    first = F.col("start") + F.col("lap") * F.col("source_size")
    laps = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / F.col("source_size"))))
    stretches = (
        placed.withColumn("lap", laps)
        .withColumn("first", first)
        .withColumn("last", F.least(first + F.col("size"), F.col("words")))
        .where("first < last")
    )
    number_of = lambda word: F.expr(f"{word} div width")
    cut = stretches.withColumn("rank", F.explode(F.sequence(number_of("first"), number_of("(last - 1)"))))
    opens = F.col("rank") * F.col("width")
    begin = F.greatest(F.col("first"), opens)
    cut = cut.select(
        "number",
        "rank",
        (begin - opens).alias("place"),
        "row",
        "doc_id",
        "source",
        (begin - F.col("first")).alias("begin"),
        (F.least(F.col("last"), opens + F.col("width")) - F.col("first")).alias("end"),
    )
    return cut.join(plan.select("number", "rank", "slot"), ["number", "rank"]).drop("number", "rank")


def mixed_texts(
    docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(slot, place, source, doc_id, text): the words of the mix, joined by one space, in order of (slot, place)."""
    copy = docs.select(
        column(id_col).alias("doc_id"), column(text_col).alias("text"), column(source_col).alias("source")
    )
    copy = written(copy.withColumn("row", F.monotonically_increasing_id()), "mix-texts")
    narrow = copy.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffled(F.col("doc_id")).alias("key"), "row")
    rows = written(narrow, "mix-rows")
    mix = mixture(rows, written(targets(rows), "mix-sources"), block)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    piece = F.array_join(F.slice(words, F.col("begin").cast("int") + 1, (F.col("end") - F.col("begin")).cast("int")), " ")
    return mix.join(copy.select("row", "text"), "row").select("slot", "place", "source", "doc_id", piece.alias("text"))


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document, ``taken`` summed over the mix.

    Nulls: a null text has no words, null sources are one source, rows with null or repeated ids
    are each a document of their own. Rows equal in id, source and size may change places. An
    empty table gives none. Columns of other names are not read.
    """
    rows = numbered(docs)
    sources = written(targets(rows), "mix-sources")
    used = mixture(rows, sources).groupBy("row").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    each = sources.select(F.col("source").alias("s"), "source_size", "target")
    return (
        rows.join(used, "row", "left")
        .join(each, F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


# What the mix takes of a document follows from the targets and the shuffled order alone.
ORACLE = """
WITH rows AS (
  SELECT doc_id, source, substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 16) AS key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
  FROM rows GROUP BY source
), weighted AS (
  SELECT *, CASE number % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sizes
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(2 * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, number
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, number
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighted
), aims AS (
  SELECT source, source_size,
    least(2.0::DOUBLE * source_size, (SELECT max(level) FROM levels) * weight) AS target
  FROM levels
), placed AS (
  SELECT r.doc_id, r.size, a.source_size, a.target, CAST(floor(a.target + 0.5) AS BIGINT) AS words,
    CAST(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key NULLS FIRST, r.doc_id, r.size
      ROWS UNBOUNDED PRECEDING) AS BIGINT) - r.size AS start
  FROM rows r JOIN aims a ON r.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target, CAST(
  greatest(0, least(start + size, words) - start)
  + greatest(0, least(start + size + source_size, words) - start - source_size) AS BIGINT) AS taken
FROM placed
"""
