"""Preparing a feature table: fill gaps, encode, scale, split.

Fitted state is always a small table with one row per column (or per category),
made by aggregations that combine before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.hashing import hash_order, hash_percent
from palisade.functions.text import strip
from palisade.operators.joins import lookup_join
from palisade.operators.running import Measure, rank_by, running

# Labels that mean "no attack".
BENIGN_LABELS = ["BENIGN", "benign", "normal", "Normal", "0", "0.0"]


# Rank error of approximate quantiles is one part in this many.
QUANTILE_ACCURACY = 1000


def binary_label(label: Column) -> Column:
    """0 for a benign label, else 1 (a missing label is an attack)."""
    benign = strip(label.cast("string")).isin(BENIGN_LABELS)
    return F.when(benign, 0).otherwise(1)


def numeric(col: Column) -> Column:
    """As a number; text that is none, NaN and infinity become 0."""
    number = col.try_cast("double")
    infinite = number.isin(float("inf"), float("-inf"))
    return F.when(number.isNull() | F.isnan(number) | infinite, 0.0).otherwise(number)


def _cell(column: str) -> Column:
    """The value as a number; NaN counts as missing."""
    number = F.col(column).cast("double")
    return F.when(~F.isnan(number), number)


def _bands(df: DataFrame, columns: Sequence[str], p: float) -> list[tuple]:
    """(column, rows, rows below the band, band start, band end) per column.

    An approximate quantile, whose rank error is bounded, brackets the wanted
    positions; counting the rows below and inside makes sure of it. Should the
    positions lie outside, the band is the whole column.
    """
    margin = 2.0 / QUANTILE_ACCURACY
    around = [max(0.0, p - margin), min(1.0, p + margin)]
    rough = df.agg(
        *[
            F.percentile_approx(_cell(c), around, QUANTILE_ACCURACY).alias(f"q{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    known = [(i, c, *rough[f"q{i}"]) for i, c in enumerate(columns) if rough[f"q{i}"]]
    if not known:
        return []
    row = df.agg(
        *[F.count(_cell(c)).alias(f"n{i}") for i, c, _, _ in known],
        *[F.count_if(_cell(c) < F.lit(low)).alias(f"b{i}") for i, c, low, _ in known],
        *[F.count_if(_cell(c) <= F.lit(high)).alias(f"u{i}") for i, c, _, high in known],
    ).first()
    out = []
    for i, c, low, high in known:
        total, below, upto = row[f"n{i}"], row[f"b{i}"], row[f"u{i}"]
        position = (total - 1) * p
        if below <= math.floor(position) and math.ceil(position) < upto:
            out.append((c, total, below, low, high))
        else:
            out.append((c, total, 0, float("-inf"), float("inf")))
    return out


def quantiles(df: DataFrame, columns: Sequence[str], p: float) -> DataFrame:
    """Exact interpolated quantile of each column: (column, value).

    Two aggregations narrow every column to a band of a few thousandths of its rows;
    only these are counted by value and put in order.
    """
    bands = _bands(df, columns, p)
    ddl = "column string, total long, below long, low double, high double"
    sizes = df.sparkSession.createDataFrame(bands, ddl)
    inside = [
        F.when(
            _cell(c).between(F.lit(low), F.lit(high)),
            F.struct(F.lit(c).alias("column"), _cell(c).alias("value")),
        )
        for c, _, _, low, high in bands
    ]
    if not bands:
        return sizes.select("column", F.col("low").alias("value"))
    counts = (
        df.select(F.explode(F.array_compact(F.array(*inside))).alias("cell"))
        .groupBy("cell.column", "cell.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = running(counts, ["column"], ["value"], [Measure("upto", "sum", F.col("n"))])
    # One row per column of the table, so the lookup side is as small as the schema.
    placed = upto.join(F.broadcast(sizes), "column").withColumn(
        "upto", F.col("upto") + F.col("below")
    )
    position = (F.col("total") - 1) * F.lit(float(p))
    low, high = F.floor(position), F.ceil(position)

    def at(rank: Column) -> Column:
        hit = (rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto"))
        return F.max(F.when(hit, F.col("value")))

    picked = placed.groupBy("column").agg(
        at(low).alias("lo"), at(high).alias("hi"), F.max(position - low).alias("part")
    )
    return picked.select(
        "column", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("value")
    )


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent text of each column, the smallest on a tie: (column, value)."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                for c in columns
            ]
        )
    )
    counts = (
        df.select(cells.alias("cell"))
        .where("cell.value IS NOT NULL")
        .groupBy("cell.column", "cell.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value")
    )


def fit_fill(df: DataFrame, numbers: Sequence[str], texts: Sequence[str]) -> dict[str, object]:
    """Fill values: median per number, mode (else ``unknown``) per text.

    One value per column of the table comes to the driver.
    """
    fill: dict[str, object] = {c: 0.0 for c in numbers} | {c: "unknown" for c in texts}
    if numbers:
        fill |= {r["column"]: r["value"] for r in quantiles(df, numbers, 0.5).collect()}
    if texts:
        fill |= {r["column"]: r["value"] for r in modes(df, texts).collect()}
    return fill


def apply_fill(df: DataFrame, fill: dict[str, object]) -> DataFrame:
    """Missing cells filled; NaN is missing, as it is when the fill values are fitted."""

    def filled(name: str, kind: str) -> Column:
        value = F.lit(fill[name])
        cell = F.col(name)
        if kind in ("double", "float"):
            cell = F.nanvl(cell, value)
        return F.coalesce(cell, value).alias(name)

    return df.select(*[filled(c, kind) if c in fill else F.col(c) for c, kind in df.dtypes])


def fit_classes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the sorted distinct values numbered from 0."""
    values = df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL")
    ranked = rank_by(values.distinct(), [], ["value"], "code")
    return ranked.select("value", (F.col("code") - 1).alias("code"))


def encode(
    df: DataFrame, column: str, classes: DataFrame | None, row_id: str, out: str
) -> DataFrame:
    """Add the class code; an unseen value gets the next free code, and without
    fitted classes everything is 0."""
    if classes is None:
        return df.withColumn(out, F.lit(0).cast("long"))
    table = classes.select(F.col("value").alias(column), F.col("code").alias(out))
    n_classes = classes.count()
    joined = lookup_join(df, table, [column], how="left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(n_classes).cast("long")))


def fit_scale(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) per column, in one aggregation of one row."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 0.0) for i, c in enumerate(columns)}


def scaled(column: str, mean: float, deviation: float) -> Column:
    """Z-score; a constant column becomes 0."""
    divisor = deviation if deviation > 0 else 1.0
    return (F.col(column) - F.lit(mean)) / F.lit(divisor)


def apply_scale(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(
        *[scaled(c, *scale[c]).alias(c) if c in scale else F.col(c) for c in df.columns]
    )


def sample_rows(df: DataFrame, row_id: str, n: int) -> DataFrame:
    """Exactly ``n`` rows (or all), the same ones on every run: lowest id hashes first.

    Hashes are even, so a bound on the hash leaves slightly more rows than wanted and
    only these are put in order. Were it to leave too few, all rows would be.
    """
    total = df.count()
    if n >= total:
        return df
    hashed = df.withColumn("__hash", hash_order(F.col(row_id)))
    share = min(1.0, (n + 10.0 * math.sqrt(n) + 100.0) / total)
    bound = format(min(int(share * 16**12), 16**12 - 1), "012x")
    few = hashed.where(F.substring("__hash", 1, 12) <= bound)
    candidates = few if few.count() >= n else hashed
    ranked = rank_by(candidates, [], ["__hash", row_id], "__rank")
    return ranked.where(F.col("__rank") <= n).drop("__hash", "__rank")


def benign_split(df: DataFrame, label: str, row_id: str, test_percent: int = 20) -> DataFrame:
    """Add ``split``: train (80 % of benign), test (the other benign rows and as many
    attacks at most), or NULL for attacks left out."""
    is_test = hash_percent(F.col(row_id)) >= 100 - test_percent
    marked = df.withColumn("__benign_test", (F.col(label) == 0) & is_test)
    n_test = marked.agg(F.count_if("__benign_test")).first()[0]
    attacks = sample_rows(marked.where(F.col(label) == 1), row_id, n_test)
    benign = marked.where(F.col(label) == 0).withColumn(
        "split", F.when(F.col("__benign_test"), "test").otherwise("train")
    )
    return benign.unionByName(attacks.withColumn("split", F.lit("test"))).drop("__benign_test")


def stratified_split(
    df: DataFrame, label: str, row_id: str, test_share: float = 0.2
) -> DataFrame:
    """Add ``split`` so that every label has the same share of test rows."""
    hashed = df.withColumn("__hash", hash_order(F.col(row_id)))
    ranked = rank_by(hashed, [label], ["__hash", row_id], "__rank")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    joined = lookup_join(ranked, sizes, [label])
    share = F.coalesce(F.try_divide(F.col("__rank") - 1, F.col("__n") - 1), F.lit(0.0))
    return joined.withColumn(
        "split", F.when(share >= 1 - test_share, "test").otherwise("train")
    ).drop("__hash", "__rank", "__n")


@dataclass
class Preparation:
    """Fitted steps: the same filling, encoding and scaling for training and scoring."""

    numbers: list[str]
    texts: list[str]
    fill: dict[str, object]
    classes: dict[str, DataFrame]
    scale: dict[str, tuple[float, float]]
    tag: str = ""

    @property
    def features(self) -> list[str]:
        return [*self.numbers, *self.texts]

    def key(self) -> str:
        """Equal for equal steps."""
        return self.tag or repr((self.numbers, self.texts, self.fill, self.scale))

    def encoded(self, df: DataFrame, row_id: str, keep: Sequence[str] = ()) -> DataFrame:
        """All features as finite numbers, not yet scaled."""
        typed = df.select(
            row_id,
            *keep,
            *[F.col(c).try_cast("double").alias(c) for c in self.numbers],
            *[F.col(c).cast("string").alias(c) for c in self.texts],
        )
        filled = apply_fill(typed, self.fill)
        for c in self.texts:
            coded = encode(filled, c, self.classes[c], row_id, f"__{c}")
            filled = coded.drop(c).withColumnRenamed(f"__{c}", c)
        return filled.select(row_id, *keep, *[numeric(F.col(c)).alias(c) for c in self.features])

    def apply(self, df: DataFrame, row_id: str, keep: Sequence[str] = ()) -> DataFrame:
        """(row id, kept columns, features) with every feature scaled."""
        return apply_scale(self.encoded(df, row_id, keep), self.scale)


def fit_preparation(
    df: DataFrame, row_id: str, numbers: Sequence[str], texts: Sequence[str] = ()
) -> Preparation:
    """Fit all steps on the given rows, in the order they are applied."""
    steps = Preparation(list(numbers), list(texts), fit_fill(df, numbers, texts), {}, {})
    filled = apply_fill(df, steps.fill)
    steps.classes = {c: fit_classes(filled, c) for c in texts}
    steps.scale = fit_scale(steps.encoded(df, row_id), steps.features)
    return steps
