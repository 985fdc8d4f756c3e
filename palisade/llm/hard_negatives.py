"""Hard negatives of labelled vectors, found exactly with an inverted multi-index.

Vectors are cut in two halves. Each half has a codebook, fitted by k-means on at most ``SAMPLE`` rows
(those with the least hash of their place). The pair of nearest centroids is a row's cell. Every row is
indexed: rows are laid out by cell and cut into slabs of about ``SLAB`` rows, wherever that falls,
so a vector that a third of all rows share fills slabs of its own.

A search meets every slab with every block of ``ANCHORS`` anchors. For one anchor a,
a row's half-score is at most a.m + |a| r, with m the centroid of its half and r the largest distance
of the slab's rows from m. Each half's bounds are sorted, and a heap visits the pairs, cells,
from the largest sum on (the multi-sequence algorithm). A cell's rows are scored exactly, in whole
numbers. The search of a slab ends when the next sum is below the worst score that still counts: then what is
found is certain. Two searches are needed:

1. the best rows of the anchor's own label, its positives;
2. for the window of scores below each positive, the best rows of other labels. Cells that by their lower
   bound lie above all windows are passed over. All windows of an anchor share one visit.

What slabs find, at most a few rows for an anchor, is ranked across slabs by Spark. On vectors without any
structure bounds exclude little, and then the work is that of scoring all pairs of anchors and rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import column, written

POSITIVES = 5
NEGATIVES = 3
# Percent of the positive's score that a negative's may have.
LEAST, MOST = 50, 95

SAMPLE = 8192
SLAB = 8192
ANCHORS = 65_536
# Centroids of a half at most; rows of a cell wanted.
CENTROIDS = 64
PER_CELL = 128

LONGEST = np.iinfo(np.int64).max
_CELLS = "row long, vec_id long, label long, vec binary, c1 int, c2 int"


@dataclass(frozen=True)
class Codebook:
    """The centroids of both halves, the number of components, and whether scores may exceed 2^53."""

    first: np.ndarray
    second: np.ndarray
    size: int
    wide: bool

    @property
    def half(self) -> int:
        return self.size // 2


def whole_numbers(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(row, vec_id, label, vec): components times 256, rounded down, of the rows that take part.

    Rows with a null label, a null vector, or any null or non-finite component don't. ``row`` tells
    rows apart, whatever their ids.
    """
    vec, big = column(vec_col), F.lit(float("inf"))
    fit = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    out = rows.where(column(label_col).isNotNull() & vec.isNotNull() & fit).select(
        column(id_col).cast("long").alias("vec_id"),
        column(label_col).cast("long").alias("label"),
        F.transform(vec, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")).alias("vec"),
    )
    return written(out.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "label", "vec"), "mine-rows")


def _matrix(vecs: list[list[int]], size: int) -> np.ndarray:
    """The vectors, short ones filled up with zeros."""
    out = np.zeros((len(vecs), size), np.int64)
    for at, vec in enumerate(vecs):
        out[at, : len(vec)] = vec
    return out


def k_means(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k centroids of the points, from evenly spaced distinct ones on."""
    distinct = np.unique(points, axis=0)
    centers = distinct[np.unique(np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int))]
    for _ in range(rounds):
        near = nearest(points, centers)
        count = np.bincount(near, minlength=len(centers)).astype(float)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers * centers).sum(1) - 2 * points @ centers.T).argmin(1)


def fit(rows: DataFrame, sample: int = SAMPLE) -> Codebook | None:
    """The codebook of (row, vec); none if there are no rows. At most ``sample`` rows come to the driver."""
    size = F.size("vec")
    most = F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))
    n, size, most = rows.agg(F.count("*"), F.max(size), F.max(most)).first()
    if not n:
        return None
    few = rows.select("row", "vec").orderBy(F.xxhash64("row"), "row").limit(sample).toArrow()
    points = _matrix(few.column("vec").to_pylist(), size).astype(float)
    k = max(1, min(CENTROIDS, isqrt(n // PER_CELL)))
    half = size // 2
    wide = (most or 0.0) ** 2 * size >= 2.0**53
    return Codebook(k_means(points[:, :half], k), k_means(points[:, half:], k), size, wide)


def build_index(rows: DataFrame, book: Codebook, slab: int = SLAB) -> DataFrame:
    """(row, vec_id, label, vec, c1, c2, slab) of every row, ``vec`` as 64-bit numbers in binary."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = _matrix(batch.column("vec").to_pylist(), book.size)
            points = vecs.astype(float)
            c1, c2 = nearest(points[:, : book.half], book.first), nearest(points[:, book.half :], book.second)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("row", "vec_id", "label")),
                    pa.array([v.tobytes() for v in vecs], pa.binary()),
                    pa.array(c1.astype(np.int32)),
                    pa.array(c2.astype(np.int32)),
                ],
                ["row", "vec_id", "label", "vec", "c1", "c2"],
            )

    placed = rows.mapInArrow(cells, _CELLS)
    pieces = -(-rows.count() // slab)
    placed = placed.repartitionByRange(max(1, pieces), "c1", "c2", "row").withColumn("slab", F.spark_partition_id())
    return written(placed, "mine-slabs")


class Slab:
    """The rows of a slab by cell, then id; and the bounds of both halves."""

    def __init__(self, rows: pa.Table, book: Codebook):
        ids = rows.column("vec_id").fill_null(LONGEST).to_numpy()
        row, c1, c2 = (rows.column(c).to_numpy() for c in ("row", "c1", "c2"))
        order = np.lexsort((row, ids, c2, c1))
        self.ids, self.row, self.label = ids[order], row[order], rows.column("label").to_numpy()[order]
        vecs = np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.int64).reshape(len(row), book.size)[order]
        points = vecs.astype(float)
        self.vecs = vecs.astype(object) if book.wide else points
        self.book = book
        c1, c2 = c1[order], c2[order]
        first = np.flatnonzero(np.concatenate([[True], (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])]))
        end = np.append(first[1:], len(row))
        self.cells = {(int(c1[a]), int(c2[a])): (int(a), int(b)) for a, b in zip(first, end)}
        self.halves = []
        for c, centers, part in ((c1, book.first, points[:, : book.half]), (c2, book.second, points[:, book.half :])):
            names, which = np.unique(c, return_inverse=True)
            far = np.zeros(len(names))
            np.maximum.at(far, which, np.sqrt(((part - centers[c]) ** 2).sum(1)))
            self.halves.append((names, centers[names], far))
        self.longest = float(np.sqrt((points * points).sum(1)).max())

    def visit(self, point: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(upper bound, lower bound, first row, end) of the cells, by falling upper bound."""
        bounds = []
        for (names, centers, far), part in zip(self.halves, (point[: self.book.half], point[self.book.half :])):
            at, reach = centers @ part, far * np.sqrt(part @ part)
            order = np.argsort(-(at + reach), kind="stable")
            bounds.append((names[order].tolist(), (at + reach)[order].tolist(), (at - reach)[order].tolist()))
        (n1, high1, low1), (n2, high2, low2) = bounds
        # Sums are rounded; this is far more than they can be off.
        slack = 1e-9 * self.longest * float(np.sqrt(point @ point)) + 1e-6
        heap = [(-(high1[0] + high2[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(n2):
                heapq.heappush(heap, (-(high1[i] + high2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(n1):
                heapq.heappush(heap, (-(high1[i + 1] + high2[0]), i + 1, 0))
            cell = self.cells.get((n1[i], n2[j]))
            if cell:
                yield -bound + slack, low1[i] + low2[j] - slack, *cell

    def scores(self, anchor: np.ndarray, first: int, end: int) -> np.ndarray:
        return self.vecs[first:end] @ anchor

    def best(self, scores: np.ndarray, first: int, wanted: np.ndarray, k: int) -> list[tuple]:
        """(-score, id, row) of the first k of the ``wanted`` rows, counted from ``first``."""
        at = np.flatnonzero(wanted)
        at = at[np.argsort(-scores[at], kind="stable")[:k]]
        return [(-int(scores[x]), int(self.ids[first + x]), int(self.row[first + x])) for x in at.tolist()]

    def positives(self, anchor: np.ndarray, point: np.ndarray, row: int, label: int, k: int) -> list[tuple]:
        found: list[tuple] = []
        for bound, _, first, end in self.visit(point):
            if len(found) == k and bound < -found[-1][0]:
                break
            own = (self.label[first:end] == label) & (self.row[first:end] != row)
            if own.any():
                s = self.scores(anchor, first, end)
                if len(found) == k:
                    own &= (s >= -found[-1][0]).astype(bool)
                found = sorted(found + self.best(s, first, own, k))[:k]
        return found

    def negatives(self, anchor: np.ndarray, point: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[list]:
        """The first k rows of other labels in each window of scores, both ends included."""
        found: list[list[tuple]] = [[] for _ in windows]
        need = [low for low, _ in windows]
        top = max(high for _, high in windows)
        for bound, lower, first, end in self.visit(point):
            if bound < min(need):
                break
            if lower > top:
                continue
            other = self.label[first:end] != label
            if not other.any():
                continue
            s = self.scores(anchor, first, end)
            other &= ((s >= min(need)) & (s <= top)).astype(bool)
            if not other.any():
                continue
            for w, (_, high) in enumerate(windows):
                inside = other & ((s >= need[w]) & (s <= high)).astype(bool)
                if inside.any():
                    found[w] = sorted(found[w] + self.best(s, first, inside, k))[:k]
                    if len(found[w]) == k:
                        need[w] = max(need[w], -found[w][-1][0])
        return found


def window_of(score: int, least: int = LEAST, most: int = MOST) -> tuple[int, int]:
    """The scores n with least * score <= 100 * n <= most * score."""
    return -(-least * score // 100), most * score // 100


def _search(index: DataFrame, anchors: DataFrame, book: Codebook, fn, names: list[str], block: int) -> DataFrame:
    """The rows of ``fn(slab, anchors)`` for every slab and block of anchors; ``exact`` is text, all else long."""
    kinds = [pa.string() if name == "exact" else pa.int64() for name in names]
    schema = ", ".join(f"{name} {'string' if name == 'exact' else 'long'}" for name in names)
    last, n = index.agg(F.max("slab")).first()[0], anchors.count()
    blocks = max(1, -(-n // block))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(last))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # Columns that both sides take from the index would be sent once; new ones are sent for each.
    renew = [(F.concat(c) if c == "vec" else F.coalesce(c)).alias(c) for c in anchors.columns]
    right = anchors.select(*renew, F.explode(every).alias("slab"))

    def run(rows: pa.Table, some: pa.Table) -> pa.Table:
        out = fn(Slab(rows, book), some) if rows.num_rows and some.num_rows else []
        columns = list(zip(*out)) or [()] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return left.groupBy("slab", "block").cogroup(right.groupBy("slab", "block")).applyInArrow(run, schema)


def hard_negatives(
    rows: DataFrame,
    anchors: str = "vec_id % 50 = 0",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    slab: int = SLAB,
    block: int = ANCHORS,
) -> DataFrame:
    """(anchor_row, anchor_id, positive_row, positive_id, rank, negative_row, negative_id,
    positive_score, negative_score) from (row, vec_id, label, vec).

    ``anchors`` is a condition on vec_id and label. A score is the inner product with the anchor;
    higher scores come first, ties by smaller id, null ids last. An anchor's positives are the first
    ``positives`` other rows of its label, and rows are told apart by ``row``, so a repeated row is another row. Its
    negatives for a positive are the first ``negatives`` rows of another label with
    least * positive_score <= 100 * negative_score <= most * positive_score, ranked from 1. Vectors of
    different lengths agree as far as the shorter goes. Scores beyond a long are written as the
    nearest long. No rows, no anchors or no positives give no rows.
    """
    spark = rows.sparkSession
    book = fit(rows)
    names = "anchor_row long, anchor_id long, positive_row long, positive_id long, rank int, negative_row long"
    if book is None:
        return spark.createDataFrame([], f"{names}, negative_id long, positive_score long, negative_score long")
    index = build_index(rows, book, slab)
    chosen = index.where(anchors).select("row", "vec_id", "label", "vec")

    def each(some: pa.Table):
        """(row, label, exact vector, vector in floats) of every anchor."""
        vecs = np.frombuffer(b"".join(some.column("vec").to_pylist()), np.int64).reshape(some.num_rows, book.size)
        points = vecs.astype(float)
        exact = vecs.astype(object) if book.wide else points
        return zip(some.column("row").to_pylist(), some.column("label").to_pylist(), exact, points)

    def find_positives(cells: Slab, some: pa.Table) -> list[tuple]:
        return [
            (row, found_row, found_id if found_id != LONGEST else None, str(-score))
            for row, label, exact, point in each(some)
            for score, found_id, found_row in cells.positives(exact, point, row, label, positives)
        ]

    number = "cast(exact as decimal(38, 0))"
    wanted = ["anchor_row", "positive_row", "positive_id", "exact"]
    found = _search(index, chosen, book, find_positives, wanted, block)
    order = (F.expr(number).desc(), F.col("positive_id").asc_nulls_last(), "positive_row")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("anchor_row").orderBy(*order)))
    found = written(found.where(F.col("place") <= positives), "mine-positives")

    aims = found.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("place", "exact"))).alias("aims"))
    aimed = chosen.join(aims, chosen["row"] == aims["anchor_row"]).select("row", "label", "vec", "aims")

    def find_negatives(cells: Slab, some: pa.Table) -> list[tuple]:
        out = []
        for (row, label, exact, point), aims in zip(each(some), some.column("aims").to_pylist()):
            windows = [(a["place"], window_of(int(a["exact"]), least, most)) for a in aims]
            windows = [(place, w) for place, w in windows if w[0] <= w[1]]
            lists = cells.negatives(exact, point, label, [w for _, w in windows], negatives) if windows else []
            out += [
                (row, place, found_row, found_id if found_id != LONGEST else None, str(-score))
                for (place, _), few in zip(windows, lists)
                for score, found_id, found_row in few
            ]
        return out

    wanted = ["anchor_row", "place", "negative_row", "negative_id", "exact"]
    against = _search(index, aimed, book, find_negatives, wanted, block)
    order = (F.expr(number).desc(), F.col("negative_id").asc_nulls_last(), "negative_row")
    against = against.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_row", "place").orderBy(*order)))
    against = against.where(F.col("rank") <= negatives).withColumnRenamed("exact", "against")
    as_long = lambda c: F.greatest(F.least(F.col(c).cast("decimal(38,0)"), F.lit(LONGEST)), F.lit(-LONGEST - 1)).cast("long")
    ids = chosen.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return (
        found.join(against, ["anchor_row", "place"])
        .join(ids, "anchor_row")
        .select(
            "anchor_row", "anchor_id", "positive_row", "positive_id", "rank", "negative_row", "negative_id",
            as_long("exact").alias("positive_score"), as_long("against").alias("negative_score"),
        )
    )


def mining_report(embeddings: DataFrame) -> DataFrame:
    """The contract's columns: labels of ids divisible by 7 are moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = whole_numbers(embeddings.select("vec_id", "embedding", moved.alias("label")))
    return hard_negatives(rows).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


ORACLE = """
WITH rows AS (
  SELECT row_number() OVER () AS place, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.place AS anchor, a.vec_id AS anchor_id, b.place, b.vec_id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.place <> b.place WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, place) <= 5
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id,
    p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor, p.place
      ORDER BY n.score DESC, n.vec_id NULLS LAST, n.place) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON p.anchor = n.anchor
  WHERE NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
