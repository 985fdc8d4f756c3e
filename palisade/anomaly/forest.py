"""Isolation forest (Liu, Ting and Zhou 2008).

Each tree sees a few hundred rows, so the whole training sample has a size fixed
by the parameters. Trees grow in parallel, one group each; the forest is a node
table that scoring tasks walk with array operations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.anomaly.prep import sample_rows

NODE_DDL = (
    "tree INT, node INT, feature INT, cut DOUBLE, left_node INT, right_node INT, path DOUBLE"
)
EULER = 0.5772156649


def expected_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


@dataclass
class Forest:
    """A trained forest; ``cut`` is the score above which a row is an anomaly."""

    features: list[str]
    nodes: pd.DataFrame
    sample_size: int
    cut: float | None = None


def _grow(features: Sequence[str], seed: int):
    names = list(features)

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        values = rows.sort_values("__rank")[names].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        limit = int(np.ceil(np.log2(max(len(values), 2))))
        out = []
        todo = [(0, values, 0)]
        next_id = 1
        while todo:
            node, part, depth = todo.pop()
            spread = part.max(axis=0) - part.min(axis=0)
            useful = np.flatnonzero(spread > 0)
            if depth >= limit or len(part) <= 1 or len(useful) == 0:
                out.append((tree, node, -1, 0.0, -1, -1, depth + expected_path(len(part))))
                continue
            feature = int(rng.choice(useful))
            low, high = part[:, feature].min(), part[:, feature].max()
            cut = float(rng.uniform(low, high))
            goes_left = part[:, feature] <= cut
            out.append((tree, node, feature, cut, next_id, next_id + 1, 0.0))
            todo.append((next_id, part[goes_left], depth + 1))
            todo.append((next_id + 1, part[~goes_left], depth + 1))
            next_id += 2
        columns = ["tree", "node", "feature", "cut", "left_node", "right_node", "path"]
        return pd.DataFrame(out, columns=columns)

    return grow


def train_forest(
    df: DataFrame,
    features: Sequence[str],
    row_id: str,
    n_estimators: int = 100,
    sample_size: int = 256,
    contamination: float | None = 0.1,
    seed: int = 42,
) -> Forest:
    """Grow the trees on disjoint samples and find the contamination cut."""
    pool_size = n_estimators * sample_size
    total = df.count()
    if total == 0:
        raise ValueError("no training rows")
    # A row with a low id hash is in the sample; its place in that order picks the
    # tree. With fewer rows than places, rows serve several trees.
    pool = sample_rows(
        df.select(row_id, *[F.col(c).cast("double").alias(c) for c in features]), row_id, pool_size
    )
    if total >= pool_size:
        trees = F.array(F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(n_estimators)).cast("int"))
    else:
        copies = max(1, min(n_estimators, -(-pool_size // total)))
        trees = F.transform(
            F.sequence(F.lit(0), F.lit(copies - 1)),
            lambda i: F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)) + i, F.lit(n_estimators)).cast(
                "int"
            ),
        )
    placed = pool.withColumn("__tree", F.explode(trees)).withColumn(
        "__rank", F.xxhash64(row_id, "__tree")
    )
    nodes = (
        placed.groupBy("__tree").applyInPandas(_grow(features, seed), NODE_DDL).toPandas()
    )  # at most n_estimators * 2 * sample_size rows
    forest = Forest(list(features), nodes, min(sample_size, total))
    if contamination is not None:
        forest.cut = score_forest(df.select(row_id, *features), forest).agg(
            F.percentile_approx("score", 1 - contamination, 10_000)
        ).first()[0]
    return forest


def _heap(nodes: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(levels, feature, cut, path) of a tree as a full one, the children of place i at 2 i + 1 and 2 i + 2.

    Below a leaf both ways lead to its path. Trees are as deep as the logarithm of their sample, so a full one is no larger
    than a few times the sample.
    """
    feature, cut, left, right, path = (nodes[c].to_numpy() for c in ("feature", "cut", "left_node", "right_node", "path"))
    at = dict(zip(nodes["node"].tolist(), range(len(nodes))))
    now, rows = np.array([at[0]]), []
    while (feature[now] >= 0).any():
        rows.append(now)
        inner = feature[now] >= 0
        # A leaf is its own child.
        children = [[at[side[n]] if go else n for n, go in zip(now.tolist(), inner.tolist())] for side in (left, right)]
        now = np.array(children).T.reshape(-1)
    inner = np.concatenate([*rows, now[:0]])
    return len(rows), np.maximum(feature[inner], 0).astype(np.int64), cut[inner].astype(float), path[now].astype(float)


# Rows that are walked at once, so that what belongs to them stays near the processor.
BLOCK = 4096


def _walker(forest: Forest):
    nodes = forest.nodes.sort_values(["tree", "node"])
    trees = [_heap(t) for _, t in nodes.groupby("tree")]
    scale = max(expected_path(forest.sample_size), 1e-12)

    def walked(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        cells, begin = x.reshape(-1), np.arange(len(x)) * x.shape[1]
        for levels, feature, cut, path in trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(levels):
                left = cells.take(feature.take(at) + begin) <= cut.take(at)
                at *= 2
                at += 2
                at -= left
            total += path.take(at - ((1 << levels) - 1))
        return 2.0 ** (-(total / len(trees)) / scale)

    def score(x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        # Rows with the same values have the same score.
        x = np.ascontiguousarray(x, dtype=float)
        _, first, which = np.unique(x.view(f"V{x.shape[1] * x.itemsize}").reshape(-1), return_index=True, return_inverse=True)
        x = x[first]
        return np.concatenate([walked(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)])[which.reshape(-1)]

    return score


def score_forest(df: DataFrame, forest: Forest) -> DataFrame:
    """Add ``score`` in [0, 1] (1 is the most anomalous), and ``is_anomaly`` if a
    cut is known."""
    names = list(forest.features)
    shared = df.sparkSession.sparkContext.broadcast(forest)  # size set by the parameters

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _walker(shared.value)
        for rows in batches:
            rows = rows.copy()
            rows["score"] = score(rows[names].to_numpy(dtype=float))
            yield rows

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    out = df.mapInPandas(add, f"{ddl}, score DOUBLE")
    if forest.cut is None:
        return out
    return out.withColumn("is_anomaly", (F.col("score") > F.lit(forest.cut)).cast("int"))
