"""Hard negatives from the inverted multi-index."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from palisade.llm import hard_negatives
from palisade.llm.hard_negatives import Codebook, Slab, build_index, fit, k_means, mining_report, nearest, whole_numbers, window_of

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, row string"


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA.replace("double", kind))


def brute(rows):
    """The report by scoring all pairs in whole numbers."""
    fit_rows = []
    for place, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        fit_rows.append((place, i, [math.floor(256 * x) for x in v], label))
    out = Counter()
    key = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    for place, i, v, label in fit_rows:
        if i is None or i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, p, own) for p, j, w, own in fit_rows if p != place]
        for score, j, _, _ in sorted((s for s in scored if s[3] == label), key=key)[:5]:
            inside = [s for s in scored if s[3] != label and 50 * score <= 100 * s[0] <= 95 * score]
            for rank, (other, k, _, _) in enumerate(sorted(inside, key=key)[:3], 1):
                out[i, j, rank, k, score, other] += 1
    return out


def vectors(n, size, seed, spread=1.0):
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(6, size))
    out = []
    for i in range(n):
        v = centers[draw.integers(6)] + spread * draw.normal(size=size)
        out.append((i, [float(x) for x in v], int(draw.integers(10))))
    return out


def got(spark, rows, **options):
    return Counter(tuple(r) for r in mining_report(frame(spark, rows, **options).repartition(3)).collect())


@pytest.mark.parametrize("slab", [40, 8192])
@pytest.mark.parametrize("spread", [0.1, 2.0])
def test_like_brute_force(spark, monkeypatch, slab, spread):
    monkeypatch.setattr(hard_negatives, "PER_CELL", 8)
    monkeypatch.setattr(hard_negatives.hard_negatives, "__defaults__", (*hard_negatives.hard_negatives.__defaults__[:5], slab, 3))
    rows = vectors(400, 9, 3, spread)
    # Ties and repeated rows, also of anchors; nulls of every kind; empty and short vectors.
    rows += [(1000 + k, rows[7][1], k % 3) for k in range(150)] + [rows[50]] * 3 + [(50, rows[50][1], 4)]
    rows += [(None, rows[9][1], 2), (2000, None, 1), (2050, rows[1][1], None), (2100, [1.0, None], 1), (2150, [float("nan")], 1)]
    rows += [(2200, [float("inf")] * 9, 1), (2250, [], 3), (2300, [0.0] * 9, 3), (2350, [1.0, 2.0], 5), (2400, [-5.0] * 9, 6)]
    assert got(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(i, [x * 1e6 for x in v], label) for i, v, label in vectors(160, 5, 8)]
    assert fit(whole_numbers(frame(spark, rows))).wide
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(50, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 2)], [(50, [], 1), (51, [], 1), (52, [], 2)],
                                  [(50, [2.0], 1), (51, [2.0], 1), (52, [1.5], 2), (53, [0.1], 3)]])
def test_small_tables(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_whole_table_like_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(spark, rows, kind="float") == brute(rows)


def test_window():
    for score in range(-30, 300):
        low, high = window_of(score)
        for n in range(-40, 300):
            assert (low <= n <= high) == (50 * score <= 100 * n <= 95 * score)


def test_bounds_hold_and_fall(spark):
    rows = whole_numbers(frame(spark, vectors(300, 8, 5)))
    book = fit(rows)
    slab = Slab(build_index(rows, book).toArrow(), book)
    seen = set()
    point = slab.vecs[17]
    last = math.inf
    for high, low, first, end in slab.visit(point):
        s = slab.scores(point, first, end)
        assert (s <= high).all() and (s >= low).all() and high <= last
        last = high
        seen |= set(range(first, end))
    assert seen == set(range(300))


def test_clustered_vectors_are_searched_in_part(spark):
    rows = whole_numbers(frame(spark, vectors(3000, 8, 6, 0.02)))
    book = Codebook(*(lambda b: (b.first, b.second, b.size, b.wide))(fit(rows)))
    slab = Slab(build_index(rows, book).toArrow(), book)
    scored = []
    slab.scores = lambda anchor, first, end, f=Slab.scores: scored.append(end - first) or f(slab, anchor, first, end)
    found = slab.positives(slab.vecs[0], slab.vecs[0], int(slab.row[0]), int(slab.label[0]), 5)
    assert len(found) == 5 and sum(scored) < 1500


def test_k_means():
    points = np.array([[0.0], [0.1], [9.0], [9.2], [5.0]])
    centers = k_means(points, 3)
    assert sorted(centers.ravel().round(2)) == [0.05, 5.0, 9.1]
    assert nearest(points, centers).tolist()[0] == nearest(points, centers).tolist()[1]
    assert len(k_means(np.zeros((4, 2)), 3)) == 1 and k_means(np.zeros((4, 0)), 3).shape == (1, 0)
