"""Periodic runs of words."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm.periodic_runs import kept_words, planted, run_report, runs_of_words, word_runs

from . import brute


def brute_runs(w):
    """Every maximal stretch of every period, the smallest period of each kept."""
    found, n = {}, len(w)
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def check(*documents):
    got = runs_of_words([np.array(d, np.int64) for d in documents])
    assert got == [brute_runs(list(d)) for d in documents]
    return got


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_known_runs():
    assert check([7] * 23, [7] * 24, [1, 2] * 12, [1, 2] * 12 + [1, 3], list(range(8)) * 3, list(range(9)) * 3)[2] == [(0, 24, 2)]
    check(fibonacci(600), fibonacci(25), [], [0], [k // 30 for k in range(300)])
    long = list(range(100))
    for p in (5, 6, 7, 8, 11, 12, 13, 23, 24, 25, 47, 48, 95, 96, 97):
        block = [1000 + k for k in range(p)]
        for times in (2, 3):
            for extra in (0, 1, p // 2):
                tail = (block * (times + 1))[: times * p + extra]
                check(long + tail, tail + long, long[:17] + tail + long, tail[1:] + long + tail)


@pytest.mark.parametrize("seed", range(12))
def test_random_runs(seed):
    draw = random.Random(seed)
    documents = []
    for _ in range(12):
        letters, w = draw.choice([1, 2, 2, 3, 50]), []
        while len(w) < draw.randrange(10, 700):
            p = draw.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 16, 17, 31, 33, 64, 100])
            block = [draw.randrange(letters) for _ in range(p)]
            if draw.random() < 0.4:
                # Periods within periods.
                block = (block[: p // 3 + 1] * 40)[: p * 3] + block
            part = block * draw.randrange(1, 7)
            w += part[draw.randrange(p) : len(part) - draw.randrange(p)]
        documents.append(w)
    check(*documents)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=14), st.integers(1, 30)), max_size=6))
def test_any_runs(parts):
    check([x for block, times in parts for x in block * times])


def test_long_documents_take_linear_time():
    draw = random.Random(1)
    block = [draw.randrange(5000) for _ in range(70_000)]
    words = block * 4 + [1, 2, 3] * 50_000 + [draw.randrange(2) for _ in range(100_000)] + [9] * 100_000
    words += fibonacci(100_000)
    start = time.time()
    found = runs_of_words([np.array(words, np.int64)])[0]
    assert time.time() - start < 60
    assert (0, 280_000, 70_000) in found and any(length >= 150_000 and p == 3 for _, length, p in found)
    assert any(length >= 100_000 and p == 1 for _, length, p in found)


def brute_report(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{size},{p}\n" for s, size, p in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def test_report_like_brute_force(spark):
    draw = random.Random(4)
    texts = [" ".join(draw.choice("abcdefgh") + draw.choice("xyz") for _ in range(draw.randrange(400))) for _ in range(250)]
    texts += ["x " * 30, "a　b \t" * 40 + "\x1c " * 30, "ab\x85cd\n" * 26, "line of words here\r\n" * 9 + "é " * 24, "one " * 23]
    rows = brute.strange(list(enumerate(texts)))
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n_words int, runs string, start int")
    got = Counter(tuple(r) for r in run_report(df.repartition(3)).collect())
    assert got == Counter(brute_report(i, t) for i, t in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(250)) > 10
    assert run_report(df.limit(0)).count() == 0


def test_whole_table_like_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000")
    got = Counter(tuple(r) for r in run_report(docs).collect())
    assert got == Counter(brute_report(r["doc_id"], r["text"]) for r in docs.collect())


def test_spans_and_collapsed_texts(spark):
    df = spark.createDataFrame([(1, "start " + "a b c " * 9 + "end"), (2, "no runs\there"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in word_runs(df).collect()}
    assert got == {1: (29, [(1, 27, 3)], "start a b c end"), 2: (3, [], "no runs here"), 3: (0, [], "")}
    assert planted(df.where("doc_id = 2")).first()["text"] == "no runs\there"
    assert kept_words(6, [(0, 4, 1), (2, 4, 1)]).tolist() == [True, False, False, False, False, False]
