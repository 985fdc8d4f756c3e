"""Periodic runs of words, by string synchronising sets.

A run is a stretch of words in which words ``period`` apart are equal, which no neighbour extends, and
which holds at least ``TIMES`` periods and ``LEAST`` words; ``period`` is its smallest one.

For scale t, a synchronising set holds position i if the least hash of the strings of t words
that start at i to i + t is the one at i or the one at i + t. Strings with a period of at most
t / 3 take no part. Whether i belongs depends only on the 2t words from i on, its context, so
equal stretches hold the same positions. And every t neighbours hold one, unless the 3t - 1 words
from the first of them on have a period of at most t / 3.

Let a run have period q, with 3t/2 <= q < 3t, which holds for one t of 4, 8, 16, ... If none of
its first length - q - 2t + 1 positions were in the set, its first length - q >= 2q words would have
a period of at most t/3, so that q were not the smallest. So it has a position i in the set, and i + q
is there too, with the same context. Hence positions with equal contexts less than 3t
apart propose the distances between them as periods, and every proposal is extended word by word
in both directions. As a context has no period of t / 3 or less, few of its occurrences are that close.

Periods up to ``SMALL`` are found apart, by comparing each word with the one that many words on.
These highly periodic regions, and the runs of smaller scales, are also what a scale has to leave out.

Hashes only choose positions and bring equal contexts together. Equality is decided on words.
All documents of a batch go through one array; different marks part them.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import column, let, small_batches, text_batches
from palisade.llm.repeats import _sliding_least

LEAST = 24
TIMES = 3
# Periods that are found by comparing; the smallest scale.
SMALL = 5
FIRST = 4

WORD = "[^\\x20\\x09-\\x0D]+"
RUNS = "array<struct<start: long, length: long, period: long>>"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xBF58476D1CE4E5B9)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretches of at least ``least`` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
    first, end = edges[0::2], edges[1::2]
    long = end - first >= least
    return first[long], end[long]


def _small_periods(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, end, period) of the maximal stretches with a period up to SMALL that some scale
    must leave out, or that are runs."""
    out = []
    for p in range(1, min(SMALL, words.size - 1) + 1):
        first, end = _stretches(words[p:] == words[:-p], max(3 * p, FIRST) - p)
        out += [(a, b + p, p) for a, b in zip(first.tolist(), end.tolist())]
    return out


def _joined(value: np.ndarray, span: int) -> np.ndarray:
    """Hashes of the strings of 2 * span words, from those of span words."""
    after = value[span:]
    out = (value[: after.size] ^ (value[: after.size] >> np.uint64(31))) * _MIX + after
    return (out ^ (out >> np.uint64(29))) * _TURN


def _proposals(value: np.ndarray, twice: np.ndarray, t: int, periodic: list[tuple[int, int, int]]):
    """(position, period): positions of the synchronising set of scale t whose contexts are equal."""
    ids = value & ~np.uint64(1)
    depth = np.zeros(ids.size + 1, np.int32)
    for first, end, p in periodic:
        if p <= t // 3 and end - first >= t and first < ids.size:
            depth[first] += 1
            depth[min(end - t + 1, ids.size)] -= 1
    ids[np.cumsum(depth[:-1]) > 0] = _NONE
    least = _sliding_least(ids, t + 1)
    n = least.size
    at = np.flatnonzero(((least == ids[:n]) | (least == ids[t : t + n])) & (least != _NONE))
    context = twice[at]
    order = np.argsort(context, kind="stable")
    context, at = context[order], at[order]
    low = max(SMALL + 1, -(-3 * t // 2))
    found_at, found_period = [], []
    for k in count(1):
        near = (context[k:] == context[:-k]) & (at[k:] - at[:-k] < 3 * t) if k < at.size else np.zeros(0, bool)
        if not near.any():
            break
        i, period = at[:-k][near], (at[k:] - at[:-k])[near]
        large = period >= low
        found_at.append(i[large])
        found_period.append(period[large])
    if not found_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found_period)


def _extended(words: np.ndarray, i: int, period: int) -> tuple[int, int]:
    """(first, end) of the positions around i whose words equal those ``period`` on; empty if i's does not."""
    end, step, last = i, 64, words.size - period
    while end < last:
        size = min(step, last - end)
        other = words[end : end + size] != words[end + period : end + period + size]
        k = int(other.argmax())
        if other[k]:
            end += k
            break
        end, step = end + size, min(2 * step, 1 << 16)
    first, step = i, 64
    while first > 0 and end > i:
        size = min(step, first)
        other = (words[first - size : first] != words[first - size + period : first + period])[::-1]
        k = int(other.argmax())
        if other[k]:
            first -= k
            break
        first, step = first - size, min(2 * step, 1 << 16)
    return first, end


def runs_of_words(documents: list[np.ndarray], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of every document, by start, then period.

    A document is an array of numbers from 0 on, equal for equal words. A document of fewer than ``least``
    words has no runs; ``least`` is 24 or more.
    """
    if least < LEAST:
        raise ValueError("shorter runs would be missed by the smallest scale")
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    # Longest first: what is long enough for a scale is the beginning of the array.
    long = sorted((k for k, d in enumerate(documents) if d.size >= least), key=lambda k: -documents[k].size)
    if not long:
        return out
    sizes = np.array([documents[k].size for k in long])
    parts = [x for mark, k in enumerate(long, 1) for x in (documents[k], np.array([-mark], np.int64))]
    words = np.concatenate(parts)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    periodic = _small_periods(words)
    value, t = words.astype(np.uint64) * _MIX, 1
    value = (value ^ (value >> np.uint64(32))) * _TURN
    while t < FIRST:
        value, t = _joined(value, t), 2 * t
    # A run of this scale has at least 9t/2 words.
    while (n := int(begins[np.count_nonzero(2 * sizes >= 9 * t)])) >= least:
        value = value[: n - t + 1]
        twice = _joined(value, t)
        at, period = _proposals(value, twice, t, periodic)
        order = np.lexsort((at, period))
        before, covered = -1, -1
        for i, q in zip(at[order].tolist(), period[order].tolist()):
            if q == before and i < covered:
                continue
            first, end = _extended(words, i, q)
            before, covered = q, end
            if end > i and end + q - first >= max(least, TIMES * q):
                periodic.append((first, end + q, q))
        value, t = twice, 2 * t
    best: dict[tuple[int, int], int] = {}
    for first, end, q in periodic:
        if end - first >= max(least, TIMES * q) and q <= best.get((first, end), q):
            best[first, end] = q
    for (first, end), q in sorted(best.items(), key=lambda x: (x[0][0], x[1])):
        k = int(np.searchsorted(begins, first, side="right")) - 1
        out[long[k]].append((first - int(begins[k]), end - first, q))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those in no run, or in no run after its first period."""
    depth = np.zeros(n + 1, np.int32)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def _numbers(texts: list[list[bytes]]) -> list[np.ndarray]:
    number: dict[bytes, int] = defaultdict(count().__next__)
    return [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in texts]


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document.

    Words are what stands between white space (space, tab to carriage return). ``runs`` are (start, length,
    period) in words, by start, then period. ``collapsed`` is the text without the words
    that a run repeats after its first period, the others joined by one space. A null or empty text
    has no words and no runs. Null and repeated ids are no matter, repeated rows are judged
    each for itself, an empty table gives none, and columns of other names are not read. One
    task holds a text whole, and about 80 bytes a word beside it.
    """
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [(text or "").encode().split() for text in batch.column("text").to_pylist()]
        found = runs_of_words(_numbers(words), least)
        collapsed = []
        for w, runs in zip(words, found):
            if runs:
                w = [w[i] for i in np.flatnonzero(kept_words(len(w), runs)).tolist()]
            collapsed.append(b" ".join(w).decode())
        names = ("start", "length", "period")
        kind = pa.list_(pa.struct([(name, pa.int64()) for name in names]))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([[dict(zip(names, r)) for r in runs] for runs in found], kind),
                pa.array(collapsed, pa.string()),
            ],
            ["doc_id", "n_words", "runs", "collapsed"],
        )

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(text_batches(run), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the contract's periods: where crc32(doc_id) is a multiple of 10, a text
    goes on from word a as the p words from there on, again and again. No id, no change."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))

        def of(bounds: Column) -> Column:
            place = lambda i: F.when(i < bounds["a"], i).otherwise(
                bounds["a"] + F.pmod(i - bounds["a"], bounds["p"])
            )
            numbers = F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))
            return F.array_join(F.transform(numbers, lambda i: F.get(words, place(i).cast("int"))), " ")

        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), of)).otherwise("")

    text = F.col("text")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    changed = F.when(F.pmod(h, F.lit(10)) == 0, let(words, again)).otherwise(text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).select(
        "doc_id", changed.alias("text")
    )


def run_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for all documents: the longest run by exponent, and digests of all
    runs and of the collapsed text."""
    found = word_runs(planted(docs))
    runs = F.col("runs")
    # Compared as fractions; runs come by start and period, so the first of equals is kept.
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate(
        runs,
        none,
        lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b),
    )
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
