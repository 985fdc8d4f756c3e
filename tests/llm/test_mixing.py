"""The low-discrepancy mix of sources."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from palisade.llm.mixing import laid_out, mix_report, mixed_texts, mixture, numbered, schedule, targets
from palisade.session import written

from . import brute

WEIGHTS = (5, 2, 1)


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def some_rows():
    draw = random.Random(13)
    rows = [(i, "w " * draw.randrange(60), draw.choice(["a", "b", "b", "b", "é", None, "tiny"] if i < 120 else ["a"]))
            for i in range(200)]
    rows += [(500, "tail " * 9000, "b"), (501, "\x1c x　y \t\n", "tiny"), (502, "", "no words"), (503, None, "no words")]
    rows += [(i, t, "strange") for i, t in brute.strange(rows_of_ids(rows))]
    rows += [(77, "same row", "c")] * 300
    return rows


def rows_of_ids(rows):
    return [(i, t) for i, t, _ in rows[:3]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, size int, taken string")


def brute_targets(sizes):
    """Exact shares: those above their limit are stopped and the rest shared again until none is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, out, open_ = Fraction(3 * sum(sizes.values()), 2), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def brute_mix(rows):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words_of(t))
    aims, out = brute_targets(sizes), []
    by_source = defaultdict(list)
    for i, t, s in rows:
        key = None if i is None else hashlib.md5(f"mix:{i}".encode()).hexdigest()[:16]
        by_source[s].append(((key is not None, key or "", i or 0, len(words_of(t))), i, len(words_of(t))))
    for s, docs in by_source.items():
        words, at = math.floor(aims[s] + Fraction(1, 2)), 0
        for _, i, n in sorted(docs, key=lambda d: d[0]):
            taken = sum(max(0, min(at + lap + n, words) - at - lap) for lap in (0, sizes[s]))
            out.append((i, n, sizes[s], round(float(aims[s]), 6), taken))
            at += n
    return Counter(out)


def test_mix_like_brute_force(spark):
    rows = some_rows()
    for order in (rows, rows[::-1]):
        got = mix_report(frame(spark, order).repartition(3)).collect()
        assert Counter((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in got) == brute_mix(rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mix_report(frame(spark, rows[:0])).count() == 0


@pytest.mark.parametrize("rows", [[(1, None, None)], [(1, "one", "a")], [(1, "", "a"), (2, "x y", "b")]])
def test_smallest_mixes(spark, rows):
    assert Counter(tuple(r) for r in mix_report(frame(spark, rows)).collect()) == brute_mix(rows)


def test_schedule_spreads_every_source_evenly(spark):
    sizes = {"a": 500_000, "b": 90_000, "c": 200_000, "d": 3, "e": 0}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    sources = written(targets(rows), "t-sources")
    plan = schedule(sources, 64).collect()
    words = {r["number"]: r["words"] for r in sources.collect()}
    order = [r["number"] for r in sorted(plan, key=lambda r: r["slot"])]
    assert sorted(r["slot"] for r in plan) == list(range(len(plan)))
    assert set(order) == {n for n, w in words.items() if w}
    in_all, seen = sum(words.values()), Counter()
    for k, n in enumerate(order, 1):
        seen[n] += 1
        for m, w in words.items():
            assert abs(seen[m] - k * w / in_all) <= math.log2(k + 1) + 2
    for n in set(order):
        mine = sorted((r["slot"], r["rank"], r["slots"]) for r in plan if r["number"] == n)
        assert [r for _, r, _ in mine] == list(range(len(mine))) and {c for *_, c in mine} == {len(mine)}


def test_slots_hold_equal_blocks_of_whole_laps(spark):
    rows = numbered(frame(spark, some_rows()).repartition(4))
    sources = written(targets(rows), "t-sources")
    mix = mixture(rows, sources, 128).collect()
    starts = {r["row"]: (r["source"], r["start"], r["size"]) for r in laid_out(rows).collect()}
    by_slot = defaultdict(list)
    for r in mix:
        by_slot[r["slot"]].append(r)
    for pieces in by_slot.values():
        assert len({p["source"] for p in pieces}) == 1
        at = 0
        for p in sorted(pieces, key=lambda p: p["place"]):
            assert p["place"] == at and 0 <= p["begin"] < p["end"] <= starts[p["row"]][2]
            at += p["end"] - p["begin"]
    for s in sources.collect():
        mine = [k for k in sorted(by_slot) if by_slot[k][0]["source"] == s["source"]]
        lengths = [sum(p["end"] - p["begin"] for p in by_slot[k]) for k in mine]
        assert sum(lengths) == s["words"] and len(set(lengths[:-1])) <= 1
        # The blocks of a source, in order of its slots, run through its documents.
        where = [starts[p["row"]][1] + p["begin"] for k in mine for p in sorted(by_slot[k], key=lambda p: p["place"])]
        steps = [b - a for a, b in zip(where, where[1:])]
        assert sum(x < 0 for x in steps) <= 1


def test_texts_of_the_mix(spark):
    docs = frame(spark, some_rows())
    got = mixed_texts(docs, 100).collect()
    taken = Counter()
    for r in got:
        taken[r["source"]] += len(words_of(r["text"]))
    want = Counter()
    for (_, n, size, target, t), k in brute_mix(some_rows()).items():
        want[size] += t * k
    assert sorted(taken.values()) == sorted(v for v in want.values() if v)
    whole = {i: words_of(t) for i, t, _ in some_rows()}
    big = sorted((r["slot"], r["place"], r["text"]) for r in got if r["doc_id"] == 500)
    assert sum(len(words_of(t)) for *_, t in big) >= len(whole[500]) and len(big) >= 90
