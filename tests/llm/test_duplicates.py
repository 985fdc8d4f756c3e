"""Repeated strings, near-duplicates and components."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from palisade.llm.common import components
from palisade.llm.near_duplicates import _agreeing, jaccard, near_classes, near_report, keep_one, shingles, signature
from palisade.llm.repeats import anchors, bytes_of, merged_lists, passages_of, remove_repeats, repeat_report, without, without_words

from . import brute


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)]
    edges += [(100, 100 + k) for k in range(40)] + [(200 + k, 201 + k) for k in range(30)] + [(7, 7), (300, 300)]
    found = {r["node"]: r["root"] for r in components(
        spark, spark.createDataFrame([*edges, (None, 1), (5, None)], "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert found == {x: find(x) for x in root}
    assert components(spark, spark.createDataFrame([], "u string, v string")).count() == 0


def texts_with_repeats():
    draw = random.Random(5)
    base = "".join(draw.choice("abcdefghij \n") for _ in range(6000))
    texts = ["", "short", "a" * 1500, "ab" * 700, base[:2000], base[:2000], base[100:1900] + "é" * 300]
    texts += [base[500:899], base[500:900], "x" + base[3000:3401] + "y" + base[3000:3400]]
    texts += [base[1000:1700] + base[4000:4399] + base[2500:3100]]
    for _ in range(30):
        at = draw.randrange(4500)
        t = list(base[at : at + draw.randrange(300, 1500)])
        for _ in range(draw.randrange(4)):
            t[draw.randrange(len(t))] = draw.choice("XYZé")
        texts.append("".join(t))
    return texts


def test_repeats_like_brute_force(spark):
    rows = brute.strange(list(enumerate(texts_with_repeats())))
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, h int, spans string")
    got = Counter(tuple(r) for r in repeat_report(df.repartition(3)).collect())
    passages = [(len(runs), sum(b - a for a, b in runs)) for runs in brute.passages(rows, 51)]
    want = Counter((i, *b, *p) for (i, _), b, p in zip(rows, brute.repeats([t for _, t in rows], 400), passages))
    assert got == want


def texts_with_passages():
    draw = random.Random(8)
    base = [draw.choice(["a", "bb", "ccc", "é", "d."]) for _ in range(900)]
    texts = ["", " \t\n", "one two", " ".join(base[:51]), " ".join(base[1:51]), "x " + "\n".join(base[:52]) + " y"]
    texts += ["same words " * 60, "a " * 300, "a " * 50, " ".join(base[400:600] * 2), "\x0b".join(base[100:180]) + "　z"]
    texts += [" ".join(base[200:260]) + " q " + " ".join(base[300:355]), " ".join(base[230:320])]
    for _ in range(40):
        at = draw.randrange(800)
        t = base[at : at + draw.randrange(40, 160)]
        for _ in range(draw.randrange(3)):
            t[draw.randrange(len(t))] = draw.choice("XYZ")
        texts.append(draw.choice([" ", "  ", "\n "]).join(t) + draw.choice(["", " "]))
    return texts


@pytest.mark.parametrize("words", [51, 20])
def test_passages_like_brute_force(spark, words):
    rows = brute.strange(list(enumerate(texts_with_passages()))) + [(700, texts_with_passages()[3]), (3, "another text " * 20)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, passage_words int")
    got = Counter(tuple(r)[0:1] + tuple(r)[5:] for r in repeat_report(df.repartition(3), words=words).collect())
    want = Counter((i, len(runs), sum(b - a for a, b in runs)) for (i, _), runs in zip(rows, brute.passages(rows, words)))
    assert got == want and sum(n > 0 for _, n, _ in want) > 20


def test_passages_are_cut_out_of_documents(spark):
    rows = list(enumerate(texts_with_passages()))
    df = spark.createDataFrame([(i, t, 5, "z", 1) for i, t in rows], "doc_id long, text string, n_chars long, spans string, h long")
    got = {r["doc_id"]: r for r in remove_repeats(df, passages_of()).collect()}
    for (i, t), runs in zip(rows, brute.passages(rows, 51)):
        gone = {k for a, b in runs for k in range(a, b)}
        assert got[i]["text"].encode().split() == [w for k, w in enumerate(t.encode().split()) if k not in gone]
        assert got[i]["n_chars"] == (len(got[i]["text"]) if runs else 5) and (got[i]["spans"], got[i]["h"]) == ("z", 1)
        assert runs or got[i]["text"] == t


def test_words_are_cut_with_their_gaps():
    text = b"  one two\n\nthree four "
    assert without_words(text, [(1, 2)]) == b"  one\n\nthree four "
    assert without_words(text, [(0, 1), (3, 4)]) == b"two\n\nthree "
    assert without_words(text, [(0, 4)]) == b"" and without_words(text, []) == text


def test_repeats_are_cut_out_of_documents(spark):
    draw = random.Random(6)
    shared = "".join(draw.choice("abcdefg é") for _ in range(500))
    own = ["".join(draw.choice("hijklmn ") for _ in range(300)) for _ in range(3)]
    rows = [(1, own[0] + shared, 5), (2, shared + own[1], 5), (3, own[2], 5), (4, None, None), (None, shared[:100], 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in remove_repeats(df).collect()}
    assert got == {1: (own[0], 300), 2: (own[1], 300), 3: (own[2], 5), 4: (None, None), None: (shared[:100], 7)}
    assert remove_repeats(df.limit(0)).count() == 0 and repeat_report(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [0, 399, 400, 401, 5000])
def test_every_window_has_one_anchor(size, monkeypatch):
    monkeypatch.setattr("palisade.llm.repeats.CHUNK", 700)
    data = bytes(random.Random(size).choices(b"abc", k=size))
    texts = [b"ab" * 150, data, b"", b"c" * 400, data[:401], data[7:]]
    cut = [bytes_of().cut(t.decode())[1] for t in texts]
    found = list(anchors(np.concatenate(cut), np.array([c.size for c in cut])))
    for doc, text in enumerate(texts):
        starts = sorted(s for d, a, lo, hi in found for k in range(a.size) if d[k] == doc for s in range(a[k] - hi[k], a[k] - lo[k] + 1))
        assert starts == list(range(max(0, len(text) - 399)))
    for _, a, lo, hi in found:
        assert (lo >= 0).all() and (hi <= 384).all()


def test_runs():
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    lists = [[(5, 9), (0, 3), (3, 4), (6, 7)], None, [], [(9, 10)], [(0, 1), (2, 3)], [(0, 1), (1, 3)], [(4, 6)] * 3]
    rows = [None if x is None else [{"start": a, "end": b} for a, b in x] for x in lists]
    got = merged_lists(pa.array(rows, kind))
    assert got == [[(0, 4), (5, 9)], [], [], [(9, 10)], [(0, 1), (2, 3)], [(0, 3)], [(4, 6)]]
    assert merged_lists(pa.array(rows, kind).slice(3, 2)) == got[3:5] and merged_lists(pa.array([None], kind)) == [[]]
    assert without(b"0123456789", got[0]) == b"49" and without(b"", []) == b""


def near_texts():
    draw = random.Random(8)
    word = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(1, 6))) for _ in range(400)]
    texts = []
    for _ in range(12):
        base = draw.choices(word, k=draw.choice([6, 60, 200, 700]))
        texts.append(" ".join(base))
        for _ in range(draw.randrange(6)):
            t = list(base)
            for _ in range(draw.randrange(1 + len(t) // 30)):
                t[draw.randrange(len(t))] = draw.choice(word)
            texts.append(" ".join(t))
    # A chain: each is similar to the next only.
    base = draw.choices(word, k=300)
    for k in range(6):
        texts.append(" ".join([*base[:10], *draw.choices(word, k=0), *base[k * 15 : k * 15 + 200]]))
    return [*texts, "one two", "one two", "one  two", "one", "", " "]


def test_near_classes_like_brute_force(spark, tmp_path):
    rows = brute.strange(list(enumerate(near_texts())))
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, root string").repartition(
        3
    ).write.parquet(path)
    docs = spark.read.parquet(path)
    got = near_classes(docs).join(docs.selectExpr("doc_id AS d", "text AS t", "monotonically_increasing_id() AS rid"), "rid")
    found = got.collect()
    assert len(found) == len(rows)
    number = dict(zip([t or "" for _, t in rows], brute.near_groups([t for _, t in rows])))
    ours, theirs = defaultdict(list), defaultdict(list)
    for r in found:
        theirs[number[r["t"] or ""]].append(r)
    for group in theirs.values():
        ids = [r["doc_id"] for r in group if r["doc_id"] is not None]
        assert {r["class_id"] for r in group} == {min(ids) if ids else None}
        assert {r["class_size"] for r in group} == {len(group)}
        assert sum(r["kept"] for r in group) == 1
        ours[group[0]["class_id"], len(ours) if not ids else 0].append(group)
    assert all(len(x) == 1 for x in ours.values())
    kept = keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(theirs)


@pytest.mark.parametrize("block", [256, 20])
def test_all_pairs_of_crowded_buckets_are_compared(spark, tmp_path, monkeypatch, block):
    """Hundreds of texts of one boilerplate, less than similar, but for two of little else."""
    monkeypatch.setattr("palisade.llm.near_duplicates.BLOCK", block)
    draw = random.Random(9)
    word = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    base = draw.choices(word, k=204)
    texts = [" ".join(base + draw.choices(word, k=24 if i in (123, 234) else 40)) for i in range(500)]
    number = brute.near_groups(texts)
    assert len(set(number)) == 499 and number[123] == number[234]
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    got = {r["doc_id"]: r["class_id"] for r in near_report(spark.read.parquet(path)).collect()}
    assert got == {i: 123 if i == 234 else i for i in range(500)}


def test_all_agreeing_pairs_are_verified(spark):
    """However many others of a text agree better."""
    sigs = [(b"u", bytes(125)), *((b"%d" % k, bytes([1] * (k * 5) + [0] * (125 - k * 5))) for k in range(14))]
    texts = spark.createDataFrame(sigs, "key binary, sig binary")
    pairs = spark.createDataFrame([(b"u", b"%d" % k) for k in range(14)], "u binary, v binary")
    got = {bytes(r["v"]) for r in _agreeing(pairs, texts).collect()}
    assert got == {b"%d" % k for k in range(12)}


def test_lines_repeated_in_one_of_two_texts(spark, tmp_path):
    """They count once in similarity, so they must not keep texts apart before."""
    draw = random.Random(10)
    word = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    texts = []
    for _ in range(40):
        body = " ".join(draw.choices(word, k=100))
        texts += [body, body + "\n" + "\n".join([" ".join(draw.choices(word, k=12))] * 200)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    assert len(set(brute.near_groups(texts))) == 40
    got = {r["doc_id"]: r["class_id"] for r in near_report(spark.read.parquet(path)).collect()}
    assert got == {i: i // 2 * 2 for i in range(80)}


def test_near_classes_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert near_report(spark.read.parquet(path)).count() == 0


def test_signatures_estimate_probability_jaccard():
    draw = np.random.default_rng(4)
    items = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
    a, b = draw.integers(1, 6, 300).astype(float), draw.integers(1, 6, 300).astype(float)
    a[:60], b[-60:] = 0, 0
    exact = sum(
        1 / sum(max(x / a[d], y / b[d]) for x, y in zip(a, b)) for d in range(300) if a[d] > 0 and b[d] > 0
    )
    one = signature(items[a > 0], a[a > 0], 4000)
    two = signature(items[b > 0], b[b > 0], 4000)
    assert abs((one == two).mean() - exact) < 0.03
    assert (one == signature(items[a > 0][::-1], a[a > 0][::-1], 4000)).all()


def test_shingles():
    assert shingles(None).size == shingles(" \n").size == 0
    assert shingles("a b").size == 1 and shingles("a b c d e f").size == 2
    assert shingles("a b") != shingles("a b c")
    assert (shingles("a b c d e f") == shingles(" a\tb  c\nd e f ")).all()
    assert jaccard(np.array([1, 2, 3]), np.array([2, 3, 4])) == 0.5
