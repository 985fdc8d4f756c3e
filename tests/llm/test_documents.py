"""Quality rules, ranking, shards, decontamination, addresses, pages and the pipeline."""

import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from palisade.llm import decontamination, quality_rules, ranking
from palisade.llm.decontamination import common_weight, leak_report, leaks, make_block, without_leaks
from palisade.llm.line_blocks import between_surge_and_dive, extract, main_text, page_lines
from palisade.llm.queries import ORACLES, QUERIES
from palisade.llm.sharding import contiguous_shards, row_sizes, shard_report, write_shards
from palisade.llm.url_equivalence import judge

from . import brute

SMALL = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


# Quality rules

LINES = "the cat sat on the mat\n\n \nthe cat sat on the mat\nthe cat sat on\r\nthe cat sat on"


def test_counts_like_brute_force(spark):
    texts = ["", " \n", "one", "a b c a b c a b", LINES, "x # y$$ <z> 5% & | *", "a\x1cb c\x0bd e", "é É ß " * 40,
             "to be or not to be " * 30, "wörter und Wörter\n" * 3]
    rows = brute.strange(list(enumerate(texts)))
    rows = [(i, t, "en", 1, "x") for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, w string")
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
    got = sorted(((r["doc_id"], *(r[n] for n in names)) for r in quality_rules.judge(df).collect()), key=str)
    assert got == sorted(((r[0], *brute.counted(r[1])) for r in rows), key=str)


def test_base_and_kept(spark):
    clean = table(spark, "documents").where("lang = 'en' and length(text) > 1500").limit(40).collect()
    junk = " ".join(f"w{k}###" for k in range(90))
    rows = [(r["doc_id"], r["text"], "en") for r in clean]
    rows += [(9001, junk, "en"), (9002, junk, None), (9003, junk, "xx"), (9004, "same words " * 60, "en"), (9005, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.judge(df).collect()}
    assert got[9001] == (False, False)
    # Without a language there is no reference to be far from.
    assert got[9002] == got[9003] == (False, True)
    assert got[9004] == got[9005] == (True, False)
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_distance(spark):
    from pyspark.sql import functions as F

    def d(p, q):
        row = spark.range(1).select(quality_rules.distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d"))
        return row.first()["d"]

    assert d([0.5, 0.5], [0.5, 0.5]) == 0 and d([1.0, 0.0], [0.0, 1.0]) == 1
    assert abs(d([0.7, 0.3], [0.4, 0.6]) - 0.2573) < 1e-3


# Ranking


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = ranking.score(docs, ranking.learn(docs, labels))
    got = rows.join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r["quality"] == r["predicted"] for r in got]) > 0.97
    for r in rows.take(50):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_ranking_learns_from_all_labels(spark, monkeypatch):
    """Blocks, rare labels and the exact threshold; every label counts."""
    monkeypatch.setattr(ranking, "BLOCK", 50)
    monkeypatch.setattr(ranking, "FEW", 30)
    draw = np.random.default_rng(3)
    x = draw.normal(size=(700, len(ranking.NAMES)))
    good = x[:, 2] + draw.normal(size=700) > 2.5
    assert 10 < good.sum() < 40
    rows = spark.createDataFrame([(i, bool(g), v.tolist()) for i, (g, v) in enumerate(zip(good, x))], "doc_id long, good boolean, x array<double>")
    packed = ranking._blocks(rows, int(good.sum()), int((~good).sum())).collect()
    one = 8 * len(ranking.NAMES)
    assert len(packed) == 14 and all(r["good"] and r["bad"] for r in packed)
    held = {r["bad"][i : i + one] for r in packed for i in range(0, len(r["bad"]), one)} | {r["good"][i : i + one] for r in packed for i in range(0, len(r["good"]), one)}
    assert held == {v.tobytes() for v in x}
    i, k = ranking._comparisons(x[:7], x[:40], 3)
    assert set(i) == set(range(7)) and sorted(k) == sorted([*range(40)] * 3)
    model = ranking.fit(rows)
    strength = np.sort(x @ model.weights)
    n = int((~good).sum())
    assert abs(model.threshold - (strength[n - 1] + strength[n]) / 2) < 1e-9 and np.abs(model.weights).argmax() == 2
    few = spark.createDataFrame([(float(i % 3),) for i in range(90)], "s double")
    assert [ranking._between(few, k, 90) for k in (29, 30, 31, 60)] == [0.0, 0.5, 1.0, 1.5]


def test_ranking_of_difficult_tables(spark):
    rows = brute.strange([(1, "A clean text of words."), (2, "x### y###")])
    docs = spark.createDataFrame([(i, t, 1.0, "z") for i, t in rows], "doc_id long, text string, score double, x string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    for some in (labels, labels.where("quality = 1"), labels.limit(0)):
        model = ranking.learn(docs, some)
        got = ranking.score(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert all(r["score"] == 0.5 for r in got)  # no labels, nothing to prefer
    assert ranking.keep_good(docs, model).columns == docs.columns
    assert ranking.score(docs.limit(0), model).count() == 0


def test_labels_of_the_held_out_are_not_used(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    from pyspark.sql import functions as F

    held = ranking.remainder(F.col("doc_id")) == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ranking.learn(docs, labels), ranking.learn(docs, turned)
    assert (a.weights == b.weights).all() and a.threshold == b.threshold


def test_features_do_not_depend_on_the_cut(monkeypatch):
    text = "some words here and there, more!! # of | them \n" * 300
    whole = ranking.features(text)
    monkeypatch.setattr("palisade.llm.pieces.parts.__defaults__", (200,))
    assert np.allclose(ranking.features(text), whole)


# Shards


def test_shards_like_brute_force(spark):
    draw = random.Random(4)
    rows = brute.strange([(draw.randrange(200), "é" * draw.randrange(80)) for _ in range(300)])
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, size int, shard int")
    got = sorted(shard_report(df.repartition(4)).collect(), key=lambda r: r["byte_start"])
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    start, slots, last = 0, {}, None
    left = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    for r in got:
        left.remove((r["doc_id"], r["size"], r["text_crc32"]))
        key = (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"])
        assert last is None or last <= key
        last = key
        assert r["byte_start"] == start and r["shard"] == start * 16 // total
        assert r["slot"] == slots.setdefault(r["shard"], 0) and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]] += 1
        start += r["size"]
    assert not left and start == total and set(slots) == set(range(16))


def test_shards_of_one_hot_row_and_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([(7, "same")] * 200 + [(8, "x" * 50)], "doc_id long, text string")
    sizes = [r["s"] for r in contiguous_shards(row_sizes(df), 4).groupBy("shard").agg({"size": "sum"}).toDF("k", "s").collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) < 60
    assert shard_report(df.limit(0)).count() == 0
    write_shards(df.distinct(), str(tmp_path / "s"), 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    # Equal rows go where the report has them, not all where the first lies.
    same = spark.createDataFrame([(1, "one text", 7, "x.y")] * 40 + [(None, None, 8, None)], "doc_id long, text string, tie int, `doc.x` string")
    write_shards(same, str(tmp_path / "t"), 4)
    stored = spark.read.parquet(str(tmp_path / "t"))
    want = contiguous_shards(row_sizes(same), 4).groupBy("shard").count()
    assert sorted(map(tuple, stored.groupBy("shard").count().collect())) == sorted(map(tuple, want.collect()))
    assert set(same.columns) < set(stored.columns) and stored.where("`doc.x` = 'x.y' and tie = 7").count() == 40


# Benchmark passages


def test_leaks(spark):
    docs, bench = table(spark, "documents"), table(spark, "benchmark")
    items = [(r["item_id"], r["text"]) for r in bench.collect() if len(r["text"].split()) >= 25][:20]
    clean = [r["text"] for r in docs.where("length(text) between 800 and 4000").limit(60).collect()]
    clean = [t for t in clean if not any(x[:60] in t for _, x in items)]
    draw = random.Random(1)
    words = " ".join(clean).split()
    rows, planted = [], set()
    for k, (i, x) in enumerate(items):
        w = x.split()
        if k % 2:  # a paraphrase: some words replaced, some dropped, another case
            w = [draw.choice(words) if draw.random() < 0.12 else y.upper() for y in w if draw.random() > 0.05]
        t = clean[k].split()
        at = draw.randrange(len(t))
        rows.append((k, " ".join(t[:at] + w + t[at:])))
        planted.add((k, i))
    rows = brute.strange(rows + [(500 + k, t) for k, t in enumerate(clean[20:])])
    df = spark.createDataFrame([(i, t, 1, 0.5) for i, t in rows], "doc_id long, text string, item_id int, score double")
    some = spark.createDataFrame([*items, (None, "a null id"), (77, None), (78, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leak_report(df, some).collect()}
    assert {p for p in got if p[0] is not None and p[0] >= 500} == set()
    assert len(planted & got) >= 0.9 * len(planted)
    # In blocks of items the same is found.
    assert {(r["doc_id"], r["item_id"]) for r in leaks(df, some, items=7).collect()} == got
    left = without_leaks(df, some)
    found = {d for d, _ in got}
    assert left.columns == df.columns
    assert sorted(map(str, (r["doc_id"] for r in left.collect()))) == sorted(str(i) for i, _ in rows if i not in found)
    assert leak_report(df.limit(0), some).count() == leak_report(df, some.limit(0)).count() == 0


def test_short_items_are_found_word_for_word(spark):
    items = [(1, "capital of France Paris"), (2, "Paris"), (3, "red fox"), (4, "  ,. "), (5, "fox red fox"), (None, "blue whale")]
    docs = [(1, "The CAPITAL of france, Paris!"), (2, "a red  fox"), (3, "red a fox"), (4, "capital of France"), (5, "red fox red fox red"),
            (6, None), (7, ""), (None, "one blue whale"), (8, "parisian")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, `doc.x` int")
    some = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leak_report(df, some).collect()}
    assert got == {(1, 1), (1, 2), (2, 3), (5, 3), (5, 5), (None, None)}
    left = without_leaks(df, some)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 6, 7, 8]
    longer = some.unionByName(spark.createDataFrame([(9, "an item that has more than five words in it")], "item_id long, text string"))
    more = df.unionByName(spark.createDataFrame([(20, "see an item that has more than five words in it", 1)], df.schema))
    assert {(r["doc_id"], r["item_id"]) for r in leak_report(more, longer).collect()} == got | {(20, 9)}


def test_leading_vectors():
    draw = np.random.default_rng(2)
    q = np.linalg.qr(draw.normal(size=(60, 60)))[0]
    values = np.concatenate([[50, 40, 30, 20, 10], np.full(55, 1e-6)])
    matrix = (q * values) @ q.T
    directions = draw.normal(size=(60, 8))
    found = decontamination.leading(matrix @ directions, directions, 5)
    assert np.allclose(np.abs(np.sum(found * q[:, :5], axis=0)), 1, atol=1e-4)
    assert np.allclose(found.T @ found, np.eye(5))


def test_leaks_like_brute_force(spark):
    """Every pair that the verification accepts somewhere in a text, without candidates."""
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, "benchmark").collect()][:60]
    got = {(r["doc_id"], r["item_id"]) for r in leak_report(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    block = make_block(items)
    numbers = [block.number(decontamination.words_of(t)) for _, t in docs]
    stretches = [np.unique(n[n >= 0].astype(np.int64) + (np.flatnonzero(n >= 0) // 32) * block.vocabulary.size) % block.vocabulary.size for n in numbers]
    seen = np.bincount(np.concatenate(stretches), minlength=block.vocabulary.size)
    weight = np.log((sum(-(-n.size // 32) for n in numbers) + 1) / (seen + 1)) + 0.1
    want = set()
    for (doc_id, _), n in zip(docs, numbers):
        for k, item in enumerate(block.items):
            size = item.size
            for at in range(0, max(1, n.size), 32):
                around = n[max(0, at - size) : at + 64 + size]
                around = around[np.isin(around, item)]
                if weight[around].sum() >= 0.6 * weight[item].sum() and decontamination.match_score(block, k, around, weight) >= 0.6:
                    want.add((doc_id, block.ids[k]))
                    break
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) >= 3


def test_common_subsequence_and_answers():
    weight = np.array([1.0, 2.0, 4.0, 0.5])
    assert common_weight(np.array([0, 1, 2, 3]), np.array([1, 0, 2, 2, 3]), weight).tolist() == [1, 2, 6, 6.5]
    block = make_block([(1, "What is the name of it? The long answer"), (2, "too short"), (3, None)])
    assert block.ids == [1] and block.answers == [6] and [i for i, _ in block.short] == [2]
    from palisade.llm.decontamination import match_score

    ones = np.ones(block.vocabulary.size)
    assert match_score(block, 0, block.items[0], ones) == 1
    assert match_score(block, 0, block.items[0][:6], ones) == 0  # the question alone


# Addresses

PAGES = [
    ("http://a.example.net/en/x", ""),
    ("https://A.Example.NET/de/x?y#z", ""),
    ("http://net/", ""),
    ("http://net", ""),
    ("http://xnet/de/", ""),
    ("ftp://example.com:80/de/", ""),
    ("http://x.example.com/de/y", ""),
    ("http://x.org/fr/1", ""),
    ("no address", ""),
    (None, None),
    ("http://one.example.com/en/1", '<head><LINK href="http://b.net/de/" rel="canonical"></head>'),
    ("http://two.example.com/en/1", "<meta http-equiv=refresh content='0; url=http://one.example.com/en/1'>"),
    ("http://three.example.com/en/1", '<link rel="canonical" href="http://x.org/fr/9"/>'),
    ("http://four.example.com/en/1", '<link rel="canonical" href="http://three.example.com/en/1"/>'),
    ("http://four.example.com/en/1", '<meta http-equiv="refresh" content="1;URL=http://c.net/a">'),
    ("https://two.example.com/en/1#part", ""),
    ("http://five.example.com/a", '<link rel=canonical href="/b">'),
    ("http://five.example.com/b", '<link rel=canonical href="//d.net/">'),
    ("http://self.example.com/a", '<link rel=canonical href="http://self.example.com/a">'),
]


# (url, page, verdict): pages whose links are relative, escaped, or not the first.
LINKED = [
    ("http://a1.example.com/en/1", '<link rel=canonical href="http://ok.com/"><link rel=canonical href="http://c.net/">', "block"),
    ("http://a2.example.com/en/p.html", '<link rel=canonical href="../de/p.html">', "block"),
    ("http://a3.com/x/q.html", "<link rel=canonical href='http://a4.com/x/p.html'>", "block"),
    ("http://a4.com/x/p.html", "<link rel=canonical href=q.html>", "block"),
    ("http://a4.com/x/q.html", "<meta http-equiv=refresh content='0;url=http://z.net/'>", "block"),
    ("http://a5.com/", '<link rel=canonical href="http:&#x2F;&#x2F;d.net/">', "block"),
    ("http://a6.com/a?x=1", '<link rel="alternate canonical" href=" http&colon;&sol;&sol;d&#46;net/?a=1&amp;b=2 ">', "block"),
    ("http://a7.com/a/b/c", '<base href="http://b7.net/x/"><link rel=canonical href="y">', "block"),
    ("http://a8.com/a/b/c", "<base href='../'><link rel=canonical href='x#y'><meta http-equiv=refresh content='5'>", "block"),
    ("http://a8.com/a/x", "<META HTTP-EQUIV='Refresh' CONTENT='0; URL=//e.net'><link rel=canonical href='//e.net/..'>", "block"),
    ("http://b8.com/a/b/c", "<base href='../'><link rel=canonical href='x#y'>", "block"),
    ("http://b8.com/a/x", "<link rel=canonical href='//e.net/..'>", "block"),
    ("http://a9.com/a", "<link rel=canonical href='mailto:x@y.net'><link rel=canonical href='#top'><link rel=canonical href=''>", "allow"),
    ("http://c1.com/a?b", "<link rel=canonical href='?c'>", "block"),
    ("http://c1.com/a?c", "<link rel=canonical href='./x/.././a?d&e=//n'>", "block"),
    ("http://c1.com/a?d&e=//n", "<link rel=canonical href='https://q.example.com/./en/../de/'>", "block"),
    ("http://c2.com/a", "<link rel=canonical href='n?u=http://v.net/'>", "allow"),
    ("http://c3.com/&eacute", "<link rel=canonical href='http://c4.com/&eacute;&#233;&#xE9'>", "allow"),
    ("http://c4.com/&eacute;éé", "<link rel=nofollow href='http://x.net/'>", "allow"),
    ("no address", "<link rel=canonical href='x'><link rel=canonical href='//x.net/'>", "allow"),
    (None, "<link rel=canonical href='x'>", "allow"),
]


def test_all_links_count(spark):
    rows = [(i, u, h, "x", v) for i, (u, h, v) in enumerate(LINKED)] + [(100, None, None, "x", "allow"), (101, "http://a5.com/", None, "x", "block")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, base string, links string")
    got = {r["page_id"]: r for r in judge(df).collect()}
    assert {i: r["verdict"] for i, r in got.items()} == {r[0]: r[4] for r in rows}
    con = duckdb.connect()
    con.register("pages", df.toArrow())
    rel = con.sql(ORACLES["op9_url_aliases"])
    assert sorted(rel.fetchall()) == sorted(tuple(r[c] for c in rel.columns) for r in got.values())


def test_addresses(spark):
    rows = [(i, u, h, "x") for i, (u, h) in enumerate(PAGES)] + [(None, "http://q.net/de/", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(df).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("a.example.net", "/de/x", "net/", "block")
    assert got[2] == ("net", "/", "net/", "block") and got[3] == ("net", "", None, "allow")
    assert got[4] == ("xnet", "/de/", None, "allow") and got[5] == ("example.com:80", "/de/", None, "allow")
    assert got[6][2:] == ("example.com/de/", "block") and got[7][2:] == ("org/fr/", "allow")
    assert got[8] == got[9] == ("", "", None, "allow") and got[None][2:] == ("net/", "block")
    # One is an alias of a blocked address, two of one; allow wins among three and four.
    assert [got[k][3] for k in (10, 11, 15)] == ["block"] * 3
    assert [got[k][3] for k in (12, 13, 14)] == ["allow"] * 3
    assert [got[k][3] for k in (16, 17, 18)] == ["block", "block", "allow"]
    more = spark.createDataFrame([("http://self.example.com/a", "http://e.net/de/")], "source string, target string")
    assert {r["page_id"]: r["verdict"] for r in judge(df, redirects=more).collect()}[18] == "block"
    assert judge(df.limit(0)).count() == 0


# Pages

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="no-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a>x</a></ul></nav><div id="cookie-notice">A notice about cookies, long enough to surge over the threshold by itself, so it seems.</div>
<main><article><header><h1>Head &amp; line</h1></header><p>First   para <a href=x>link</a>&nbsp;end.</p><div class="ad">Buy</div><p>Be.</p>
<form><label>Mail</label><input></form><!-- hidden > --><ul><li>one<li>two</ul><aside>side</aside><p style="display: none">no</p>
<table><tr><td>a</td><td>b</td></tr></table><p>a &lt; b < c<script>var t="</p>"</script></p><section class="comments"><article><p>reader says</p></article></section>
</article></main><footer>&copy;</footer>"""


def test_main_text():
    assert main_text(PAGE).split("\n\n") == ["Head & line", "First para link end.", "Be.", "one", "two", "a b", "a < b < c"]
    plain = "<ul><li><a>Menu one</a></li><li><a>Menu two</a></li></ul><div><p>" + "Long text. " * 12 + "</p><p>short</p></div>"
    assert main_text(plain) == ("Long text. " * 12).strip() + "\n\nshort"
    assert main_text("") == main_text(None) == main_text("<nav>menu</nav>") == ""
    assert main_text("<article><p><b>Title<br><p>cut o") == "Title\n\ncut o"
    assert main_text('<div class="wrap sidebar"><article><p>kept</p></article></div>') == "kept"


def test_unmarked_pages_with_dropped_elements():
    long = "Long text. " * 19
    ad = "<div class=ad>x</div>"
    assert main_text(f"<body><div><p>{long}</p>{ad}<p>He died in 1990.</p></div></body>").split("\n\n") == [
        long.strip(), "He died in 1990."
    ]
    assert main_text(f"<div><h1>Title</h1>{ad}{ad}<p>a</p><form>b</form><p>{long}</p></div>").split("\n\n") == [
        "Title", "a", long.strip()
    ]
    # What stands in another container stays out.
    assert main_text(f"<div>tagline</div><nav>menu</nav><div><p>{long}</p></div>") == long.strip()
    assert main_text("<body><p>Only a short one.</p></body>") == "Only a short one."
    assert main_text(f"<div>by</div>{ad}<div><p>One short.</p>{ad}<p>Two.</p></div>") == "One short.\n\nTwo."
    assert main_text("<ul><li><a>Menu one</a></li></ul>") == ""


def test_surge_and_dive():
    keep = between_surge_and_dive([5, 0, 0, 0, 0, 0, 50, 0, 50, 0, 0, 0, 9], 3, 80)
    assert keep[6] and keep[8] and not keep[0] and not keep[12]
    assert between_surge_and_dive([], 3, 80) == []


def test_pages_table(spark):
    rows = brute.strange([(1, PAGE), (2, "<p>" + "word " * 50)])
    df = spark.createDataFrame([(i, None, h, 3) for i, h in rows], "page_id long, url string, html string, text int")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in extract(df).collect()), key=str)
    assert got == sorted(((i, main_text(h), len(main_text(h))) for i, h in rows), key=str)
    assert extract(df.limit(0)).count() == 0


def test_articles_of_the_given_pages(spark):
    import html
    import re

    for r in extract(table(spark, "pages")).join(table(spark, "pages").drop("url"), "page_id").collect():
        article = re.search("<article>(.*?)(</article>|<footer>|$)", r["html"], re.S)[1]
        blocks = re.split("</?(?:p|h1)>", re.sub("<br>", " ", re.sub("</?b>", "", article)))
        want = [" ".join(html.unescape(b).split()) for b in blocks]
        assert r["text"] == "\n\n".join(b for b in want if b)


# All of it


@pytest.mark.parametrize("piece", [
    "<b>x</i>", "</i>", "<div><b></div>", "<p><b>t</p>", "<i><div><b>", "<a href=\"", "<a '>", "<!-- x", "<![CDATA[", "&amp;&#x2F;", "<li><b>",
    "<td></i>", "< <", "<a b='\">", "<script>x", "<b \"'>",
])
def test_long_pages_take_linear_time(piece):
    import time

    start = time.time()
    main_text("<i>" + piece * (1_000_000 // len(piece)))
    assert time.time() - start < 20


def test_what_stays_in_an_article():
    page = "<article><p>Take <math><mi>x</mi></math> as <label>given</label> and <span class='share'>share</span> it.</p>"
    assert main_text(page) == "Take x as given and share it."
    gone = "<article><p>Read <span class='ad'>BUY</span>on.</p><div class='share'>Tweet</div><form><label>Name</label></form></article>"
    assert main_text(gone) == "Read on."


def test_linked_headings_stay_on_unmarked_pages():
    body = "word " * 40
    page = f"<body><div><p>{body}</p><h2><a href=x>A linked heading</a></h2><p>{body}</p></div></body>"
    assert main_text(page).split("\n\n") == [body.strip(), "A linked heading", body.strip()]
    menu = f"<body><div><p>{body}</p><ul><li><a href=x>One</a><li><a href=y>Two</a></ul><p>{body}</p></div></body>"
    assert main_text(menu).split("\n\n") == [body.strip(), body.strip()]


def test_pipeline_stages(spark, tmp_path):
    """Each stage against what it is for, on its own input."""
    docs = table(spark, "documents")
    columns = docs.columns
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], SMALL)
        if k < 4:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    rows = [x.collect() for x in seen]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, "labels").collect()}
    good = {r["doc_id"] for r in rows[1]}
    right = [(r["doc_id"] in good) == (labels[r["doc_id"]] == 1) for r in rows[0] if r["doc_id"] in labels]
    assert np.mean(right) > 0.9

    groups = brute.near_groups([r["text"] for r in rows[1]])
    kept = {r["doc_id"] for r in rows[2]}
    assert len(kept) == len(rows[2]) == len(set(groups))
    assert {g for g, r in zip(groups, rows[1]) if r["doc_id"] in kept} == set(groups)

    cut = {r["doc_id"]: r for r in rows[3]}
    for r, runs in zip(rows[2], brute.passages([(r["doc_id"], r["text"]) for r in rows[2]], 51)):
        left = cut[r["doc_id"]]
        assert left["n_chars"] == len(left["text"])
        gone = {k for a, b in runs for k in range(a, b)}
        assert left["text"].encode().split() == [w for k, w in enumerate(r["text"].encode().split()) if k not in gone]

    items = [r["text"] for r in table(spark, "benchmark").collect()]
    clean = {r["doc_id"] for r in rows[4]}
    for r in rows[3]:
        assert (r["doc_id"] in clean) == (not any(x in r["text"] for x in items))
    tokens = rows[5]
    assert sorted(r["doc_id"] for r in tokens) == sorted(clean)
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in tokens)


def test_registered_queries():
    numbers = sorted(int(q[2:].split("_")[0]) for q in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "decontamination", "tokens"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_like_their_sql(spark, name):
    from check import compare, connect

    ok, line = compare(spark, connect(SMALL), SMALL, name, QUERIES[name], ORACLES[name])
    assert ok, line


def test_words_are_projected_a_part_of_a_batch_at_a_time():
    import tracemalloc

    import pyarrow as pa

    ids = np.random.default_rng(1).integers(-1, 50, (64, 4000)).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in ids], pa.binary())], ["ids"])
    directions = np.random.default_rng(2).standard_normal((50, 80))
    tracemalloc.start()
    whole = list(decontamination._gathered(np.ones(50), directions)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
    parts = [r for i in range(64) for r in decontamination._gathered(np.ones(50), directions)(iter([batch.slice(i, 1)]))]
    total = np.zeros((50, 80))
    for r in parts:
        total[r["word"].to_numpy()] += np.array(r["v"].to_pylist())
    assert np.allclose(np.array(whole[0]["v"].to_pylist()), total, rtol=1e-3, atol=1e-2)


def test_passages_are_laid_out_many_documents_at_once(monkeypatch):
    """Windows of two stretches over documents of all lengths, in parts of so many words, as document by document."""
    import numpy as np

    monkeypatch.setattr(decontamination, "WORDS_AT_ONCE", 200)
    draw, size = np.random.default_rng(4), decontamination.STRETCH
    docs = [draw.integers(-1, 9, n).astype(np.int32) for n in (1, 31, 32, 33, 64, 65, 96, 300, 5, 128)]
    docs = [np.append(d, 3).astype(np.int32) for d in docs]
    vectors = draw.normal(size=(9, 4))
    parts = list(decontamination._passages([d.tobytes() for d in docs]))
    assert len(parts) > 2 and [p.begin for p in parts[:2]] == [0, len(parts[0].docs)]
    got = {(int(d), int(p)): row for part in parts for d, p, row in zip(part.doc, part.place, part.windows(vectors))}
    want = {}
    for i, ids in enumerate(docs):
        for p in range(max(-(-ids.size // size) - 1, 1)):
            window = ids[p * size : (p + 2) * size]
            want[i, p] = vectors[window[window >= 0]].sum(axis=0)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    for part in parts:
        opens = list(zip(part.doc.tolist(), part.place.tolist()))
        for word, stretch in zip(part.word.tolist(), part.stretch.tolist()):
            here, before = int(part.here[stretch]), int(part.before[stretch])
            windows = [opens[w] for w in (here, before) if w >= 0]
            assert all(word in docs[d][p * size : (p + 2) * size] for d, p in windows) and len(set(windows)) == len(windows)
