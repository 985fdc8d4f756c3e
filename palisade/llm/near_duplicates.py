"""Near-duplicate texts: ProbMinHash signatures, banding, exact verification, classes.

Each of a text's shingles of five words is a Poisson process; its arrivals fall on random
registers, and a register keeps the shingle that arrives first. Two texts agree in a register
with the probability Jaccard similarity of their weighted shingles. All rates are 1 here,
however often a shingle occurs in its text, and with these that is the Jaccard similarity of
the sets, by which texts are verified. Arrivals after the time by which all registers are
filled can't change anything, so only about m ln m of them are ever drawn, however long the
text.

1. Equal texts are one text from here on; they share a class by themselves.
2. Signatures are cut into bands; texts with an equal band meet in a bucket. Each bucket links
   its texts to two of them, its leaders, the ends of one order of all texts, so a bucket of n
   texts has 2 n candidate pairs, and large buckets of the same texts mostly have the same.
3. Candidates whose sizes or signatures rule a similarity of 0.8 out are dropped; the others
   are verified on the sets of shingles (Jaccard, exactly 0.8 or more).
4. Links join texts to classes. Buckets that still hold several classes do this once more, with
   leaders by another order.
5. The leaders only save work. Whatever buckets still hold several classes, their texts are
   dealt into blocks, and every two blocks are compared, all pairs of different classes, first
   by size and signature, then, for texts with a partner left, on the sets. A class too large
   for a block has blocks of its own, which are not compared with each other. Work grows with
   the square of the texts of small classes in a bucket; rows made do so over BLOCK.

With 25 bands of 5 registers a pair at 0.8 misses all buckets once in 20,000 times, at 0.9 once
in 10^9. Ruling out by signature starts below 0.56 agreement, which a pair at 0.8 falls short
of once in 3 * 10^9 times.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import (
    column,
    components,
    discard_since,
    release,
    small_batches,
    text_batches,
    written,
    written_so_far,
)
from palisade.llm.pieces import END, SPACE, classes, hashes, parts

WORDS = 5
SIMILAR = 0.8
BANDS = 25
ROWS = 5
AGREE = 0.56
# Rounds with leaders.
ROUNDS = 2
# Texts of a bucket that are compared in full with as many others at once.
BLOCK = 256

_ALL = (1 << 64) - 1
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


@cache
def _factors(words: int) -> list[np.uint64]:
    return [np.uint64(pow(int(_C), k, 1 << 64)) for k in range(words)]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The 64-bit hashes of all runs of ``words`` words, in order; a shorter text is one
    shingle, a text without words has none."""
    found = []
    for part in parts(text or ""):
        points = np.frombuffer((part + " ").encode("utf-32-le"), np.uint32)
        inside = classes()[points] != SPACE
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        if edge.size:
            found.append(hashes(points, edge[0::2], edge[1::2]))
    w = np.concatenate(found) if found else np.zeros(0, np.uint64)
    if not w.size:
        return w
    if w.size < words:
        w = np.concatenate([w, np.full(words - w.size, END, np.uint64)])
    n = w.size - words + 1
    out = np.zeros(n, np.uint64)
    for k, factor in enumerate(_factors(words)):
        out += w[k : k + n] * factor
    return mixed(out)


def signature(items: np.ndarray, weights: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """The item that arrives first at every register."""
    horizon = registers * (np.log(registers) + 4) / weights.sum()
    while True:
        live, rate, clock, k = items, weights, np.zeros(items.size), 0
        times, places, who = [], [], []
        while live.size:
            k += 1
            draw = mixed(live ^ np.uint64(k * int(_B) & _ALL))
            # 53 bits for the waiting time, and others for the register.
            clock = clock - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / rate
            early = clock < horizon
            live, rate, clock = live[early], rate[early], clock[early]
            times.append(clock)
            places.append((mixed(draw[early]) % np.uint64(registers)).astype(np.int64))
            who.append(live)
        time, place, first = np.concatenate(times), np.concatenate(places), np.concatenate(who)
        order = np.argsort(-time, kind="stable")
        out, filled = np.zeros(registers, np.uint64), np.zeros(registers, bool)
        out[place[order]] = first[order]  # the earliest is written last
        filled[place] = True
        if filled.all():
            return out
        horizon *= 2


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash for each band."""
    table = sig.reshape(-1, rows)
    out = np.arange(table.shape[0], dtype=np.uint64)
    for k in range(rows):
        out = mixed(out ^ table[:, k])
    return out


def _signed(batch: pa.RecordBatch) -> pa.RecordBatch:
    sizes, short, hashed = [], [], []
    for text in batch.column("text").to_pylist():
        items = np.unique(shingles(text))
        sizes.append(items.size)
        if items.size:
            sig = signature(items, np.ones(items.size))
            short.append((sig & np.uint64(255)).astype(np.uint8).tobytes())
            hashed.append(bands(sig).view(np.int64))
        else:
            short.append(None)
            hashed.append(None)
    return pa.RecordBatch.from_arrays(
        [
            *(batch.column(c) for c in ("rid", "doc_id", "key")),
            pa.array(sizes, pa.int32()),
            pa.array(short, pa.binary()),
            pa.array(hashed, pa.list_(pa.int64())),
        ],
        ["rid", "doc_id", "key", "n", "sig", "bands"],
    )


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [
        np.unique((shingles(t) & np.uint64(0xFFFFFFFF)).astype(np.uint32)).tobytes()
        for t in batch.column("text").to_pylist()
    ]
    return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.binary())], ["key", "items"])


def _agree(batch: pa.RecordBatch) -> pa.RecordBatch:
    a = [np.frombuffer(b, np.uint8) for b in batch.column("sig_u").to_pylist()]
    b = [np.frombuffer(b, np.uint8) for b in batch.column("sig_v").to_pylist()]
    same = np.mean(np.stack(a) == np.stack(b), axis=1).astype(np.float32)
    return batch.select(["u", "v"]).filter(pa.array(same >= AGREE))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending arrays without repeats."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / max(a.size + b.size - both, 1)


def _similar(batch: pa.RecordBatch) -> pa.RecordBatch:
    score = [
        jaccard(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32))
        for a, b in zip(batch.column("set_u").to_pylist(), batch.column("set_v").to_pylist())
    ]
    return batch.select(["u", "v"]).filter(pa.array(np.array(score) >= SIMILAR))


def _pairs_of(buckets: DataFrame, round_: int) -> DataFrame:
    """(u, v) of rows (band, hash, key, n, root, size): texts u with leaders v of their buckets.

    Only buckets with several classes have leaders, and only texts of other classes, no
    larger than the leader's, are paired with them: those few are to find their way into a
    large class, not its members into theirs. What is left out here is compared in the end.
    """
    one = F.struct(F.xxhash64("key", F.lit(round_)).alias("o"), "key", "n", "root", "size")
    lead = (
        buckets.groupBy("band", "hash")
        .agg(F.array(F.min(one), F.max(one)).alias("leaders"), F.min("root").alias("a"), F.max("root").alias("z"))
        .where("a <> z")
        .select("band", "hash", "leaders")
    )
    lead = written(lead, "near-leaders")
    return (
        buckets.join(lead, ["band", "hash"])
        .select("key", "n", "root", "size", F.explode("leaders").alias("l"))
        .where("root <> l.root and size <= l.size")
        .where(F.least(F.col("n"), F.col("l.n")) >= F.greatest(F.col("n"), F.col("l.n")) * SIMILAR)
        .select(F.col("key").alias("u"), F.col("l.key").alias("v"))
        .distinct()
    )


def _agreeing(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose signatures allow for similarity."""
    sigs = texts.select("key", "sig")
    return (
        pairs.join(sigs.withColumnsRenamed({"key": "u", "sig": "sig_u"}), "u")
        .join(sigs.withColumnsRenamed({"key": "v", "sig": "sig_v"}), "v")
        .mapInArrow(text_batches(_agree), "u binary, v binary")
    )


def _verified(near: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are similar."""
    return (
        near.join(sets.withColumnsRenamed({"key": "u", "items": "set_u"}), "u")
        .join(sets.withColumnsRenamed({"key": "v", "items": "set_v"}), "v")
        .mapInArrow(text_batches(_similar), "u binary, v binary")
    )


def _dealt(here: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (task, side, band, key, root, n, sig, bands) of the blocks that are to be compared,
    for rows (band, hash, key, root): all texts of side 0 with all of side 1, or, where
    there is no side 1, with each other."""
    classes_ = written(here.groupBy("band", "hash", "root").agg(F.count("*").alias("c")), "near-bucket-classes")
    large = classes_.where(F.col("c") > BLOCK)
    mixed = (
        classes_.groupBy("band", "hash")
        .agg(
            F.count("*").alias("classes"),
            F.sum("c").alias("texts"),
            F.sum(F.when(F.col("c") <= BLOCK, F.col("c"))).alias("small"),
        )
        # Two leaders have met all the texts of a bucket of three.
        .where("classes > 1 and texts > 3")
        .select("band", "hash", "small")
    )
    mixed = written(mixed, "near-mixed")
    # Texts of small classes share blocks, which have no owner.
    rows = (
        here.join(mixed, ["band", "hash"])
        .join(large, ["band", "hash", "root"], "left")
        .select(
            "band", "hash", "key", "root",
            F.when(F.col("c").isNotNull(), F.col("root")).otherwise(F.lit(b"")).alias("owner"),
            F.pmod(F.xxhash64("key"), F.ceil(F.coalesce("c", "small") / BLOCK)).alias("salt"),
        )
    )
    rows = written(rows, "near-blocks")
    blocks = rows.select("band", "hash", "owner", "salt").distinct().groupBy("band", "hash")
    blocks = blocks.agg(F.sort_array(F.collect_list(F.struct("owner", "salt"))).alias("all"))
    tasks = (
        blocks.select("band", "hash", "all", F.posexplode("all").alias("k", "a"))
        .select("band", "hash", "a", F.explode(F.slice("all", F.col("k") + 1, F.size("all"))).alias("b"))
        .where("a.owner = X'' or a.owner <> b.owner")
        .withColumn("task", F.monotonically_increasing_id())
    )
    tasks = written(tasks, "near-tasks")
    ends = tasks.select("task", F.lit(0).alias("side"), "band", "hash", "a.*").unionAll(
        tasks.where("a <> b").select("task", F.lit(1).alias("side"), "band", "hash", "b.*")
    )
    return (
        rows.join(ends, ["band", "hash", "owner", "salt"])
        .select("task", "side", "band", "key", "root")
        .join(texts.select("key", "n", "sig", "bands"), "key")
        .select("task", "side", "band", "key", "root", "n", "sig", "bands")
    )


def _partners(task: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of a task that may be similar and are of different classes. A pair that
    shares an earlier band too is left to that band's bucket."""
    side = task.column("side").to_numpy()
    band = task.column("band")[0].as_py()
    n = task.column("n").to_numpy().astype(np.int64)
    root = np.unique(np.array(task.column("root").to_pylist(), object), return_inverse=True)[1]
    sig = np.stack([np.frombuffer(b, np.uint8) for b in task.column("sig").to_pylist()])
    hashed = np.array(task.column("bands").to_pylist(), np.int64)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not right.size
    if alone:
        right = left
    us, vs = [], []
    for at in range(0, left.size, 32):
        few = left[at : at + 32]
        small = np.minimum(n[few, None], n[None, right])
        ok = (small >= np.maximum(n[few, None], n[None, right]) * SIMILAR) & (root[few, None] != root[None, right])
        if alone:
            ok &= few[:, None] < right[None]
        i, j = np.nonzero(ok)
        for k in range(0, i.size, 8192):
            u, v = few[i[k : k + 8192]], right[j[k : k + 8192]]
            good = np.mean(sig[u] == sig[v], axis=1).astype(np.float32) >= AGREE
            good &= ~(hashed[u, :band] == hashed[v, :band]).any(axis=1)
            us.append(u[good])
            vs.append(v[good])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def _possible(task: pa.Table) -> pa.Table:
    """The texts of a task that have a partner in it."""
    return task.take(pa.array(np.unique(np.concatenate(_partners(task)))))


def _linked(task: pa.Table) -> pa.Table:
    """Links (u, v) that join all classes of a task with similar texts. Pairs that earlier
    links have joined need none."""
    us, vs = _partners(task)
    key, root = task.column("key").to_pylist(), task.column("root").to_pylist()
    items = [np.frombuffer(b, np.uint32) for b in task.column("items").to_pylist()]
    up = {r: r for r in root}

    def find(r: bytes) -> bytes:
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r

    found = []
    for u, v in zip(us.tolist(), vs.tolist()):
        a, b = find(root[u]), find(root[v])
        if a != b and jaccard(items[u], items[v]) >= SIMILAR:
            up[a] = b
            found.append((key[u], key[v]))
    return pa.table({"u": pa.array([u for u, _ in found], pa.binary()), "v": pa.array([v for _, v in found], pa.binary())})


def _compared(here: DataFrame, texts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) that join all classes that have similar texts in a bucket."""
    schema = "task long, side int, band int, key binary, root binary, n int, sig binary, bands array<long>"
    possible = written(_dealt(here, texts).groupBy("task").applyInArrow(_possible, schema), "near-possible")
    return possible.join(sets, "key").groupBy("task").applyInArrow(_linked, "u binary, v binary")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, key, class_id, class_size, kept) of every row of ``docs``.

    ``class_id`` is the least doc_id of the class, ``kept`` holds for one row of each: the
    first with that id. ``rid`` is the row's number; ``docs`` has to be read from files, whose
    rows come in the same order each time. Equal texts, null and empty among them, are one
    class (null counts as empty); texts without words are similar to their equals only. A
    null doc_id is no class id unless the class has no other. An empty table gives none.
    """
    spark = docs.sparkSession
    before = written_so_far()
    small_batches(spark)
    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        column(id_col).cast("long").alias("doc_id"),
        F.unhex(F.md5(text.cast("binary"))).alias("key"),
        text.alias("text"),
    )
    signed = rows.mapInArrow(
        text_batches(_signed), "rid long, doc_id long, key binary, n int, sig binary, bands array<long>"
    )
    signed = written(signed, "near-signed")
    texts = signed.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "sig", "bands")])
    texts = written(texts, "near-texts")
    buckets = texts.select("key", "n", F.posexplode("bands").alias("band", "hash"))
    crowded = buckets.groupBy("band", "hash").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    crowded = written(crowded, "near-crowded")
    buckets = written(buckets.join(crowded, ["band", "hash"], "left_semi"), "near-buckets")
    release(spark)

    # One row for each text that shares a bucket.
    wanted = signed.select("rid", "key").join(buckets.select("key").distinct(), "key")
    first = wanted.groupBy("key").agg(F.min("rid").alias("rid"))
    sets = rows.join(first, "rid", "left_semi").select("key", "text").mapInArrow(text_batches(_sets), "key binary, items binary")
    sets = written(sets, "near-sets")
    release(spark)

    roots = tested = None
    for round_ in range(ROUNDS + 1):
        here = buckets.withColumns({"root": F.col("key"), "size": F.lit(1).cast("long")})
        if roots is not None:
            here = buckets.join(roots, buckets["key"] == roots["node"], "left").select(
                "band", "hash", "key", "n", F.coalesce("root", "key").alias("root"),
                F.coalesce("size", F.lit(1)).alias("size"),
            )
        if round_ == ROUNDS:
            links = _compared(here.select("band", "hash", "key", "root"), texts, sets)
        else:
            pairs = _pairs_of(here, round_)
            if tested is not None:
                pairs = pairs.join(tested, ["u", "v"], "left_anti")
            near = written(_agreeing(pairs, texts), "near-agreeing")
            tested = near if tested is None else tested.unionAll(near)
            links = _verified(near, sets)
        links = written(links, "near-links")
        if links.isEmpty():
            continue
        # The classes so far are links of their members to the root.
        known = links if roots is None else links.unionAll(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
        found = written(components(spark, known, "near-components"), "near-roots")
        roots = found.join(found.groupBy("root").agg(F.count("*").alias("size")), "root")
        release(spark)

    members = signed.select("rid", "doc_id", "key")
    if roots is not None:
        members = members.join(roots, members["key"] == roots["node"], "left").select(
            "rid", "doc_id", "key", F.coalesce("root", "key").alias("root")
        )
    else:
        members = members.withColumn("root", F.col("key"))
    members = written(members, "near-rows")
    # Null ids come last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    best = members.groupBy("root").agg(first.alias("first"), F.count("*").alias("class_size"))
    best = written(best, "near-classes")
    # All that the result reads is in these two.
    discard_since(before, spark, members, best)
    release(spark)
    return members.join(best, "root").select(
        "rid",
        "doc_id",
        "key",
        F.col("first.doc_id").alias("class_id"),
        "class_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"),
    )


def near_report(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, kept) of every document."""
    return near_classes(docs).select("doc_id", "class_id", "class_size", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns."""
    kept = written(near_classes(docs).where("kept").select(F.col("rid").alias("__rid")), "near-kept")
    numbered = docs.withColumn("__rid", F.monotonically_increasing_id())
    return numbered.join(kept, "__rid", "left_semi").drop("__rid")
