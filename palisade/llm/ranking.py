"""Quality scores learnt from preferences (Bradley-Terry).

A document labelled good is preferred to one labelled bad. The strength of a document is a
linear function of its features, and the chance that it is preferred is the logistic function
of the difference in strength; the weights minimise the logistic loss over such pairs. The
threshold is a quantile of the strengths: as many labelled documents lie above it as are
labelled good. A score is the chance to be preferred to a document at the threshold.

Features are computed where the texts are, in one pass without a shuffle. The model is fitted
on all labelled documents: they are dealt into blocks, those of a block are compared, and each step
of the fit adds up what the blocks give.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import column, discard, small_batches, text_batches, written
from palisade.llm.pieces import parts

# Documents of a block, how many of a rare label each block gets, comparisons of a document (more if there are fewer
# than PAIRS in all), and the weight of the ridge.
BLOCK = 4_000
RARE = 20
ROUNDS = 10
PAIRS = 200_000
RIDGE = 1e-4
# Strengths that are looked at one by one.
FEW = 20_000
SEED = 20

_SYMBOLS = np.frombuffer(b"#*$%&<>@^~_=+{}[]\\/", np.uint8)
_STOPS = np.frombuffer(b".,;:?", np.uint8)
NAMES = (
    "symbols bars shouts upper digits stops spaces lines other_bytes word_length length distinct same_twice"
    " distinct_runs few_words"
).split()


def features(text: str | None) -> np.ndarray:
    """Shares of characters and words, squeezed so that a few per cent already count; all
    zero but the last for an empty or null text."""
    out = np.zeros(len(NAMES), np.float64)
    out[-1] = 1.0
    if not text:
        return out
    counts = np.zeros(256, np.int64)
    seen: set[str] = set()
    runs: set[tuple] = set()
    words = chars = same = 0
    tail: list[str] = []
    for part in parts(text):
        counts += np.bincount(np.frombuffer(part.encode(), np.uint8), minlength=256)
        own = part.split()
        seen.update(own)
        words += len(own)
        chars += sum(map(len, own))
        chain = tail + own
        same += sum(map(str.__eq__, chain[max(0, len(tail) - 1) :], chain[max(0, len(tail) - 1) + 1 :]))
        # Runs are told apart by hash, which is half the memory of the words themselves.
        runs.update(map(hash, zip(chain, chain[1:], chain[2:])))
        tail = chain[-2:]
    size = int(counts.sum())
    n = max(words, 1)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    out[:] = [
        np.tanh(10 * counts[_SYMBOLS].sum() / size),
        np.tanh(10 * counts[ord("|")] / size),
        np.tanh(10 * counts[ord("!")] / size),
        upper / max(upper + lower, 1),
        np.tanh(5 * counts[48:58].sum() / size),
        counts[_STOPS].sum() / size,
        counts[32] / size,
        np.tanh(5 * counts[10] / size),
        counts[128:].sum() / size,
        np.tanh(chars / n / 10),
        np.log1p(words) / 10,
        len(seen) / n,
        np.tanh(5 * same / n),
        len(runs) / max(words - 2, 1),
        1.0 / (1 + words / 20),
    ]
    return out


@dataclass(frozen=True)
class Ranking:
    """Strength is ``weights`` times features; scores are relative to ``threshold``."""

    weights: np.ndarray
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        strength = np.clip(x @ self.weights - self.threshold, -700, 700)
        return 1.0 / (1.0 + np.exp(-strength))


def _comparisons(good: np.ndarray, bad: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two sides of a block's pairs: every row of the larger side meets ``rounds`` of the other,
    or all if there are fewer, and every row of the smaller side is met."""
    more, less = max(len(good), len(bad)), min(len(good), len(bad))
    draw = np.random.default_rng(SEED)
    one, other = draw.permutation(more), draw.permutation(less)
    turn = np.arange(min(rounds, less))[:, None]
    one, other = np.tile(one, len(turn)), other[(np.arange(more) + turn) % less].ravel()
    return (one, other) if len(good) == more else (other, one)


def _blocks(rows: DataFrame, n_good: int, n_bad: int) -> DataFrame:
    """The features as rows (good, bad) of about ``BLOCK`` documents, chosen by a hash of the id.

    Where one label is rare, its documents go to as many blocks as give each some of them.
    """
    blocks = -(-(n_good + n_bad) // BLOCK)
    rare = n_good <= n_bad
    copies = min(blocks, -(-RARE * blocks // min(n_good, n_bad)))
    step = F.explode(F.sequence(F.lit(0), F.when(F.col("good") == rare, F.lit(copies - 1)).otherwise(F.lit(0))))
    dealt = rows.select("doc_id", "good", "x", step.alias("step")).select(
        "doc_id", "good", "x", F.pmod(F.xxhash64("doc_id") + F.col("step"), F.lit(blocks)).alias("block")
    )

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("good", "ascending")])
        x, good = np.array(group["x"].to_pylist()), np.array(group["good"].to_pylist(), bool)
        return pa.table({"good": pa.array([x[good].tobytes()], pa.binary()), "bad": pa.array([x[~good].tobytes()], pa.binary())})

    return dealt.groupBy("block").applyInArrow(pack, "good binary, bad binary")


def _slopes(packed: DataFrame, weights: np.ndarray, scale: np.ndarray, rounds: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(pairs, slope, bend) of the loss, added up over the blocks; one row a task comes to the driver."""
    size = len(weights)

    def run(batches):
        n, slope, bend = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            for good, bad in zip(batch.column("good").to_pylist(), batch.column("bad").to_pylist()):
                best, worst = (np.frombuffer(side, np.float64).reshape(-1, size) for side in (good, bad))
                if not len(best) or not len(worst):
                    continue
                i, k = _comparisons(best, worst, rounds)
                difference = (best[i] - worst[k]) / scale
                chance = 1.0 / (1.0 + np.exp(-np.clip(difference @ weights, -700, 700)))
                n += len(i)
                slope += difference.T @ (chance - 1)
                bend += (difference * (chance * (1 - chance))[:, None]).T @ difference
        yield pa.RecordBatch.from_pylist([{"s": [float(n), *slope, *bend.ravel()]}], pa.schema([("s", pa.list_(pa.float64()))]))

    sums = np.array(packed.mapInArrow(run, "s array<double>").toArrow()["s"].to_pylist()).sum(0)
    return sums[0], sums[1 : size + 1], sums[size + 1 :].reshape(size, size)


def _between(strengths: DataFrame, k: int, total: int) -> float:
    """Halfway between the k-th and the (k + 1)-th least strength, exactly.

    Approximate quantiles narrow the values to a band around the two, until few enough are left to look at.
    """
    low, high, below, inside = float("-inf"), float("inf"), 0, total
    band = strengths
    while inside > FEW:
        around = [max(0.0, (k - below) / inside - 1e-3), min(1.0, (k - below) / inside + 1e-3)]
        low, high = band.agg(F.percentile_approx("s", around, 10_000)).first()[0]
        if low == high:
            return low
        band = strengths.where(F.col("s").between(F.lit(low), F.lit(high)))
        before, (below, inside) = inside, strengths.agg(F.count_if(F.col("s") < low), F.count_if(F.col("s").between(low, high))).first()
        if inside == before:
            # Few different values: they are counted, not listed.
            break
    seen = 0
    found = []
    for value, n in band.groupBy("s").count().orderBy("s").toLocalIterator():
        seen += n
        found += [value] * ((below + seen >= k) + (below + seen >= k + 1) - len(found))
        if len(found) == 2:
            break
    return sum(found) / 2


def fit(rows: DataFrame, ridge: float = RIDGE) -> Ranking:
    """The ranking of labelled features (doc_id, good, x), which are read many times.

    All rows are compared, in blocks; the blocks' slopes are added up for each of Newton's steps. Without labels, or
    with labels of one kind only, there is nothing to compare: every score is 0.5.
    """
    size = len(NAMES)
    at = [F.get("x", F.lit(i)) for i in range(size)]
    known = rows.agg(F.count_if("good"), F.count_if(~F.col("good")), F.array(*[F.stddev_pop(x) for x in at])).first()
    n_good, n_bad, spread = known
    if not n_good or not n_bad:
        return Ranking(np.zeros(size), 0.0)
    scale = np.array(spread) + 1e-9
    rounds = max(ROUNDS, PAIRS // max(n_good, n_bad))
    packed = written(_blocks(rows, n_good, n_bad), "ranking-blocks")
    weights = np.zeros(size)
    for _ in range(30):
        n, slope, bend = _slopes(packed, weights, scale, rounds)
        step = np.linalg.solve(bend / n + ridge * np.eye(size), slope / n + ridge * weights)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    weights = weights / scale
    strengths = written(rows.select(sum((x * float(w) for x, w in zip(at, weights)), F.lit(0.0)).alias("s")), "ranking-strengths")
    # Between the last that is below the quantile and the first above it.
    threshold = _between(strengths, n_bad, n_good + n_bad)
    discard(packed, strengths)
    return Ranking(weights, float(threshold))


def remainder(doc_id):
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def learn(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Fit on all labelled documents whose id's remainder is not 1.

    Labels with a null id or quality are ignored. Ids repeated in ``docs`` count once; an id
    with two labels counts with each. Texts stay where they are; only their features meet the labels.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .where(remainder(F.col("doc_id")) != 1)
        .select("doc_id", (F.col("quality") == 1).alias("good"))
        .distinct()
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t).tolist() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(remainder(F.col("doc_id")) != 1)
    found = mine.mapInArrow(text_batches(run), "doc_id long, x array<double>").join(chosen, "doc_id")
    rows = written(found.groupBy("doc_id", "good").agg(F.min("x").alias("x")), "ranking-features")
    ranking = fit(rows)
    discard(rows)
    return ranking


def score(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Null and repeated ids are kept (a null id is not held out); empty and null texts get a
    score; an empty table gives none.
    """
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = ranking.scores(np.array([features(t) for t in batch.column("text").to_pylist()]))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(scores, pa.float64()),
                pa.array((scores >= 0.5).astype(np.int32), pa.int32()),
            ],
            ["doc_id", "held_out", "score", "predicted"],
        )

    rows = docs.select(
        column(id_col).cast("long").alias("doc_id"),
        F.coalesce(remainder(column(id_col)) == 1, F.lit(False)).alias("held_out"),
        column(text_col).alias("text"),
    )
    return rows.mapInArrow(text_batches(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = ranking.scores(np.array([features(t) for t in batch.column("text").to_pylist()]))
        return batch.filter(pa.array(scores >= 0.5))

    return docs.mapInArrow(text_batches(run), docs.schema)
