"""Benchmark passages in documents, found by latent semantic retrieval.

The benchmark is a stated query set; it is taken in blocks of ``ITEMS`` items, and each block
is held against all documents:

1. Words of the block are its vocabulary. Documents are read once and become rows of word
   numbers (none for words the block does not have), which all later passes read instead of
   the texts. The same pass counts in how many stretches of 32 words each word occurs; the
   inverse frequencies cover all documents.
2. The passages are the windows of two stretches, weighted by TF-IDF. A randomised SVD finds
   the space in which they vary most: passages are projected on random directions and the
   projections gathered back on the words, A'(A W), task by task, summed by word. An
   orthonormal basis of the sum spans their range; a small eigenproblem inside it gives the leading
   ``DIMENSIONS`` singular vectors, and the ``SPARE`` directions are cut off.
3. Passages and items are compared in the latent space, a matrix product for each batch. A
   passage is a candidate if its cosine with an item is high enough, and its component along
   the item is at least 0.4 of the item's length (an item may be embedded in other text).
4. Candidates are checked on their words. First the weights of the rare words that passage and
   item share are added up, for a whole batch at once. For those that share enough, the longest
   common subsequence of the item and the words around the passage, weighted by inverse
   frequency, must reach 0.6 of the item's weight. That lets
   paraphrases through in which some words were replaced, dropped or added. An item that has
   an answer (after its last question mark, or after "answer:") must have half of it matched.

Items of fewer than ``MIN_WORDS`` words leave no room for paraphrases and are sought word for word.

What is broadcast is bounded by the block: its vocabulary times the dimensions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import column, discard, release, small_batches, written
from palisade.llm.pieces import LETTER, NUMBER, classes, hashes, parts

ITEMS = 4000
STRETCH = 32
DIMENSIONS = 64
SPARE = 16
COSINE = 0.2
ALONG = 0.4
# Words rarer than this inverse frequency tell items apart; a share of them must be there.
RARE = 2.5
SHARED = 0.4
MATCH = 0.6
ANSWER = 0.5
MIN_WORDS = 5
SEED = 7
# Words that are projected at once (whole documents), and cells of a product of passages and items.
WORDS_AT_ONCE = 1 << 15
CELLS = 1 << 22

_ANSWER = re.compile(r".*(?:\?|\banswer\s*:)", re.I | re.S)


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words, runs of letters and digits in lower case."""
    found = []
    for part in parts((text or "").lower()):
        points = np.frombuffer((part + " ").encode("utf-32-le"), np.uint32)
        kind = classes()[points]
        inside = (kind == LETTER) | (kind == NUMBER)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        if edge.size:
            found.append(hashes(points, edge[0::2], edge[1::2]))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


@dataclass
class Block:
    """Items of the benchmark as numbers of their words."""

    ids: list[int]
    vocabulary: np.ndarray
    items: list[np.ndarray]
    answers: list[int]  # number of words before the answer; all words if there is none
    segments: list[tuple[int, np.ndarray]] = field(default_factory=list)
    # Items of fewer than MIN_WORDS words, found as they are.
    short: list[tuple[int, np.ndarray]] = field(default_factory=list)

    def number(self, words: np.ndarray) -> np.ndarray:
        """The vocabulary's number of each word, -1 if it has none."""
        if not self.vocabulary.size or not words.size:
            return np.full(words.size, -1, np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, words), self.vocabulary.size - 1)
        return np.where(self.vocabulary[at] == words, at, -1).astype(np.int32)


def make_block(rows: list[tuple[int, str | None]]) -> Block:
    """Items with fewer than ``MIN_WORDS`` words say too little to be recognised when they are altered: they must
    occur word for word. Items without words, null ones among them, are in no document."""
    every = [(i, words_of(t), t) for i, t in rows]
    every = [(i, w, t) for i, w, t in every if w.size]
    vocabulary = np.unique(np.concatenate([w for _, w, _ in every])) if every else np.zeros(0, np.uint64)
    hashed = [(i, w, t) for i, w, t in every if w.size >= MIN_WORDS]
    block = Block([i for i, _, _ in hashed], vocabulary, [], [])
    block.short = [(i, block.number(w)) for i, w, _ in every if w.size < MIN_WORDS]
    for k, (_, w, text) in enumerate(hashed):
        item = block.number(w)
        block.items.append(item)
        question = _ANSWER.match(text)
        before = words_of(question[0]).size if question else w.size
        block.answers.append(before)
        for begin in range(0, w.size, 2 * STRETCH):
            segment = item[begin : begin + 2 * STRETCH]
            if segment.size >= MIN_WORDS or not begin:
                block.segments.append((k, segment))
    return block


def _numbered(block: Block):
    """Documents as word numbers; last, the number of stretches with each word."""
    size = block.vocabulary.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            found, pairs, count = [], [], 0
            for text in batch.column("text").to_pylist():
                ids = block.number(words_of(text))
                known = np.flatnonzero(ids >= 0)
                pairs.append((count + known // STRETCH) * size + ids[known])
                count += -(-ids.size // STRETCH)
                found.append(ids.tobytes() if known.size else None)
            if pairs and size:
                seen[:size] += np.bincount(different(np.concatenate(pairs)) % size, minlength=size)
            seen[size] += count
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(found, pa.binary()), pa.nulls(len(found), pa.binary())],
                ["doc_id", "h", "ids", "seen"],
            )
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.tobytes()], pa.binary())],
            ["doc_id", "h", "ids", "seen"],
        )

    return run


def _sum_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for b in batch.column("seen").to_pylist():
            here = np.frombuffer(b, np.int64)
            total = here.copy() if total is None else total + here
    if total is not None:
        words = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array(total[words], pa.int64())], ["word", "n"])


def different(numbers: np.ndarray) -> np.ndarray:
    """The different numbers in their order. Sorting in place is faster here than ``np.unique``."""
    numbers = np.sort(numbers)
    return numbers[np.concatenate([[True], numbers[1:] != numbers[:-1]])[: numbers.size]]


@dataclass
class Passages:
    """Some documents of a batch laid out in stretches, and their windows of two (one, if a document has only one)."""

    docs: list[np.ndarray]
    begin: int  # the first document's place in the batch

    def __post_init__(self):
        sizes = np.array([ids.size for ids in self.docs])
        stretches = -(-sizes // STRETCH)
        windows = np.maximum(stretches - 1, 1)
        first = np.cumsum(stretches) - stretches
        ids = np.concatenate(self.docs)
        known = np.flatnonzero(ids >= 0)
        doc = np.repeat(np.arange(sizes.size), sizes)[known]
        self.word = ids[known]
        # The stretch of each known word, and of each stretch the windows that begin with it and before it (-1: none).
        self.stretch = first[doc] + (known - (np.cumsum(sizes) - sizes)[doc]) // STRETCH
        owner = np.repeat(np.arange(sizes.size), stretches)
        place = np.arange(owner.size) - first[owner]
        start = np.cumsum(windows) - windows
        self.here = start[owner] + np.minimum(place, windows[owner] - 1)
        self.before = np.where((place > 0) & (place < windows[owner]), start[owner] + place - 1, -1)
        self.opens = np.flatnonzero(place < windows[owner])
        self.pairs = np.flatnonzero(stretches[owner[self.opens]] > 1)
        self.doc = self.begin + owner[self.opens]
        self.place = place[self.opens]

    def windows(self, vectors: np.ndarray) -> np.ndarray:
        """The sum of the words' vectors over every window."""
        sums = np.zeros((self.here.size, vectors.shape[1]), vectors.dtype)
        first = np.flatnonzero(np.concatenate([[True], self.stretch[1:] != self.stretch[:-1]]))
        sums[self.stretch[first]] = np.add.reduceat(vectors.take(self.word, axis=0), first, axis=0)
        out = sums[self.opens]
        out[self.pairs] += sums[self.opens[self.pairs] + 1]
        return out


def _passages(rows: list[bytes]) -> Iterator[Passages]:
    """The documents of a batch, as many at once as have some ``WORDS_AT_ONCE`` words."""
    docs, size = [], 0
    for i, b in enumerate(rows):
        docs.append(np.frombuffer(b, np.int32))
        size += docs[-1].size
        if size >= WORDS_AT_ONCE or i + 1 == len(rows):
            yield Passages(docs, i + 1 - len(docs))
            docs, size = [], 0


def _gathered(idf: np.ndarray, directions: np.ndarray):
    """A'(A W) over the passages of a task, one row a word."""
    # The last column is the square of the passage's length.
    weighted = np.concatenate([directions * idf[:, None], (idf**2)[:, None]], axis=1).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(directions.shape)
        for batch in batches:
            for some in _passages(batch.column("ids").to_pylist()):
                image = some.windows(weighted)
                # Passages count alike, whatever their length.
                image = image[:, :-1] / np.maximum(image[:, -1:], 1e-6)
                # A word is in the window that begins with its stretch and in the one before.
                back = image[some.here]
                twice = np.flatnonzero(some.before >= 0)
                back[twice] += image[some.before[twice]]
                order = np.argsort(some.word, kind="stable")
                word = some.word[order]
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                total[word[first]] += np.add.reduceat(back.take(some.stretch[order], axis=0), first, axis=0)
        total *= idf[:, None]
        used = np.flatnonzero(total.any(axis=1))
        if used.size:
            flat = pa.array(total[used].reshape(-1).astype(np.float32))
            vectors = pa.ListArray.from_arrays(np.arange(used.size + 1, dtype=np.int32) * total.shape[1], flat)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), vectors], ["word", "v"])

    return run


def common_weight(item: np.ndarray, words: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weight of the longest common subsequence of ``words`` with every prefix of ``item``."""
    best = np.zeros(words.size + 1)
    out = np.zeros(item.size)
    for k, word in enumerate(item.tolist()):
        step = best.copy()
        hit = np.flatnonzero(words == word)
        step[hit + 1] = np.maximum(step[hit + 1], best[hit] + weight[word])
        best = np.maximum.accumulate(step)
        out[k] = best[-1]
    return out


def match_score(block: Block, k: int, words: np.ndarray, weight: np.ndarray) -> float:
    """Share of item ``k`` that ``words`` have in order; 0 if its answer is not among it."""
    item = block.items[k]
    whole = weight[item].sum()
    common = common_weight(item, words, weight)
    cut = block.answers[k]
    if 0 < cut < item.size:
        answer = common_weight(item[cut:], words, weight)[-1]
        if answer < ANSWER * weight[item[cut:]].sum():
            return 0.0
    return float(common[-1] / max(whole, 1e-9))


@dataclass
class Postings:
    """For every word the segments that it tells apart, as flat arrays."""

    start: np.ndarray
    count: np.ndarray
    segment: np.ndarray
    weight: np.ndarray
    needed: np.ndarray

    def shared(self, window: np.ndarray, word: np.ndarray, windows: int) -> np.ndarray:
        """Whether each of the windows and each segment share enough, of different (window, word) pairs."""
        n = self.count[word]
        before = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(self.start[word] - before, n)
        pair = np.repeat(window * self.needed.size, n) + self.segment[at]
        total = np.bincount(pair, weights=np.repeat(self.weight[word], n), minlength=windows * self.needed.size)
        return total.reshape(windows, -1) >= self.needed


def make_postings(block: Block, weight: np.ndarray, idf: np.ndarray) -> Postings:
    """A segment is told apart by its rare words, or by all if those are the smaller part of it."""
    words, segments = [], []
    needed = np.zeros(len(block.segments))
    for s, (_, segment) in enumerate(block.segments):
        own = np.unique(segment)
        rare = own[idf[own] > RARE]
        if 2 * weight[rare].sum() < weight[own].sum():
            rare = own
        words.append(rare)
        segments.append(np.full(rare.size, s))
        needed[s] = SHARED * weight[rare].sum()
    word, segment = np.concatenate(words), np.concatenate(segments)
    order = np.argsort(word, kind="stable")
    count = np.bincount(word, minlength=weight.size)
    return Postings(np.cumsum(count) - count, count, segment[order], weight, needed)


def _found_as_is(short: dict[int, list[tuple[int, np.ndarray]]], opens: np.ndarray, ids: np.ndarray) -> set[int]:
    """The short items that occur word for word, by their first words; ``opens`` tells which words are one."""
    out = set()
    for at in np.flatnonzero(opens[ids]).tolist():
        for item, words in short[int(ids[at])]:
            if item not in out and np.array_equal(ids[at : at + words.size], words):
                out.add(item)
    return out


def _short_hits(block: Block):
    by_first: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item, words in block.short:
        by_first.setdefault(int(words[0]), []).append((item, words))
    # The last place stands for -1, a word that no item has.
    opens = np.zeros(block.vocabulary.size + 1, bool)
    opens[list(by_first)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "h", "ids")]
            rows = [
                (doc_id, h, item, 1.0)
                for doc_id, h, b in zip(*columns)
                for item in _found_as_is(by_first, opens, np.frombuffer(b, np.int32))
            ]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "h", "item_id", "score"])

    return run


def _hits(block: Block, idf: np.ndarray, basis: np.ndarray):
    vectors = (basis * idf[:, None]).astype(np.float32)
    # Common words count a little, so that an item of common words has a weight too.
    weight = idf + 0.1
    queries = np.stack([vectors[s].sum(axis=0) for _, s in block.segments])
    length = np.linalg.norm(queries, axis=1)
    owner = np.array([k for k, _ in block.segments])
    postings = make_postings(block, weight, idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("ids").to_pylist()
            found: dict[tuple[int, int], float] = {}
            for some in _passages(rows):
                image = some.windows(vectors)
                length_of = np.linalg.norm(image, axis=1) + 1e-9
                word = some.word.astype(np.int64)
                # A stretch is in the window that begins with it and in the one before.
                before = some.before[some.stretch]
                again = np.flatnonzero(before >= 0)
                pair = [some.here[some.stretch] * idf.size + word, before[again] * idf.size + word[again]]
                pair = different(np.concatenate(pair))
                window, word = pair // idf.size, pair % idf.size
                step = max(1, CELLS // length.size)
                for begin in range(0, some.doc.size, step):
                    end = min(begin + step, some.doc.size)
                    product = image[begin:end] @ queries.T
                    good = product >= ALONG * (length**2)[None, :]
                    good &= product >= COSINE * length_of[begin:end][:, None] * length[None, :]
                    a, z = np.searchsorted(window, [begin, end])
                    good &= postings.shared(window[a:z] - begin, word[a:z], end - begin)
                    for w, q in np.argwhere(good).tolist():
                        at, k = some.place[begin + w] * STRETCH, int(owner[q])
                        doc = int(some.doc[begin + w])
                        ids = some.docs[doc - some.begin]
                        n = block.items[k].size
                        around = ids[max(0, at - n) : at + 2 * STRETCH + n]
                        # Words that the item does not have can't be in a common subsequence.
                        around = around[np.isin(around, block.items[k])]
                        if weight[around].sum() < MATCH * weight[block.items[k]].sum():
                            continue
                        score = match_score(block, k, around, weight)
                        if score >= MATCH and score > found.get((doc, k), 0):
                            found[doc, k] = score
            if found:
                ids, h = batch.column("doc_id").to_pylist(), batch.column("h").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i, _ in found], pa.int64()),
                        pa.array([h[i] for i, _ in found], pa.int64()),
                        pa.array([block.ids[k] for _, k in found], pa.int64()),
                        pa.array(list(found.values()), pa.float64()),
                    ],
                    ["doc_id", "h", "item_id", "score"],
                )

    return run


def latent_basis(passages: DataFrame, idf: np.ndarray, dimensions: int = DIMENSIONS, spare: int = SPARE) -> np.ndarray:
    """An orthonormal basis, words by dimensions, of where the TF-IDF passages A vary most.

    The range of A'A is found from its image of ``dimensions + spare`` random directions W. What A'A does inside
    that range, a small matrix, follows from the same image: Q'A'AW = (Q'A'AQ)(Q'W) on the range. Its leading
    eigenvectors are the singular vectors of A, and the spare dimensions are cut off.
    """
    width = min(idf.size, dimensions + spare)
    directions = np.random.default_rng(SEED).standard_normal((idf.size, width))
    rows = passages.mapInArrow(_gathered(idf, directions), "word int, v array<float>")
    sums = rows.groupBy("word").agg(F.array(*[F.sum(F.get("v", F.lit(d))) for d in range(width)]).alias("v")).toArrow()
    image = np.zeros((idf.size, width))
    if sums.num_rows:
        image[sums["word"].to_numpy()] = np.array(sums["v"].to_pylist())
    return leading(image + 1e-9 * directions, directions, dimensions)


def leading(image: np.ndarray, directions: np.ndarray, dimensions: int) -> np.ndarray:
    """The leading eigenvectors of a symmetric matrix, from its image of random directions."""
    found = np.linalg.qr(image)[0]
    inside = (found.T @ image) @ np.linalg.pinv(found.T @ directions)
    value, vector = np.linalg.eigh((inside + inside.T) / 2)
    return found @ vector[:, np.argsort(-value)[:dimensions]]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, items: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items, ``items`` at a time, so that no more than those are on the driver."""
    rows = benchmark.select(column(id_col).cast("long").alias("item_id"), column(text_col).alias("text"))
    block: list[tuple[int, str | None]] = []
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        if len(block) == items:
            yield block
            block = []
    if block:
        yield block


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    items: int = ITEMS,
) -> DataFrame:
    """(doc_id, h, item_id, score): documents that hold an item of the benchmark, and how much of it.

    ``h`` is the hash of the document's text. Equal rows give one result; items repeated in
    the benchmark give each theirs. Null and empty texts hold nothing; null ids are kept.
    Empty tables give none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = column(text_col)
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    out = spark.createDataFrame([], "doc_id long, h long, item_id long, score double")
    for some in _blocks(benchmark, item_col, item_text_col, items):
        block = make_block(some)
        if not block.items and not block.short:
            continue
        numbered = rows.mapInArrow(_numbered(block), "doc_id long, h long, ids binary, seen binary")
        numbered = written(numbered, "leaks-words")
        passages = numbered.where("ids is not null").select("doc_id", "h", "ids")
        if block.short:
            found = passages.mapInArrow(_short_hits(block), "doc_id long, h long, item_id long, score double")
            out = out.unionAll(written(found, "leaks-short"))
        if not block.items:
            discard(numbered)
            continue
        counts = numbered.where("seen is not null").select("seen").mapInArrow(_sum_seen, "word int, n long")
        counts = counts.groupBy("word").agg(F.sum("n").alias("n")).toArrow()
        size = block.vocabulary.size
        seen = np.zeros(size + 1)
        if counts.num_rows:
            seen[counts["word"].to_numpy()] = counts["n"].to_numpy()
        idf = np.log((seen[size] + 1) / (seen[:size] + 1))
        basis = latent_basis(passages.select("ids"), idf)
        found = passages.mapInArrow(_hits(block, idf, basis), "doc_id long, h long, item_id long, score double")
        found = found.groupBy("doc_id", "h", "item_id").agg(F.max("score").alias("score"))
        out = out.unionAll(written(found, "leaks-found"))
        discard(numbered)
        release(spark)
    return out


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score), one row a pair."""
    found = leaks(docs, benchmark)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all their columns, that hold no item."""
    found = written(leaks(docs, benchmark).select("doc_id", "h").distinct(), "leaks-documents")
    # The document is one struct, so its columns clash with nothing.
    whole = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("doc"))
    match = F.col("doc.doc_id").cast("long").eqNullSafe(found["doc_id"]) & (F.xxhash64("doc.text") == found["h"])
    return whole.join(found, match, "left_anti").select("doc.*")
