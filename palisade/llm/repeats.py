"""Exact repeated strings across all documents, by prefix doubling over sparse positions.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Prefix
doubling ranks positions by ever longer strings and drops those whose rank is unique. Ranking
every byte would move some twenty bytes for each byte of text in every round, so the
positions are thinned first, without losing any:

- Every window of LENGTH bytes has an anchor, the least 16-byte string in it (by a hash; the
  leftmost of equals). Equal windows have their anchor at the same distance x from their
  start. Neighbouring windows share anchors: there is about one for every 190 bytes.
- An item is an anchor with a range of distances, so it stands for as many windows. The
  *core* is what all windows of its block of distances have in common, the *hull* what they
  cover together.

Each round ranks the items by the pair (core, hull), at growing lengths of the core: at least
145, 385 and LENGTH bytes. An item whose core is unique holds no repeated window and drops
out. An item that shares its hull with another is settled: all its windows are repeated. What
is left goes on with shorter ranges, hence longer cores, down to single windows. Settled
items go on too, one for each hull, as far as others with their core are unsettled. Ranks are
128-bit hashes of the strings, so equal strings on any machine have equal ranks.

The same serves passages of words: units are then words instead of bytes, anchors are strings of eight words,
and cores have at least 8, 44 and 51 of them. A passage counts if another document has it, so a round keeps two items of
different documents for each settled hull, and all items of the unsettled ones.

Groups are counted before the shuffle and joined back from a written table, so a string with
any number of copies is no bottleneck. Texts are shuffled twice: to fetch the surroundings
of unsettled items, and to cut the repeats out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import column, discard, release, small_batches, text_batches, written

# Windows of one document handled at once; rows sent to the JVM at once.
CHUNK = 1 << 18
ROWS = 20_000

_SCRAMBLE = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ITEM = "doc_id long, h long, a long, parent int, lo int, hi int, core binary, hull long"
_WHERE = ["doc_id", "h", "a", "lo", "hi"]


@dataclass(frozen=True)
class Unit:
    """What strings are made of, and how long the repeated ones are.

    ``gram`` units make an anchor's string; ``blocks`` are the ranges of distances of the rounds, the last single windows;
    ``across``: whether another string must be in another document. Rows equal in id and text are one document then.
    """

    length: int
    gram: int
    blocks: tuple[int, int, int]
    words: bool = False
    across: bool = False

    def cut(self, text: str | None) -> tuple[bytes, np.ndarray, list[int] | None]:
        """(bytes, a number of each unit, where units begin and the last ends; None if every byte is one)."""
        data = (text or "").encode()
        if not self.words:
            return data, _SCRAMBLE[np.frombuffer(data, np.uint8)], None
        data, edges = _spaced(data)
        if not data:
            return data, np.zeros(0, np.uint64), [0]
        # Letters times the number of their place in the word, added up: equal for equal words.
        letters = np.frombuffer(data, np.uint8)
        value = _SCRAMBLE[letters]
        value[edges[1:-1] - 1] = 0
        place = np.arange(letters.size) - np.repeat(edges[:-1], np.diff(edges))[: letters.size]
        value *= _SCRAMBLE[place & 255]
        return data, np.add.reduceat(value, edges[:-1]), edges.tolist()

    def bytes_and_edges(self, text: str | None) -> tuple[bytes, list[int] | None]:
        """The same without the numbers."""
        data = (text or "").encode()
        if not self.words:
            return data, None
        data, edges = _spaced(data)
        return data, edges.tolist()

    def edges(self, data: bytes) -> list[int] | None:
        return _spaced(data)[1].tolist() if self.words else None


_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def _spaced(data: bytes) -> tuple[bytes, np.ndarray]:
    """The words joined by one space; where they begin, and the end as if one more space followed."""
    letters = np.frombuffer(data, np.uint8)
    blank = _BLANK[letters]
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank behind a word stands for all
    letters = np.where(blank, np.uint8(32), letters)[keep]
    if letters.size and letters[-1] == 32:
        letters = letters[:-1]
    if not letters.size:
        return b"", np.zeros(1, np.int64)
    edges = np.concatenate([[0], np.flatnonzero(letters == 32) + 1, [letters.size + 1]])
    return letters.tobytes(), edges


def _part(data: bytes, edges: list[int] | None, begin: int, end: int) -> bytes:
    """The units from begin to before end."""
    return data[begin:end] if edges is None else data[edges[begin] : edges[end] - 1]


LENGTH = 400
WORDS = 51


def bytes_of(length: int = LENGTH) -> Unit:
    """Strings of so many bytes that start anywhere else too."""
    return Unit(length, 16, (256, 16, 1))


def passages_of(words: int = WORDS) -> Unit:
    """Passages of so many words that another document has too."""
    return Unit(words, 8, (64, 8, 1), True, True)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    n = values.size - width + 1
    padded = np.full(-(-values.size // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: values.size] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(
    values: np.ndarray, sizes: np.ndarray, unit: Unit = bytes_of()
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, anchor, least distance, largest distance) of runs of windows that share an anchor.

    ``values`` are the units of documents of the given sizes, one after the other; anchors are places in their document.
    """
    length, gram = unit.length, unit.gram
    ends = np.cumsum(sizes)
    for begin in range(0, values.size - length + 1, CHUNK):
        end = min(begin + CHUNK, values.size - length + 1)
        starts = np.arange(begin, end)
        doc = np.searchsorted(ends, starts, side="right")
        starts = starts[ends[doc] - starts >= length]  # those that cross no border
        if not starts.size:
            continue
        value = values[begin : end + length - 1]
        span = 1
        while span < gram:
            value = value[:-span] + value[span:] * np.uint64(pow(int(_STEP), span, 1 << 64))
            span *= 2
        value = value ^ (value >> np.uint64(29))
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value &= np.uint64(0xFFFFFFFF00000000)
        value |= np.arange(value.size, dtype=np.uint64)
        at = (_sliding_least(value, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64) + begin
        at = at[starts - begin]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        last = np.append(first[1:], at.size) - 1
        a = at[first]
        doc = np.searchsorted(ends, a, side="right")
        yield doc, a - (ends[doc] - sizes[doc]), a - starts[last], a - starts[first]


def split_ranges(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """The ranges cut where a block of distances begins, with the index of where each came from."""
    pieces = hi // block - lo // block + 1
    source = np.repeat(np.arange(a.size), pieces)
    number = np.arange(source.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = (lo[source] // block + number) * block
    return source, a[source], np.maximum(lo[source], start), np.minimum(hi[source], start + block - 1)


def ranks(
    data: bytes, edges: list[int] | None, shift: int, a: list[int], lo: list[int], hi: list[int], block: int, unit: Unit
) -> tuple[list[bytes], list[int]]:
    """(core, hull) of every item; ``data`` begins ``shift`` units after the document does."""
    cores, hulls = [], []
    length = unit.length
    core_of, hull_of, top = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest, length - unit.gram
    for at, least, most in zip(a, lo, hi):
        begin = least // block * block
        end = min(begin + block - 1, top)
        at -= shift
        cores.append(core_of(_part(data, edges, at - begin, at - end + length), begin))
        hull = hull_of(_part(data, edges, at - most, at - least + length), least << 16 | most)
        hulls.append(hull - (1 << 64) if hull >> 63 else hull)
    return cores, hulls


def _rows(doc_ids: list, hs: list, a, parent, lo, hi, cores: list, hulls: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_ids, pa.int64()),
            pa.array(hs, pa.int64()),
            pa.array(a, pa.int64()),
            pa.array(parent, pa.int32()),
            pa.array(lo, pa.int32()),
            pa.array(hi, pa.int32()),
            pa.array(cores, pa.binary()),
            pa.array(hulls, pa.int64()),
        ],
        ["doc_id", "h", "a", "parent", "lo", "hi", "core", "hull"],
    )


class _Out:
    """Columns of items, sent on when there are enough."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in range(8)]

    def add(self, *columns: list) -> None:
        for to, more in zip(self.columns, columns):
            to += more

    def full(self, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
        if len(self.columns[0]) >= rows:
            yield _rows(*self.columns)
            self.columns = [[] for _ in range(8)]


def _first_items(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out()
        block = unit.blocks[0]
        for batch in batches:
            doc_ids, hs = batch.column("doc_id").to_pylist(), batch.column("h").to_pylist()
            cut = [unit.cut(text) for text in batch.column("text").to_pylist()]
            sizes = np.array([values.size for _, values, _ in cut])
            values = np.concatenate([values for _, values, _ in cut])
            for doc, *found in anchors(values, sizes, unit):
                source, a, lo, hi = split_ranges(*found, block)
                doc = doc[source]
                edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])).tolist()
                a, lo, hi = a.tolist(), lo.tolist(), hi.tolist()
                for begin, end in zip(edges, edges[1:]):
                    k, n = int(doc[begin]), end - begin
                    own = a[begin:end], lo[begin:end], hi[begin:end]
                    ranked = ranks(cut[k][0], cut[k][2], 0, *own, block, unit)
                    out.add([doc_ids[k]] * n, [hs[k]] * n, own[0], own[1], own[1], own[2], *ranked)
                yield from out.full()
        yield from out.full(1)

    return run


def _surroundings(unit: Unit):
    """The units that the windows of each item cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data, edges = unit.bytes_and_edges(r["text"])
                items = r["items"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["doc_id"]] * len(items), pa.int64()),
                        pa.array([r["h"]] * len(items), pa.int64()),
                        pa.array([i["a"] for i in items], pa.int64()),
                        pa.array([i["lo"] for i in items], pa.int32()),
                        pa.array([i["hi"] for i in items], pa.int32()),
                        pa.array([_part(data, edges, i["a"] - i["hi"], i["a"] - i["lo"] + unit.length) for i in items], pa.binary()),
                    ],
                    [*_WHERE, "data"],
                )

    return run


def _next_items(block: int, unit: Unit):
    """Items with shorter ranges, from surroundings and the ranges ``parts`` to go on with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out()
        for batch in batches:
            for r in batch.to_pylist():
                ranges = np.array([(p["lo"], p["hi"]) for p in r["parts"]], np.int64)
                at = np.full(len(ranges), r["a"], np.int64)
                _, a, lo, hi = split_ranges(at, ranges[:, 0], ranges[:, 1], block)
                a, lo, hi = a.tolist(), lo.tolist(), hi.tolist()
                n = len(a)
                found = ranks(r["data"], unit.edges(r["data"]), r["a"] - r["hi"], a, lo, hi, block, unit)
                out.add([r["doc_id"]] * n, [r["h"]] * n, a, [r["lo"]] * n, lo, hi, *found)
                yield from out.full()
        yield from out.full(1)

    return run


def _ranked(items: DataFrame, unit: Unit, go_on: bool) -> tuple[DataFrame, DataFrame | None]:
    """(repeated spans, items to go on with) of one round."""
    spark = items.sparkSession
    items = written(items, "repeats-items")
    who = F.xxhash64("doc_id", "h")
    # Repeated: by any other item, or by one of another document.
    several = F.min(who) != F.max(who) if unit.across else F.count("*") > 1
    twice = written(items.groupBy("core").agg(several.alias("yes")).where("yes").select("core"), "repeats-cores")
    alive = written(items.join(twice, "core", "left_semi"), "repeats-alive")
    discard(items, twice)
    release(spark)
    item = F.struct("doc_id", "h", "a", "parent", "lo", "hi")
    some = [F.min(item).alias("one")]
    if unit.across:
        # Of two documents, so that an item of either meets another one.
        one = F.struct(who.alias("who"), item.alias("item"))
        some = [F.min(one)["item"].alias("one"), F.max(one)["item"].alias("other")]
    classes = written(alive.groupBy("core", "hull").agg(several.alias("settled"), *some), "repeats-ranks")
    shared = classes.where("settled").select("core", "hull")
    spans = alive.join(shared, ["core", "hull"], "left_semi").select(
        "doc_id", "h", (F.col("a") - F.col("hi")).alias("start"), (F.col("a") - F.col("lo") + unit.length).alias("end")
    )
    spans = written(spans.distinct(), "repeats-spans")
    if not go_on:
        discard(alive, classes)
        return spans, None
    mixed = written(classes.where("not settled").select("core").distinct(), "repeats-mixed")
    rest = classes.join(mixed, "core", "left_semi")
    if unit.across:
        open_ = classes.where("not settled").select("core", "hull")
        open_ = alive.join(open_, ["core", "hull"], "left_semi").select("doc_id", "h", "a", "parent", "lo", "hi")
        both = rest.where("settled").select(F.explode(F.array("one", "other")).alias("i")).select("i.*")
        rest = both.unionByName(open_)
    else:
        rest = rest.select("one.*")
    rest = written(rest, "repeats-rest")
    discard(alive, classes, mixed)
    release(spark)
    return spans, rest


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    out = left["doc_id"].eqNullSafe(right["doc_id"])
    for name in names:
        out &= left[name] == right[name]
    return out


def repeated_spans(rows: DataFrame, unit: Unit = bytes_of()) -> DataFrame:
    """(doc_id, h, spans) of (doc_id, h, text): the places of strings that start elsewhere too.

    ``h`` is the hash of the text; rows equal in both are alike and share one result, in
    which the spans, (start, end) in units, may overlap. Only documents with spans appear.
    """
    first = rows.mapInArrow(_first_items(unit), _ITEM)
    found, rest = _ranked(first, unit, True)

    lists = rest.groupBy("doc_id", "h").agg(F.collect_list(F.struct("a", "lo", "hi")).alias("items"))
    lists = written(lists, "repeats-lists")
    texts = rows.join(lists, _same(rows, lists, ["h"])).select(rows["doc_id"], rows["h"], "text", "items")
    surroundings = texts.mapInArrow(
        _surroundings(unit), "doc_id long, h long, a long, lo int, hi int, data binary"
    )
    around = written(surroundings.groupBy(*_WHERE).agg(F.first("data").alias("data")), "repeats-around")
    discard(rest, lists)
    release(rows.sparkSession)

    whole = around.withColumn("parts", F.array(F.struct("lo", "hi")))
    more, rest = _ranked(whole.mapInArrow(_next_items(unit.blocks[1], unit), _ITEM), unit, True)

    parts = rest.groupBy("doc_id", "h", "a", "parent").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    parts = written(parts.withColumnRenamed("parent", "lo"), "repeats-parts")
    single = around.join(parts, _same(around, parts, ["h", "a", "lo"])).select(
        *[around[c] for c in [*_WHERE, "data"]], "parts"
    )
    last, _ = _ranked(single.mapInArrow(_next_items(unit.blocks[2], unit), _ITEM), unit, False)
    every = found.unionAll(more).unionAll(last).distinct()
    spans = every.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = written(spans, "repeats-by-document")
    discard(around, rest, parts, found, more, last)
    release(rows.sparkSession)
    return spans


def merged_lists(lists: pa.ListArray) -> list[list[tuple[int, int]]]:
    """For each list of (start, end) its maximal runs; none for a null."""
    values, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(lists))]
    if not len(values):
        return out
    owner = np.repeat(np.arange(sizes.size), sizes)
    start, end = (values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
    # Lists are laid apart, so that one running maximum serves all.
    apart = owner * (int(end.max()) + 2)
    order = np.argsort(start + apart, kind="stable")
    owner, start, end = owner[order], (start + apart)[order], np.maximum.accumulate((end + apart)[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    last = np.append(first[1:], start.size) - 1
    shift = owner[first] * (int(values.field("end").to_numpy(zero_copy_only=False).max()) + 2)
    for k, a, b in zip(owner[first].tolist(), (start[first] - shift).tolist(), (end[last] - shift).tolist()):
        out[k].append((a, b))
    return out


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The bytes outside the runs."""
    if not runs:
        return data
    edges = [0, *(x for run in runs for x in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2]))


def without_words(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without the runs of words; a run takes along the white space before it, at the start that after it."""
    found = list(_WORD.finditer(data))
    out, at = [], 0
    for begin, end in runs:
        first = found[begin - 1].end() if begin else 0
        out.append(data[at:first])
        at = found[end - 1].end() if begin else (found[end].start() if end < len(found) else len(data))
    return b"".join([*out, data[at:]])


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        column(id_col).cast("long").alias("doc_id"), F.xxhash64(column(text_col)).alias("h"), column(text_col).alias("text")
    )


def repeat_report(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_words) of every document.

    Texts are UTF-8 bytes, a null text is empty; texts shorter than ``length`` have no
    repeats. Documents are told apart by id and text, so null and repeated ids are no
    matter, and rows repeated as a whole are copies of each other. An empty table gives none.
    ``passage_words`` counts the words in passages of ``words`` words that a document with another id or text has
    too, and ``n_passages`` the maximal runs of them; nothing is removed for those.
    """
    small_batches(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, bytes_of(length))
    passages = repeated_spans(rows, passages_of(words))
    both = spans.select("doc_id", "h", "spans", F.lit(None).cast(spans.schema["spans"].dataType).alias("passages")).unionByName(
        passages.select("doc_id", "h", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), F.col("spans").alias("passages"))
    )
    # One row of each kind a document at most.
    both = both.groupBy("doc_id", "h").agg(F.first("spans", True).alias("spans"), F.first("passages", True).alias("passages"))
    found = written(both, "repeats-found")
    discard(spans, passages)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        spans, passages = merged_lists(batch.column("spans")), merged_lists(batch.column("passages"))
        for text, runs, shared in zip(batch.column("text").to_pylist(), spans, passages):
            data = (text or "").encode()
            kept = without(data, runs)
            out.append((
                len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(),
                len(shared), sum(b - a for a, b in shared),
            ))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_words"]
        arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])

    joined = rows.join(found, _same(rows, found, ["h"]), "left").select(rows["doc_id"], "text", "spans", "passages")
    return joined.mapInArrow(
        text_batches(run),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long",
    )


def remove_repeats(docs: DataFrame, unit: Unit = bytes_of()) -> DataFrame:
    """The documents, all their columns, with the repeats cut out of ``text`` and ``n_chars`` to fit.

    Every document stays, if with an empty text. Of bytes, characters of which a run took a part go as
    a whole. Of words, the gap before a run goes with it. A null text stays null. Columns of the same names as those used here
    are kept like any other.
    """
    small_batches(docs.sparkSession)
    spans = repeated_spans(_keyed(docs, "doc_id", "text"), unit)
    names, schema = docs.columns, docs.schema
    # The document travels as one struct, so its columns clash with nothing.
    whole = docs.select(F.struct(*[column(c) for c in names]).alias("doc"))
    match = F.col("doc.doc_id").cast("long").eqNullSafe(spans["doc_id"]) & (F.xxhash64("doc.text") == spans["h"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        arrays = dict(zip(names, batch.column("doc").flatten()))
        lists = merged_lists(batch.column("spans"))
        texts = arrays["text"].to_pylist()
        for i, runs in enumerate(lists):
            if runs:
                cut = without_words if unit.words else without
                texts[i] = cut(texts[i].encode(), runs).decode(errors="ignore")
        arrays["text"] = pa.array(texts, arrays["text"].type)
        if "n_chars" in arrays:
            counts = arrays["n_chars"].to_pylist()
            counts = [len(t) if c else n for t, c, n in zip(texts, lists, counts)]
            arrays["n_chars"] = pa.array(counts, arrays["n_chars"].type)
        return pa.RecordBatch.from_arrays([arrays[c] for c in names], names)

    joined = whole.join(spans, match, "left").select("doc", "spans")
    return joined.mapInArrow(text_batches(run), schema)
