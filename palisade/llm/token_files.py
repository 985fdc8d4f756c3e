"""Token ids on disk: Huffman-coded segments with checkpoints, in ascending document order.

Writing takes three steps, each leaving a table in the shared folder:

1. Documents are range-partitioned and sorted by (doc_id, checksum of the text) and encoded
   there. A partition also leaves its counts of ids.
2. The counts are added up (one row per id at most) and give one code for all.
3. Each partition's ids are coded in segments of whole documents, about a million ids each.

The files are Parquet, so Spark commits them whole or not at all. A row is a segment, numbered
by the place of its first document: its documents, their id counts, the bit stream, and the
bit offset of every 512th id, from which decoding can start. Reading needs the code lengths, which are kept beside the segments.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import column, release, scratch_path, small_batches
from palisade.llm.huffman import LIMIT, Code, code_lengths
from palisade.llm.pieces import Encoder, byte_letters, cut_with_spaces
from palisade.session import delete_path

SEGMENT = 1 << 20
END_ID = 2

_IDS = "doc_id long, ids binary, counts binary"
_SEGMENT = "part int, segment long, doc_ids array<long>, doc_tokens array<long>, n_ids long, bits binary, offsets binary"


def byte_vocabulary() -> str:
    """The installed file of the byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def load(path: str) -> tuple[Encoder, int]:
    """An encoder on the tokenizers library's model, and one more than the largest id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters = tokenizer.model, byte_letters()
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}

    def piece(text: str) -> list[int]:
        if text.isascii() and text.isprintable():  # the space alone has another letter
            mapped = text.replace(" ", letters[32])
        else:
            mapped = "".join([letters[b] for b in text.encode()])
        return [t.id for t in model.tokenize(mapped)]

    largest = max(tokenizer.get_vocab(with_added_tokens=True).values())
    return Encoder(cut_with_spaces, piece, special), largest + 1


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = load(path)
        size = max(size, end_id + 1)
        kind = np.uint16 if size <= 1 << 16 else np.uint32
        counts = np.zeros(size, np.int64)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows = []
            for ids in encoder.encode(batch.column("text").to_pylist()):
                ids = np.concatenate([ids, end])
                counts += np.bincount(ids, minlength=size)
                rows.append(ids.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, pa.binary()), pa.nulls(len(rows), pa.binary())],
                ["doc_id", "ids", "counts"],
            )
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())],
            ["doc_id", "ids", "counts"],
        )

    return run


def _segments(lengths: bytes, kind: str, target: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths, np.uint8))
        docs: list[int | None] = []
        arrays: list[np.ndarray] = []
        size, first, last = 0, 0, -2

        def row() -> pa.RecordBatch:
            ids = np.concatenate(arrays)
            bits, offsets = code.encode(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([first >> 33], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([[a.size for a in arrays]], pa.list_(pa.int64())),
                    pa.array([ids.size], pa.int64()),
                    pa.array([bits], pa.binary()),
                    pa.array([offsets.tobytes()], pa.binary()),
                ],
                ["part", "segment", "doc_ids", "doc_tokens", "n_ids", "bits", "offsets"],
            )

        for batch in batches:
            places, keys, ids = (batch.column(c).to_pylist() for c in ("place", "doc_id", "ids"))
            for p, d, b in zip(places, keys, ids):
                # A task may hold parts of several files, one after the other.
                if arrays and (p != last + 1 or size >= target):
                    yield row()
                    size, docs, arrays = 0, [], []
                if not arrays:
                    first = p
                last = p
                a = np.frombuffer(b, kind).astype(np.int64)
                docs.append(d)
                arrays.append(a)
                size += a.size
        if arrays:
            yield row()

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = END_ID,
    limit: int = LIMIT,
    segment: int = SEGMENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the ids of all documents under ``path``, in ascending order of the document id.

    Null ids come first; equal ids lie by the checksum of their text, and rows equal in both
    have the same ids, so their order makes no difference. A null text is empty and is still
    ended by ``end_id``. A document's ids stay in one segment, however many there are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ids_path = scratch_path(spark, "token-ids")
    text = column(text_col)
    laid = (
        docs.select(column(id_col).cast("long").alias("doc_id"), text.alias("text"))
        .withColumn("sum", F.xxhash64("text"))
        .withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange("doc_id", "sum", "tie")
        .sortWithinPartitions("doc_id", "sum", "tie")
    )
    encoded = laid.select("doc_id", "text").mapInArrow(_encode(vocabulary, end_id), _IDS)
    # The partition's number and the row's place in it, as they come out of the ordered task.
    encoded.withColumn("place", F.monotonically_increasing_id()).write.parquet(ids_path)
    del laid, encoded
    release(spark)

    stored = spark.read.parquet(ids_path)
    sizes = np.zeros(0, np.int64)
    counts = stored.where("counts is not null").select("counts").mapInArrow(_add_counts, "id int, n long")
    found = counts.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    if found.num_rows:
        sizes = np.zeros(max(found["id"].to_pylist()) + 1, np.int64)
        sizes[found["id"].to_numpy()] = found["n"].to_numpy()
    lengths = code_lengths(sizes, limit).tobytes()
    width = load(vocabulary)[1]
    kind = "<u2" if max(width, end_id + 1) <= 1 << 16 else "<u4"

    # Rows come out of a file in the order in which they were written, so nothing is sorted
    # or shuffled again.
    rows = stored.where("ids is not null").select("place", "doc_id", "ids")
    rows.mapInArrow(_segments(lengths, kind, segment), _SEGMENT).write.parquet(f"{path}/segments")
    spark.createDataFrame([(bytearray(lengths), limit)], "lengths binary, limit int").coalesce(1).write.parquet(
        f"{path}/code"
    )
    del rows, stored, counts
    delete_path(spark, ids_path)
    release(spark)


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for b in batch.column("counts").to_pylist():
            here = np.frombuffer(b, np.int64)
            total = here.copy() if total is None else total + here
    if total is not None:
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids], pa.int64())], ["id", "n"])


def _decoder(lengths: bytes, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for r in batch.to_pylist():
                ids = code.decode(r["bits"], np.frombuffer(r["offsets"], np.uint64), r["n_ids"])
                ids = ids.astype("<u4")
                end = np.cumsum(np.array(r["doc_tokens"], np.int64))
                start = end - np.array(r["doc_tokens"], np.int64)
                each = [ids[a:b].tobytes() for a, b in zip(start, end)]
                n = len(each)
                columns = [
                    pa.array([r["part"]] * n, pa.int32()),
                    pa.array([r["segment"]] * n, pa.int64()),
                    pa.array(r["doc_ids"], pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array(r["doc_tokens"], pa.int64()),
                    pa.array([zlib.crc32(b) for b in each], pa.int64()),
                ]
                names = ["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(each, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in files of :func:`write_tokens`.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian unsigned
    32-bit integers.
    """
    # A segment is about a megabyte, its ids several: few rows at a time.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    lengths = bytes(spark.read.parquet(f"{path}/code").first()["lengths"])
    segments = spark.read.parquet(f"{path}/segments")
    before = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    index = segments.select("part", "segment", "n_ids")
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row a partition.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    index = (
        index.withColumn("segment_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
        .join(parts, "part")
        .select("part", "segment", (F.col("part_start") + F.col("segment_start")).alias("segment_start"))
    )
    schema = "part int, segment long, doc_id long, inside long, n_tokens long, ids_crc32 long"
    docs = segments.mapInArrow(_decoder(lengths, with_ids), schema + (", ids binary" if with_ids else ""))
    return docs.join(index, ["part", "segment"]).select(
        "doc_id",
        (F.col("segment_start") + F.col("inside")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *(["ids"] if with_ids else []),
    )


def token_file_report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all documents into files in the shared folder, and report on what is read back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_tokens(docs, path, vocabulary)
    return read_tokens(spark, path, with_ids=False)
