"""BPE ids of whole texts by the merge automaton, and back.

One pass without a shuffle. The vocabulary file is a parameter and is read by each worker;
the compiled automaton stays in the worker for later batches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import column, small_batches, text_batches
from palisade.llm.merge_automaton import load


def word_vocabulary() -> str:
    """The installed file of the word-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))


def _with_ids(batch: pa.RecordBatch, ids: list[np.ndarray]) -> dict[str, pa.Array]:
    return {
        "doc_id": batch.column(0),
        "n_tokens": pa.array([a.size for a in ids], pa.int64()),
        "ids": pa.array([a.astype("<u4").tobytes() for a in ids], pa.binary()),
    }


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): the ids as little-endian unsigned 32-bit integers.

    A null or empty text has no ids; null and repeated doc_ids are kept as they are. Special
    tokens in a text are found as the library finds them; none are added.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(_with_ids(batch, load(path)[1].encode(batch.column(1).to_pylist())))

    return _rows(docs, id_col, text_col).mapInArrow(text_batches(run), "doc_id long, n_tokens long, ids binary")


def _decoded(batch: pa.RecordBatch, path: str) -> list[str]:
    automaton = load(path)[0]
    return [automaton.decode(np.frombuffer(b or b"", "<u4").tolist()) for b in batch.column("ids").to_pylist()]


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the labels of the ids; null ids give an empty text."""
    small_batches(rows.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(_decoded(batch, path), pa.string())], ["doc_id", "text"]
        )

    return rows.select("doc_id", "ids").mapInArrow(text_batches(run), "doc_id long, text string")


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): both in one pass, ``text`` decoded from the ids.

    One function does both: two in a row would be two workers a task, each with the automaton, and they stay.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton, encoder = load(path)
        ids = encoder.encode(batch.column(1).to_pylist())
        texts = pa.array([automaton.decode(a.tolist()) for a in ids], pa.string())
        return pa.RecordBatch.from_pydict(_with_ids(batch, ids) | {"text": texts})

    return _rows(docs, "doc_id", "text").mapInArrow(
        text_batches(run), "doc_id long, n_tokens long, ids binary, text string"
    )


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns: the digests of the ids and of the decoded text.

    The digests are taken where the ids are, so neither ids nor texts travel back to the JVM.
    """
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton, encoder = load(path)
        counts, of_ids, of_text = [], [], []
        for ids in encoder.encode(batch.column(1).to_pylist()):
            counts.append(ids.size)
            of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            of_text.append(hashlib.sha256(automaton.decode(ids.tolist()).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        text_batches(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
