"""Packet captures (pcap and pcapng) to network events.

1. Spark lists the files. One task a file follows its records' headers with a small buffer and
   writes down byte ranges that begin and end with whole records (``capture_chain.py``). Broken, foreign
   and empty files break nothing: what can't be read is a row of :func:`capture_errors`.
2. Ranges, not files, are dealt to tasks. Each reads its bytes and decodes them: the walk along the
   chain is a loop, header fields are cut out of the whole buffer at once, and everything after
   that is ordinary columns.

Ranges need a store that Arrow's file systems open (a shared folder, HDFS, S3, GCS). On any other,
Spark reads files whole, of up to 2 GB each.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from itertools import islice
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.network import protocol_name
from palisade.session import written
from palisade.sources.capture_chain import RANGE, BrokenChain, Buffered, Face, Peek, State, begin, entries, follow
from palisade.sources.common import numbered, to_event_schema

PACKET_DDL = (
    "path STRING, packet_no LONG, ts_us LONG, length LONG, ip_version INT, proto INT, ttl INT,"
    " ip_len INT, src_ip STRING, dst_ip STRING, transport STRING, src_port INT, dst_port INT,"
    " tcp_flags INT, seq LONG, ack LONG, window INT, udp_len INT, icmp_type INT, icmp_code INT"
)
INDEX_DDL = (
    "path STRING, size LONG, start LONG, end LONG, first_no LONG, blocks BOOLEAN, byte_order STRING,"
    " links ARRAY<INT>, ticks ARRAY<STRING>, ahead ARRAY<LONG>, longest ARRAY<LONG>, stamp LONG, error STRING"
)
BATCH = 50_000
# Parts that ranges are dealt to, at most.
PARTS = 20_000
IPV6_EXTENSIONS = (0, 43, 60)
# Stores that Arrow opens, by the scheme of a path.
STORES = ("file", "hdfs", "s3", "s3a", "gs")

# Link types (fixed values).
ETHERNET, COOKED, COOKED_2 = 1, 113, 276
NULL, LOOP = 0, 108
BARE = (12, 14, 101, 228, 229)
VLAN = (0x8100, 0x88A8, 0x9100)


def _names(addresses: np.ndarray) -> np.ndarray:
    """Text form of packed addresses, each distinct one formatted once."""
    packed = addresses.view(f"S{addresses.shape[1]}").ravel() if len(addresses) else []
    # A fixed-width bytes view drops trailing zeros; pad them back.
    width = addresses.shape[1]
    distinct, where = np.unique(packed, return_inverse=True)
    text = [str(ipaddress.ip_address(bytes(d).ljust(width, b"\0"))) for d in distinct]
    return np.array(text, dtype=object)[where] if text else np.array([], dtype=object)


class _Fields:
    """Big-endian fields of many packets at once; reads past the end give 0."""

    def __init__(self, data: bytes):
        self.bytes = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(64, np.uint8)])
        self.last = len(self.bytes) - 64

    def take(self, at: np.ndarray, size: int) -> np.ndarray:
        start = np.minimum(at, self.last)
        return np.ascontiguousarray(self.bytes[start[:, None] + np.arange(size)])

    def number(self, at: np.ndarray, size: int) -> np.ndarray:
        cells = self.take(at, size).astype(np.int64)
        out = np.zeros(len(at), np.int64)
        for i in range(size):
            out = (out << 8) | cells[:, i]
        return out


def _network_start(f: _Fields, at: np.ndarray, link: np.ndarray):
    """Offset of the IP header and the IP version (0: not IP)."""
    start, kind = at.copy(), np.zeros(len(at), np.int64)
    # Where the payload begins, and where its type is told.
    for name, payload, told in ((ETHERNET, 14, 12), (COOKED, 16, 14), (COOKED_2, 20, 0)):
        mine = link == name
        if mine.any():
            start = np.where(mine, at + payload, start)
            kind = np.where(mine, f.number(at + told, 2), kind)
    while (tagged := np.isin(kind, VLAN)).any():
        # A tag: two bytes, and the type of what follows.
        kind = np.where(tagged, f.number(start + 2, 2), kind)
        start = np.where(tagged, start + 4, start)
    # A length instead of a type: the type is behind six bytes that say so.
    named = (kind > 0) & (kind <= 1500) & (f.number(start, 6) == 0xAAAA03000000)
    if named.any():
        kind = np.where(named, f.number(start + 6, 2), kind)
        start = np.where(named, start + 8, start)
    version = np.where(kind == 0x0800, 4, np.where(kind == 0x86DD, 6, 0))
    family = np.isin(link, (NULL, LOOP))
    start = np.where(family, at + 4, start)
    nibble = f.number(start, 1) >> 4
    bare = (family | np.isin(link, BARE)) & np.isin(nibble, (4, 6))
    return start, np.where(bare, nibble, version)


def _packets(path: str, state: State, data: bytes, first: int = 0) -> Iterator[pd.DataFrame]:
    """Header fields of the IP packets of ``data``, which begins at byte ``first`` of the capture, in batches."""
    fields = _Fields(data)

    def peek(at: int, n: int) -> bytes:
        return data[at - first : at - first + n]

    def records():
        try:
            for _, record in follow(state, peek, first + len(data)):
                if record:
                    yield record
        except BrokenChain:
            return

    chain = records()
    while rows := list(islice(chain, BATCH)):
        at, caught, stamp, link, number = (np.array(c, dtype=np.int64) for c in zip(*rows))
        yield _decode_batch(path, fields, at - first, caught, stamp, link, number)


def decode_packets(path: str, data: bytes) -> Iterator[pd.DataFrame]:
    """Header fields of the IP packets of one capture, in batches; none if it is no capture."""
    try:
        state = begin(lambda at, n: data[at : at + n])
    except BrokenChain:
        return
    yield from _packets(path, state, data)


def _decode_batch(path, f, at, caught, stamp, link, numbers) -> pd.DataFrame:
    start, version = _network_start(f, at, link)
    keep = version > 0
    at, caught, stamp, numbers = at[keep], caught[keep], stamp[keep], numbers[keep]
    start, version = start[keep], version[keep]
    end = at + caught
    v4 = version == 4
    proto = np.where(v4, f.number(start + 9, 1), f.number(start + 6, 1))
    body = np.where(v4, start + 4 * (f.number(start, 1) & 15), start + 40)
    first_proto = proto.copy()
    for _ in range(8):
        extended = ~v4 & np.isin(proto, IPV6_EXTENSIONS)
        if not extended.any():
            break
        proto, body = (
            np.where(extended, f.number(body, 1), proto),
            np.where(extended, body + 8 * (f.number(body + 1, 1) + 1), body),
        )
    whole = ~v4 | ((f.number(start + 6, 2) & 0x1FFF) == 0)
    tcp = whole & (proto == 6) & (body + 20 <= end)
    udp = whole & (proto == 17) & (body + 8 <= end)
    icmp = whole & v4 & (proto == 1) & (body + 4 <= end)
    src = np.empty(len(at), dtype=object)
    dst = np.empty(len(at), dtype=object)
    for mask, offset, size in ((v4, 12, 4), (~v4, 8, 16)):
        if mask.any():
            src[mask] = _names(f.take(start[mask] + offset, size))
            dst[mask] = _names(f.take(start[mask] + offset + size, size))
    transport = np.where(tcp, "TCP", np.where(udp, "UDP", np.where(icmp, "ICMP", "")))

    def only(mask: np.ndarray, values: np.ndarray) -> pd.Series:
        return pd.Series(values, dtype="Int64").where(pd.Series(mask))

    ports = tcp | udp
    return pd.DataFrame(
        {
            "path": path,
            "packet_no": numbers,
            "ts_us": stamp,
            "length": caught,
            "ip_version": version,
            "proto": first_proto,
            "ttl": np.where(v4, f.number(start + 8, 1), f.number(start + 7, 1)),
            "ip_len": only(v4, f.number(start + 2, 2)),
            "src_ip": src,
            "dst_ip": dst,
            "transport": transport,
            "src_port": only(ports, f.number(body, 2)),
            "dst_port": only(ports, f.number(body + 2, 2)),
            "tcp_flags": only(tcp, f.number(body + 12, 2) & 0x1FF),
            "seq": only(tcp, f.number(body + 4, 4)),
            "ack": only(tcp, f.number(body + 8, 4)),
            "window": only(tcp, f.number(body + 14, 2)),
            "udp_len": only(udp, f.number(body + 4, 2)),
            "icmp_type": only(icmp, f.number(body, 1)),
            "icmp_code": only(icmp, f.number(body + 1, 1)),
        }
    )


def packets(files: DataFrame) -> DataFrame:
    """IP packets of (path, content) rows."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield from decode_packets(path, bytes(content))

    return files.select("path", "content").mapInPandas(decode, PACKET_DDL)


def _flag_text(bits: Column) -> Column:
    """Letters of the set flags, lowest bit first."""
    return F.concat(
        *[F.when(F.getbit(bits, F.lit(i)) == 1, x).otherwise("") for i, x in enumerate("FSRPAUECN")]
    )


def packet_events(decoded: DataFrame) -> DataFrame:
    """One network event per IP packet."""
    raw = F.to_json(
        F.struct(
            "ip_version",
            F.when(F.col("ip_version") == 4, F.col("ttl")).alias("ttl"),
            F.when(F.col("ip_version") == 6, F.col("ttl")).alias("hlim"),
            "ip_len",
            F.when(F.col("transport") == "TCP", _flag_text(F.col("tcp_flags"))).alias("tcp_flags"),
            "seq", "ack", "window", "udp_len", "icmp_type", "icmp_code",
        )
    )
    return to_event_schema(
        numbered(decoded).select(
            "event_id",
            F.timestamp_micros("ts_us").alias("timestamp"),
            F.lit("network").alias("event_type"),
            F.lit("pcap").alias("source"),
            "src_ip",
            "dst_ip",
            "src_port",
            "dst_port",
            F.when(F.col("transport") != "", F.col("transport"))
            .otherwise(protocol_name(F.col("proto")))
            .alias("protocol"),
            F.col("length").alias("bytes_sent"),
            F.lit(0).alias("bytes_received"),
            F.lit(1).alias("packets_sent"),
            F.lit(0).alias("packets_received"),
            raw.alias("raw_data"),
        )
    )


def _opened(path: str) -> pa.NativeFile:
    """The file at a path as Spark tells it: a scheme, and a name in which nothing is escaped."""
    scheme, name = path.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + name.lstrip("/"))
    host, inside = name.removeprefix("//").split("/", 1)
    store, root = fs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}://{host}/")
    return store.open_input_file(f"{root.rstrip('/')}/{inside}")


def _index_rows(path: str, peek: Peek, size: int, every: int) -> pd.DataFrame:
    rows = [
        (
            path, size, s.at, end, s.number, s.blocks, s.order, [f.link for f in s.faces], [str(f.ticks) for f in s.faces],
            [f.ahead for f in s.faces], [f.longest for f in s.faces], s.stamp, error,
        )
        for s, end, error in entries(peek, size, every)
    ]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX_DDL.split(", ")])


def _state(r: dict) -> State:
    faces = zip(r["links"], r["ticks"], r["ahead"], r["longest"])
    faces = tuple(Face(int(link), int(ticks), int(ahead), int(longest)) for link, ticks, ahead, longest in faces)
    return State(r["start"], r["first_no"], r["blocks"], r["byte_order"], faces, r["stamp"])


def _parts(spark: SparkSession, rows: int) -> int:
    return max(1, min(PARTS, rows, 4 * spark.sparkContext.defaultParallelism + rows // 4))


def capture_index(files: DataFrame, every: int = RANGE) -> DataFrame:
    """Byte ranges of (path, length) captures, about ``every`` bytes each, and a row with an
    ``error`` for each file whose chain of records breaks, telling where (``start``) and why."""

    def follow_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size in zip(batch["path"].tolist(), batch["length"].tolist()):
                try:
                    with _opened(path) as stream:
                        yield _index_rows(path, Buffered(stream, size), size, every)
                except OSError as error:
                    broken = {"path": path, "size": size, "start": 0, "end": size, "error": f"not readable: {error}"[:300]}
                    columns = [c.split()[0] for c in INDEX_DDL.split(", ")]
                    yield pd.DataFrame([broken], columns=columns).astype(object).replace({np.nan: None})

    spark = files.sparkSession
    files = written(files.select("path", "length"), "capture-files")
    dealt = files.repartition(_parts(spark, files.count()), "path")
    return written(dealt.mapInPandas(follow_files, INDEX_DDL), "capture-index")


def capture_errors(index: DataFrame) -> DataFrame:
    """(path, size, at, error): what could not be read from byte ``at`` on."""
    return index.where("error is not null").select("path", "size", F.col("start").alias("at"), "error")


def indexed_packets(index: DataFrame) -> DataFrame:
    """IP packets of the byte ranges of :func:`capture_index`, by range."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with _opened(r["path"]) as stream:
                    stream.seek(r["start"])
                    data = stream.read(r["end"] - r["start"])
                for found in _packets(r["path"], _state(r), data, r["start"]):
                    yield pa.RecordBatch.from_pandas(found, schema=_PACKET_ARROW, preserve_index=False)

    spark = index.sparkSession
    ranges = index.where("error is null")
    dealt = ranges.repartition(_parts(spark, ranges.count()), "path", "start").sortWithinPartitions("path", "start")
    return dealt.mapInArrow(decode, PACKET_DDL)


_KINDS = {"STRING": pa.string(), "LONG": pa.int64(), "INT": pa.int32()}
_PACKET_ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in PACKET_DDL.split(", "))])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{pcap,pcapng}")
        .option("recursiveFileLookup", "false")
        .load(path)
    )


def _empty_files(files: DataFrame, index: DataFrame) -> DataFrame:
    """Errors of the files of no bytes, which Spark lists but gives no rows of."""
    spark = files.sparkSession
    # Spark has the names of all files of a relation on the driver.
    names = [(re.sub("^file:/+", "file:/", unquote(name)),) for name in files.inputFiles()]
    listed = spark.createDataFrame(names, "path STRING")
    return listed.join(index.select("path").distinct(), "path", "left_anti").select(
        "path", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("at"), F.lit("empty file").alias("error")
    )


def read_packets(spark: SparkSession, path: str, every: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(IP packets, errors) of a capture file, or of all captures of a folder."""
    files = _files(spark, path)
    if all(name.split(":", 1)[0] in STORES for name in files.inputFiles()[:1]):
        index = capture_index(files, every)
        return indexed_packets(index), capture_errors(index).unionByName(_empty_files(files, index))

    def follow_contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                yield _index_rows(name, lambda at, n: data[at : at + n], len(data), every)

    index = written(files.select("path", "content").mapInPandas(follow_contents, INDEX_DDL), "capture-index")
    return packets(files), capture_errors(index).unionByName(_empty_files(files, index))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Events of a capture file, or of all captures of a folder."""
    return packet_events(read_packets(spark, path)[0])
