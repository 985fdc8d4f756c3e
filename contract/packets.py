"""Packet captures written from events, as input for the capture reader."""

from __future__ import annotations

import ipaddress
import struct

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS_PER_FILE = 2000
# Link types: those of classic files, taking turns, and those of the interfaces of the others.
LINKS = (1, 0, 12, 101, 108, 113, 276)
FACES = (1, 0, 12, 101, 108, 113, 276, 228, 229)
HEADERS = {1: 14, 0: 4, 12: 0, 101: 0, 108: 4, 113: 16, 276: 20, 228: 0, 229: 0}
# The file that is cut off, and by how many bytes: the block behind the last packet, and the packet's end.
CUT_FILE, CUT = 1, 45
FLAG_BITS = {"F": 1, "S": 2, "R": 4, "P": 8, "A": 16}


def _transport(row) -> tuple[int, bytes]:
    if row.protocol == "TCP":
        bits = sum(FLAG_BITS[x] for x in row.tcp_flags or "")
        head = struct.pack(
            ">HHIIBBHHH", row.src_port, row.dst_port, row.k, row.k + 1, 0x50, bits, 1024, 0, 0
        )
        return 6, head
    if row.protocol == "udp":
        return 17, struct.pack(">HHHH", row.src_port, row.dst_port, 8 + row.k, 0)
    if row.protocol == "ICMP":
        return 1, struct.pack(">BBHI", 8, 0, 0, 0)
    return 47, struct.pack(">I", 0)


def payload(row) -> tuple[int, bytes]:
    """(type, packet) of a row; an event without target is no IP packet."""
    if row.dst_ip is None:
        return 0x0806, b"\0" * 28
    number, head = _transport(row)
    body = head + b"x" * row.k
    if ":" in row.dst_ip:
        source = ipaddress.ip_address(f"fd00::{row.user_id % 9999 + 1}").packed
        target = ipaddress.ip_address(row.dst_ip).packed
        ip = struct.pack(">IHBB", 6 << 28, len(body), number, 64) + source + target
        return 0x86DD, ip + body
    source, target = (ipaddress.ip_address(a).packed for a in (row.src_ip, row.dst_ip))
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, number, 0) + source + target
    return 0x0800, ip + body


def packet(row, link: int = 1, tags: int = 0) -> bytes:
    """The row's packet behind the header of its link, with VLAN tags on Ethernet."""
    kind, data = payload(row)
    if link == 1:
        head = b"\x02" * 12 + b"".join(struct.pack(">HH", 0x88A8 if t else 0x8100, t) for t in range(tags))
        return head + struct.pack(">H", kind) + data
    if link == 113:
        return b"\0" * 14 + struct.pack(">H", kind) + data
    if link == 276:
        return struct.pack(">H", kind) + b"\0" * 18 + data
    return (b"\0\0\0\2" if link in (0, 108) else b"") + data


def pcap(rows, link: int = 1) -> bytes:
    """A classic capture of the rows, little endian, microseconds."""
    out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)]
    for row in rows:
        data = packet(row, link, row.tags)
        out.append(struct.pack("<IIII", row.us // 1_000_000, row.us % 1_000_000, len(data), len(data)))
        out.append(data)
    return b"".join(out)


def block(kind: int, body: bytes) -> bytes:
    body += b"\0" * (-len(body) % 4)
    size = len(body) + 12
    return struct.pack(">II", kind, size) + body + struct.pack(">I", size)


def pcapng_of_all_links(rows) -> bytes:
    """A block-structured capture with an interface for each link type, packets in blocks of all kinds.

    The clocks tick in nanoseconds, and one interface is 10 seconds behind.
    """
    out = [block(0x0A0D0D0A, struct.pack(">IHHq", 0x1A2B3C4D, 1, 0, -1))]
    for link in FACES:
        behind = struct.pack(">HHq", 14, 8, 10) if link == 113 else b""
        out.append(block(1, struct.pack(">HHI", link, 0, 0) + struct.pack(">HHB3x", 9, 1, 9) + behind + b"\0" * 4))
    for row in rows:
        data = packet(row, row.link, row.tags)
        if row.block == 3:
            out.append(block(3, struct.pack(">I", len(data)) + data))
            continue
        stamp = (row.us - (10_000_000 if row.link == 113 else 0)) * 1000
        face = FACES.index(row.link)
        head = struct.pack(">HH", face, 0) if row.block == 2 else struct.pack(">I", face)
        head += struct.pack(">IIII", stamp >> 32, stamp & 0xFFFFFFFF, len(data), len(data))
        out.append(block(row.block, head + data))
        out.append(block(5, b"statistics, of no interest"))
    return b"".join(out)


def pcapng(rows) -> bytes:
    """The same as a block-structured capture, big endian, nanosecond clock."""
    out = [block(0x0A0D0D0A, struct.pack(">IHHq", 0x1A2B3C4D, 1, 0, -1))]
    out.append(block(1, struct.pack(">HHI", 1, 0, 65535) + struct.pack(">HHB3xHH", 9, 1, 9, 0, 0)))
    for row in rows:
        data = packet(row)
        stamp = row.us * 1000
        head = struct.pack(">IIIII", 0, stamp >> 32, stamp & 0xFFFFFFFF, len(data), len(data))
        out.append(block(6, head + data))
    return b"".join(out)


def _rows(pdf: pd.DataFrame):
    pdf = pdf.sort_values("event_id")
    pdf = pdf.astype(object).where(pdf.notna(), None)
    for row in pdf.itertuples(index=False):
        yield row._replace(
            **{
                f: (None if getattr(row, f) is None else int(getattr(row, f)))
                for f in ("k", "user_id", "us", "src_port", "dst_port", "link", "tags", "block")
            }
        )


def capture_files(rows: DataFrame) -> DataFrame:
    """(path, content): one capture per 2000 events, the formats taking turns."""

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        kind, encode = (("pcap", pcap), ("pcapng", pcapng))[number % 2]
        return pd.DataFrame({"path": [f"{number}.{kind}"], "content": [encode(_rows(pdf))]})

    numbered = rows.withColumn("file", F.floor(F.col("event_id") / EVENTS_PER_FILE))
    numbered = numbered.withColumns({c: F.lit(0) for c in ("link", "tags", "block")})
    return numbered.groupBy("file").applyInPandas(write, "path STRING, content BINARY")


def linked(rows: DataFrame) -> DataFrame:
    """Add file, link, tags and block: how :func:`capture_folder_files` writes each row."""
    file = F.floor(F.col("event_id") / EVENTS_PER_FILE)
    six = F.col("dst_ip").contains(":")
    face = F.element_at(F.array(*map(F.lit, FACES)), (F.col("event_id") % len(FACES) + 1).cast("int"))
    face = F.when(six & (face == 228), 229).when(~six & (face == 229), 228).otherwise(face)
    classic = F.element_at(F.array(*map(F.lit, LINKS)), (F.floor(file / 2) % len(LINKS) + 1).cast("int"))
    block = F.when(F.col("event_id") % 5 == 1, 2).when(F.col("event_id") % 5 == 2, 3).otherwise(6)
    rows = rows.withColumn("file", file).withColumn("block", F.when(file % 2 == 1, block).otherwise(0))
    link = F.when(F.col("block") == 3, FACES[0]).when(F.col("block") > 0, face).otherwise(classic)
    return rows.withColumn("link", link).withColumn("tags", (F.col("event_id") % 3).cast("int"))


def write_capture_folder(rows: DataFrame, folder: str) -> None:
    """Captures of all link types under ``folder``, one of them cut off, beside an empty and a foreign one."""

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        if number % 2:
            name, data = f"{number}.pcapng", pcapng_of_all_links(_rows(pdf))
        else:
            name, data = f"{number}.pcap", pcap(_rows(pdf), int(pdf["link"].iloc[0]))
        put(name, data[:-CUT] if number == CUT_FILE else data)
        return pd.DataFrame({"path": [name]})

    def put(name: str, data: bytes) -> None:
        path = folder.removeprefix("file:")
        store, inside = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(folder)
        store.create_dir(inside, recursive=True)
        # A retried task writes the same bytes.
        with store.open_output_stream(f"{inside}/{name}") as out:
            out.write(data)

    linked(rows).groupBy("file").applyInPandas(write, "path STRING").count()
    put("empty.pcap", b"")
    put("foreign.pcapng", b"This is no capture at all, whatever its name says.")
