"""The chain of records of a capture, and the places where it can be entered.

A record is only found from the one before it. One pass over the headers, with a buffer of
fixed size, notes every few megabytes where a record begins and what a reader has to know there:
byte order, interfaces, the last time. From such an entry the bytes up to the next one can be read
on their own.

The chain is followed until it ends or breaks; what is before the break counts, and the
reason is kept. Known are classic captures (micro- and nanoseconds, both byte orders) and
block-structured ones with their packet blocks 2, 3 and 6 and sections of either order.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

# Bytes between entries; bytes read at once by the pass; longer records mean a broken chain.
RANGE = 32 << 20
BUFFER = 4 << 20
LONGEST = 64 << 20

# Peek(at, n): the n bytes from place at on, fewer at the end.
Peek = Callable[[int, int], bytes]

# First bytes of a classic capture: byte order, fractions in a microsecond (fixed values).
CLASSIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1),
    b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000),
    b"\xa1\xb2\x3c\x4d": (">", 1000),
}
SECTION = b"\x0a\x0d\x0d\x0a"
INTERFACE, PACKET, SIMPLE, ENHANCED = 1, 2, 3, 6


class BrokenChain(ValueError):
    """No record can be read at this place."""


@dataclass(frozen=True)
class Face:
    """An interface: link type, ticks a second, seconds to add, and longest packet kept (0: any)."""

    link: int
    ticks: int = 1_000_000
    ahead: int = 0
    longest: int = 0


@dataclass(frozen=True)
class State:
    """What is known when a record begins: place, its number, byte order, interfaces, last time in us."""

    at: int
    number: int
    blocks: bool
    order: str
    faces: tuple[Face, ...] = field(default=())
    stamp: int = 0


# Place of the packet, its captured length, time in us, link type, number.
Record = tuple[int, int, int, int, int]


def begin(peek: Peek) -> State:
    """The state before the first record."""
    head = peek(0, 24)
    if not head:
        raise BrokenChain("empty file")
    if head[:4] == SECTION:
        return State(0, 0, True, "<")
    if head[:4] not in CLASSIC:
        raise BrokenChain("not a capture")
    if len(head) < 24:
        raise BrokenChain("cut off in the file header")
    order, per_us = CLASSIC[head[:4]]
    link = struct.unpack_from(order + "I", head, 20)[0] & 0xFFFF
    return State(24, 0, False, order, (Face(link, 1_000_000 * per_us),))


def _options(body: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            return
        yield code, body[at + 4 : at + 4 + size]
        at += 4 + (size + 3) // 4 * 4


def _face(body: bytes, order: str) -> Face:
    link, _, longest = struct.unpack_from(order + "HHI", body)
    ticks, ahead = 1_000_000, 0
    for code, value in _options(body[8:], order):
        if code == 9 and value:
            ticks = 2 ** (value[0] & 0x7F) if value[0] & 0x80 else 10 ** value[0]
        elif code == 14 and len(value) == 8:
            ahead = struct.unpack(order + "q", value)[0]
    return Face(link, ticks, ahead, longest)


def _classic(state: State, peek: Peek, size: int) -> tuple[State, Record]:
    head = peek(state.at, 16)
    if len(head) < 16:
        raise BrokenChain("cut off in a record header")
    seconds, fraction, caught, _ = struct.unpack(state.order + "IIII", head)
    body, face = state.at + 16, state.faces[0]
    _fits(body + caught, caught, size)
    stamp = seconds * 1_000_000 + fraction * 1_000_000 // face.ticks
    record = (body, caught, stamp, face.link, state.number)
    return State(body + caught, state.number + 1, False, state.order, state.faces, stamp), record


def _fits(end: int, length: int, size: int) -> None:
    if length > LONGEST:
        raise BrokenChain(f"a record of {length} bytes")
    if end > size:
        raise BrokenChain("cut off in a record")


def _block(state: State, peek: Peek, size: int) -> tuple[State, Record | None]:
    head = peek(state.at, 28)
    if len(head) < 12:
        raise BrokenChain("cut off in a block header")
    order, faces = state.order, state.faces
    if head[:4] == SECTION:
        order, faces = ("<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"), ()
    kind, length = struct.unpack_from(order + "II", head)
    if length < 12 or length % 4:
        raise BrokenChain(f"a block of {length} bytes")
    _fits(state.at + length, length, size)
    after = replace(state, at=state.at + length, order=order, faces=faces)
    if kind == INTERFACE:
        if length < 20:
            raise BrokenChain(f"an interface block of {length} bytes")
        return replace(after, faces=(*faces, _face(peek(state.at + 8, length - 12), order))), None
    if kind not in (PACKET, SIMPLE, ENHANCED):
        return after, None
    if length < (16 if kind == SIMPLE else 32):
        raise BrokenChain(f"a packet block of {length} bytes")
    if kind == SIMPLE:
        index, body = 0, state.at + 12
        caught = struct.unpack_from(order + "I", head, 8)[0]
    else:
        index = struct.unpack_from(order + ("H" if kind == PACKET else "I"), head, 8)[0]
        high, low, caught = struct.unpack_from(order + "III", head, 12)
        body = state.at + 28
    if index >= len(faces):
        raise BrokenChain("a packet of an unknown interface")
    face, stamp = faces[index], state.stamp
    if kind == SIMPLE:
        # It has no time of its own, and takes that of the packet before it.
        caught = min(caught, face.longest or caught, length - 16)
    else:
        stamp = ((high << 32) | low) * 1_000_000 // face.ticks + face.ahead * 1_000_000
    if body + caught + 4 > state.at + length:
        raise BrokenChain(f"a packet of {caught} bytes in a block of {length}")
    record = (body, caught, stamp, face.link, state.number)
    return replace(after, number=state.number + 1, stamp=stamp), record


def follow(state: State, peek: Peek, end: int) -> Iterator[tuple[State, Record | None]]:
    """(state after it, record) of the records from ``state`` on; raises BrokenChain where they break."""
    step = _block if state.blocks else _classic
    while state.at < end:
        state, record = step(state, peek, end)
        yield state, record


def entries(peek: Peek, size: int, every: int = RANGE) -> Iterator[tuple[State, int, str | None]]:
    """(state, end, None) of byte ranges that hold whole records; if the chain breaks, last
    (state there, size, reason)."""
    state = State(0, 0, False, "<")
    try:
        state = first = begin(peek)
        for state, _ in follow(first, peek, size):
            if state.at - first.at >= every:
                yield first, state.at, None
                first = state
    except BrokenChain as broken:
        reason = str(broken)
        if state.at > 0 and state.at > first.at:
            yield first, state.at, None
        yield state, size, reason
        return
    if state.at > first.at:
        yield first, state.at, None


class Buffered:
    """Peeks into a seekable stream, reading ``BUFFER`` bytes at a time."""

    def __init__(self, stream, size: int):
        self.stream, self.size = stream, size
        self.begin, self.data = 0, b""

    def __call__(self, at: int, n: int) -> bytes:
        start = at - self.begin
        if start < 0 or start + n > len(self.data):
            self.stream.seek(min(at, self.size))
            self.begin, self.data = at, self.stream.read(max(n, BUFFER))
            start = 0
        return self.data[start : start + n]
