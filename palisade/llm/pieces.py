"""Splitting texts into the pieces that a tokenizer encodes on its own, many texts at a time.

Both public vocabularies cut a text by character class first and encode each piece alone.
Here the cut is done with NumPy on the code points of a whole batch. Equal pieces of a
batch are found by a 64-bit hash, compared in full, and encoded once; the ids are then laid out in
order by gathering. A cache of arrays, bounded in bytes, keeps the pieces of earlier batches by their code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cache

import numpy as np
import regex

# Code points above Unicode's: the end of a text, and the first special token.
END = 0x110000
SPECIAL = END + 1
LETTER, NUMBER, SPACE, OTHER, STOP, MARK = 1, 2, 3, 4, 0, 5
# Code points handled at once; bytes of pieces remembered, and the longest of them.
CHUNK = 1 << 19
REMEMBERED = 64 << 20
LONG = 1024
# Code points that hashes are prepared for.
USUAL = 1 << 20

# White space as the tokenizers' regular expressions see it (fixed values).
WHITE = "\t\n\x0b\f\r \x85\xa0  -     　"

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@cache
def classes() -> np.ndarray:
    """The class of every code point; the end of a text and special tokens included."""
    table = np.full(END + 64, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(END) if not 0xD800 <= c < 0xE000)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (f"[{WHITE}]+", SPACE)):
        for found in regex.finditer(pattern, every):
            table[ord(found[0][0]) : ord(found[0][-1]) + 1] = kind
    table[0xD800:0xE000] = OTHER
    table[END] = STOP
    table[SPECIAL:] = MARK
    return table


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for usual sizes are kept."""
    return _usual_powers() if n <= USUAL else _new_powers(n)


@cache
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _new_powers(USUAL)


def _new_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(n, np.uint64)
    up, down = ones * _BASE, ones * _INVERSE
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _contractions(points: np.ndarray, begins: np.ndarray, at: np.ndarray) -> None:
    """Cut English contractions ('s 't 'm 'd 're 've 'll) off at the apostrophes ``at``."""
    if not at.size:
        return
    padded = np.concatenate([points, np.full(3, END, points.dtype)])
    first, second = padded[at + 1], padded[at + 2]
    one = np.isin(first, [ord(c) for c in "stmd"])
    two = np.zeros(at.size, bool)
    for pair in ("re", "ve", "ll"):
        two |= (first == ord(pair[0])) & (second == ord(pair[1]))
    for found, size in ((at[one], 1), (at[two], 2)):
        begins[found + 1] = False
        after = found + 1 + size
        after = after[after < points.size]
        # What follows starts a piece, unless it is what no piece starts with.
        begins[after[classes()[points[after]] != STOP]] = True


def cut_with_spaces(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the pieces of byte-level BPE: a space goes with what follows it."""
    kind = classes()[points]
    before = np.concatenate([[STOP], kind[:-1]])
    after = np.concatenate([kind[1:], [STOP]])
    space = kind == SPACE
    word = (kind == LETTER) | (kind == NUMBER) | (kind == OTHER)
    blank_before = np.concatenate([[False], points[:-1] == 32])
    begins = word & (kind != before) & ~blank_before
    begins |= space & ((before != SPACE) | ((after != SPACE) & (after != STOP) & (after != MARK)))
    begins |= kind == MARK
    quote = np.flatnonzero((points == 39) & begins & ~space)
    _contractions(points, begins, quote)
    return _ends(begins, kind, kind == STOP)


def cut_words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the pieces of word BPE: white space separates and is dropped."""
    kind = classes()[points]
    before = np.concatenate([[STOP], kind[:-1]])
    begins = (((kind == LETTER) | (kind == OTHER)) & (kind != before)) | (kind == NUMBER) | (kind == MARK)
    _contractions(points, begins, np.flatnonzero((points == 39) & begins))
    begins &= kind != SPACE
    return _ends(begins, kind, (kind == STOP) | (kind == SPACE))


def _ends(begins: np.ndarray, kind: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A piece ends where the next begins, or at the first code point that no piece has."""
    first = np.flatnonzero(begins)
    stops = np.flatnonzero(begins | (outside & ~np.concatenate([[True], outside[:-1]])))
    end = np.append(stops, kind.size)[np.searchsorted(stops, first, side="right")]
    return first, end


def hashes(points: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every piece."""
    up, down = _powers(points.size)
    sums = np.zeros(points.size + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: points.size], out=sums[1:])
    value = (sums[end] - sums[first]) * down[first]
    value ^= (end - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    return value * np.uint64(0xD6E8FEB86659FD93)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of ranges that begin at ``first``, one range after the other."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(first - before, size)


def _equal(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the ranges ``at`` of two arrays have equal numbers."""
    size = np.where(at, size, 0)
    differ = a[_ranges(a_first, size)] != b[_ranges(b_first, size)]
    if differ.any():
        at[np.repeat(np.arange(at.size), size)[differ]] = False
    return at


def classes_of(
    points: np.ndarray, first: np.ndarray, end: np.ndarray, value: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(a piece of each class, the class of every piece); pieces of a class are equal.

    Hashes bring equal pieces together, and every piece is then compared with its class's
    example, code point by code point. Those that only share its hash get classes of their own.
    """
    value = hashes(points, first, end) if value is None else value
    _, example, which = np.unique(value, return_index=True, return_inverse=True)
    size = end - first
    like = example[which]
    same = _equal(points, first, points, first[like], size, size == size[like])
    if not same.all():
        more: dict[bytes, int] = {}
        extra = []
        for i in np.flatnonzero(~same).tolist():
            piece = points[first[i] : end[i]].tobytes()
            if piece not in more:
                more[piece] = example.size + len(extra)
                extra.append(i)
            which[i] = more[piece]
        example = np.concatenate([example, extra])
    return example, which


def parts(text: str, size: int = CHUNK) -> Iterable[str]:
    """The text in parts of about ``size`` characters, cut before a lone space between words:
    no piece crosses such a place."""
    at = 0
    while len(text) - at > size:
        found = _LONE.search(text, at + size)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


_LONE = regex.compile(r"\S(?= \S)")


class _Lists:
    """Lists of numbers, one after the other. The buffers grow by a quarter, so that adding costs little."""

    def __init__(self):
        self.flat = np.zeros(0, np.uint32)
        self.bounds = np.zeros(1, np.int32)
        self.count = 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        used, count = int(self.bounds[self.count]), self.count + sizes.size
        self.flat = _grown(self.flat, used, used + flat.size)
        self.bounds = _grown(self.bounds, self.count + 1, count + 1)
        self.flat[used : used + flat.size] = flat
        self.bounds[self.count + 1 : count + 1] = used + np.cumsum(sizes)
        self.count = count

    def sizes(self, at: np.ndarray) -> np.ndarray:
        return (self.bounds[at + 1] - self.bounds[at]).astype(np.int64)


def _grown(array: np.ndarray, used: int, needed: int) -> np.ndarray:
    if needed <= array.size:
        return array
    out = np.empty(needed + needed // 4, array.dtype)
    out[:used] = array[:used]
    return out


class _Generation:
    """Pieces with their ids, found by their hashes, which lie in order. One piece a hash."""

    def __init__(self):
        self.value, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.pieces, self.ids = _Lists(), _Lists()

    def held(self) -> int:
        arrays = self.value, self.place, self.pieces.flat, self.pieces.bounds, self.ids.flat, self.ids.bounds
        return sum(a.nbytes for a in arrays)

    def find(self, points: np.ndarray, first: np.ndarray, size: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The place of every piece, compared code point by code point; -1 if it is not here."""
        if not self.value.size:
            return np.full(first.size, -1, np.int32)
        at = np.minimum(np.searchsorted(self.value, value), self.value.size - 1)
        place = self.place[at]
        same = (self.value[at] == value) & (self.pieces.sizes(place) == size)
        same = _equal(points, first, self.pieces.flat, self.pieces.bounds[place].astype(np.int64), size, same)
        return np.where(same, place, -1)

    def add(self, pieces: np.ndarray, sizes: np.ndarray, value: np.ndarray, ids: np.ndarray, n_ids: np.ndarray) -> None:
        place = np.arange(self.pieces.count, self.pieces.count + value.size, dtype=np.int32)
        self.pieces.add(pieces, sizes)
        self.ids.add(ids, n_ids)
        order = np.argsort(value, kind="stable")
        value, place = value[order], place[order]
        at = np.searchsorted(self.value, value)
        self.value, self.place = np.insert(self.value, at, value), np.insert(self.place, at, place)

    def new_to(self, value: np.ndarray) -> np.ndarray:
        """Whether a hash is not here yet; of equal ones the first is."""
        out = np.zeros(value.size, bool)
        out[np.unique(value, return_index=True)[1]] = True
        if self.value.size:
            at = np.minimum(np.searchsorted(self.value, value), self.value.size - 1)
            out &= self.value[at] != value
        return out


class _Known:
    """The ids of pieces met before, in arrays; about ``REMEMBERED`` bytes of them at most.

    There are two generations. A full one becomes the old one, which is dropped when the next is full; what is
    met again moves to the new one, so frequent pieces stay.
    """

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.new, self.old = _Generation(), _Generation()

    def ids(
        self, points: np.ndarray, first: np.ndarray, size: np.ndarray, value: np.ndarray, encode: Callable
    ) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of different pieces, one after the other, the number of each); ``encode`` gives lists of those
        of the pieces at some indices, which are not remembered."""
        count = np.zeros(first.size, np.int64)
        unknown = np.ones(first.size, bool)
        found = []
        for generation in (self.new, self.old):
            rest = np.flatnonzero(unknown)
            place = generation.find(points, first[rest], size[rest], value[rest])
            here, place = rest[place >= 0], place[place >= 0]
            count[here] = generation.ids.sizes(place)
            unknown[here] = False
            found.append((here, generation.ids.flat, generation.ids.bounds[place].astype(np.int64)))
        add = np.ones(first.size, bool)
        add[found[0][0]] = False
        rest = np.flatnonzero(unknown)
        made = encode(rest)
        count[rest] = np.fromiter(map(len, made), np.int64, len(made))
        made = np.fromiter((x for ids in made for x in ids), np.uint32, int(count[rest].sum()))
        found.append((rest, made, np.cumsum(count[rest]) - count[rest]))
        start = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.uint32)
        for here, flat, begin in found:
            out[_ranges(start[here], count[here])] = flat[_ranges(begin, count[here])]
        add &= 4 * size <= LONG
        self._add(points, first, size, value, out, start, count, np.flatnonzero(add))
        return out, count

    def _add(self, points, first, size, value, ids, start, count, at) -> None:
        at = at[self.new.new_to(value[at])]
        if not at.size:
            return
        if self.new.value.size and self.new.held() + 20 * at.size + 4 * int((size[at] + count[at]).sum()) > REMEMBERED // 2:
            self.old, self.new = self.new, _Generation()
        self.new.add(points[_ranges(first[at], size[at])], size[at], value[at], ids[_ranges(start[at], count[at])], count[at])


class Encoder:
    """Encodes whole texts with a vocabulary that encodes one piece at a time.

    ``encode_piece`` returns a piece's ids; ``cut`` is one of the two cuts above;
    ``normalise`` is applied to what lies between special tokens, whose strings are looked
    for first.
    """

    def __init__(
        self,
        cut: Callable,
        encode_piece: Callable[[str], list[int]],
        special: dict[str, int],
        normalise: Callable[[str], str] | None = None,
    ):
        self.cut, self.encode_piece, self.normalise = cut, encode_piece, normalise
        self.special = special
        names = sorted(special, key=len, reverse=True)
        self.marks = {name: chr(0xE000 + i) for i, name in enumerate(names)}
        self.by_mark = [[special[name]] for name in names]
        self.split = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.known = _Known()

    def _points(self, text: str) -> list[np.ndarray]:
        def plain(s: str) -> np.ndarray:
            return np.frombuffer((self.normalise(s) if self.normalise else s).encode("utf-32-le"), np.uint32)

        if self.split is None or "<" not in text:
            return [plain(text)]
        out, at = [], 0
        for found in self.split.finditer(text):
            out.append(plain(text[at : found.start()]))
            # Ends the text before it: the cuts see each part between special tokens alone.
            out.append(np.array([END, SPECIAL + ord(self.marks[found[0]]) - 0xE000, END], np.uint32))
            at = found.end()
        return [*out, plain(text[at:])]

    def _ids(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first code point of each piece, number of ids before each piece)."""
        first, end = self.cut(points)
        if not first.size:
            return np.zeros(0, np.uint32), first, np.zeros(1, np.int64)
        value = hashes(points, first, end)
        example, which = classes_of(points, first, end, value)
        begin, size = first[example], (end - first)[example]

        def encode(at: np.ndarray) -> list[list[int]]:
            some, ends = points[_ranges(begin[at], size[at])], np.cumsum(size[at])
            special = some >= SPECIAL
            text = np.where(special, 0, some).astype(np.uint32).tobytes().decode("utf-32-le")
            out = []
            for a, b, mark in zip((ends - size[at]).tolist(), ends.tolist(), special[ends - size[at]].tolist()):
                out.append(self.by_mark[some[a] - SPECIAL] if mark else self.encode_piece(text[a:b]))
            return out

        found, sizes = self.known.ids(points, begin, size, value[example], encode)
        starts = np.cumsum(sizes) - sizes
        count = sizes[which]
        before = np.concatenate([[0], np.cumsum(count)])
        return found[_ranges(starts[which], count)], first, before

    def forget(self) -> None:
        """Drop what is remembered."""
        self.known.forget()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every text; a null text has none."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, list[np.ndarray]]] = []
        size = 0

        def work() -> None:
            nonlocal size
            pieces, bounds, at = [], [], 0
            for doc, arrays in waiting:
                bounds.append((doc, at))
                for a in arrays:
                    pieces.append(a)
                    at += a.size
                pieces.append(np.array([END], np.uint32))
                at += 1
            ids, first, before = self._ids(np.concatenate(pieces))
            cuts = before[np.searchsorted(first, [b for _, b in bounds])]
            for (doc, _), a, b in zip(bounds, cuts, [*cuts[1:], before[-1]]):
                out[doc].append(ids[a:b])
            waiting.clear()
            size = 0

        for i, text in enumerate(texts):
            for part in parts(text or ""):
                arrays = self._points(part)
                waiting.append((i, arrays))
                size += sum(a.size for a in arrays)
                if size >= CHUNK:
                    work()
        if waiting:
            work()
        return [a[0] if len(a) == 1 else np.concatenate(a) for a in out]


@cache
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, extra = [""] * 256, 256
    for b in plain:
        letters[b] = chr(b)
    for b in range(256):
        if not letters[b]:
            letters[b] = chr(extra)
            extra += 1
    return letters
