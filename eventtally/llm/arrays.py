"""Texts of an Arrow batch as numpy arrays: code points, words, hashes.

Everything here works on one slice of a batch at a time (`slices`), so the
memory of a task does not depend on how long its texts are, but for the longest.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
SLICE_BYTES = 512 << 10

#: The characters of Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

OTHER, LETTER, NUMBER, SPACE = range(4)


@functools.cache
def _trim():
    """glibc's call that returns freed memory to the system, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def _give_back() -> None:
    """Return what a batch needed: workers stay, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a piece have about `limit` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(ends):
            reach = (ends[at - 1] if at else 0) + limit
            upto = max(at + 1, int(np.searchsorted(ends, reach, "right")))
            yield batch.slice(at, upto - at)
            at = upto
        _give_back()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each text begins and the last ends; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    if raw is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def lead_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the characters beyond ASCII begin, and their code points."""
    at = np.flatnonzero(data >= 0xC0)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    byte = [padded[at + i].astype(np.int64) for i in range(4)]
    tail = [b & 0x3F for b in byte]
    two = (byte[0] & 0x1F) << 6 | tail[1]
    three = (byte[0] & 0x0F) << 12 | tail[1] << 6 | tail[2]
    four = (byte[0] & 0x07) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3]
    points = np.where(byte[0] < 0xE0, two, np.where(byte[0] < 0xF0, three, four))
    return at, np.minimum(points, 0x10FFFF)


def byte_classes(data: np.ndarray) -> np.ndarray:
    """For every byte the class of the character it belongs to."""
    table = classes()
    ascii_table = np.concatenate([table[:128], np.zeros(128, np.uint8)])
    kind = ascii_table[data]
    at, points = lead_points(data)
    found = table[points]
    kind[at] = found
    for extra, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        longer = at[data[at] >= least]
        inside = longer + extra < len(data)
        kind[(longer + extra)[inside]] = found[data[at] >= least][inside]
    return kind


@functools.cache
def classes() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE for every code point."""
    kinds = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        category = unicodedata.category(chr(point))[0]
        if category in "LN":
            kinds[point] = LETTER if category == "L" else NUMBER
    kinds[WHITE_SPACE] = SPACE
    return kinds


def pretokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes where the matches of public_tokenizers.PATTERN begin; they tile the texts.

    A run of letters, of numbers or of other signs is a match, with one blank
    before it; white space before such a run is a match without its last
    character; an apostrophe that begins a match takes s, t, m, d, re, ve or ll
    with it.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data)
    border = np.zeros(n + 3, bool)
    border[offsets] = True
    border[n:] = True
    start = border[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~border[1:n])
    begin = last
    for _ in range(3):
        begin = begin - ((data[begin] & 0xC0) == 0x80)
    start[begin] = True
    start[last[data[last] == 0x20] + 1] = False
    mark = np.flatnonzero(start & (data == 0x27))
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    mark = mark[~border[mark + 1]]
    one = mark[np.isin(padded[mark + 1], list(b"stmd"))]
    two = mark[~border[mark + 2]]
    pair = padded[two + 1].astype(np.int64) << 8 | padded[two + 2]
    two = two[np.isin(pair, [a << 8 | b for a, b in (b"re", b"ve", b"ll")])]
    for found, length in ((one, 2), (two, 3)):
        start[found + 1] = False
        after = found + length
        start[after[after < n]] = True
    return np.flatnonzero(start)


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of the runs of bytes that are `inside`, and how many each text has before it (and all)."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    after = np.concatenate([inside[1:], [False]]) if n else inside
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`spans` of the words, which blanks and the characters 9 to 13 part."""
    return spans(data, offsets, (data != 0x20) & ((data < 0x09) | (data > 0x0D)))


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number scattered (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd numbers that parts of a hash are scattered by.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[start:end].

    Words are taken in eight bytes at a time by two chains that are scattered at every step, so no
    sum over places can cancel out, as in a polynomial; their ends make the hash.
    """
    sizes = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    # The eight bytes from each place on.
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    one = mixed(sizes.astype(np.uint64) * np.uint64(BASES[0]))
    two = mixed(sizes.astype(np.uint64) * np.uint64(BASES[1]) + np.uint64(1))
    open_, at = np.arange(len(starts)), 0
    while len(open_):
        left = sizes[open_] - at
        taken = eight[starts[open_] + at]
        short = left < 8
        taken[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        one[open_] = mixed(one[open_] ^ taken)
        two[open_] = mixed(two[open_] * np.uint64(BASES[0]) + taken)
        open_, at = open_[left > 8], at + 8
    return mixed(one * np.uint64(BASES[1]) + two)


class Runs:
    """64-bit hashes of runs of `values`; equal runs hash alike wherever they stand.

    A run of 2^k values is hashed from its two halves; one of another length from the two runs
    of the largest such length that begin and end it, and its length.
    """

    def __init__(self, values: np.ndarray):
        self.levels = [values.astype(np.uint64, copy=False)]

    @staticmethod
    def _joined(one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return mixed(mixed(one) * np.uint64(BASES[0]) + other)

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            half, below = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(self._joined(below[: max(len(below) - half, 0)], below[half:]))
        return self.levels[k]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of values[start:end] for each pair; no run is empty."""
        sizes = ends - starts
        levels = np.frexp(sizes)[1] - 1
        found = np.zeros(len(sizes), np.uint64)
        for k in np.unique(levels).tolist():
            some = slice(None) if (levels == k).all() else levels == k
            level = self._level(k)
            both = self._joined(level[starts[some]], level[ends[some] - (1 << k)])
            found[some] = mixed(both + sizes[some].astype(np.uint64) * np.uint64(BASES[1]))
        return found


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each run of words first..last (which is not in it) its BLAKE2b digest, as two signed 64-bit numbers.

    Words are data[start:end] and have no blank in them; a run is its words with a blank between each two.
    """
    sizes = ends - starts
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    plain = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    plain[place + np.repeat(begins, sizes)] = data[place + np.repeat(starts, sizes)]
    view = memoryview(plain.tobytes())
    until = begins[last - 1] + sizes[last - 1]
    found = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(begins[first].tolist(), until.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
