"""Byte-pair merges of many words at once, as arrays."""

from __future__ import annotations

import base64
import functools
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from eventtally.llm import arrays


#: Words beyond this go one by one: the passes over all words take one for each merge that a word still has.
LONG_BYTES = 2_048


class Merges:
    """Which pairs of tokens merge, in which order, into what.

    `byte_ids` has the token of each byte; `keys` (first << 32 | second, sorted)
    has the pairs, `order` and `merged` belong to them.
    """

    def __init__(self, byte_ids: np.ndarray, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        at = np.argsort(keys)
        self.byte_ids = byte_ids
        self.keys = keys[at]
        self.order = np.array([o for o, _ in pairs.values()], np.int64)[at]
        self.merged = np.array([m for _, m in pairs.values()], np.int64)[at]
        # Hash tables of places in `keys`; each has what found its slot taken in the one before.
        self.tables: list[tuple[int, int, np.ndarray]] = []
        left = np.arange(len(keys))
        while len(left):
            factor, shift = arrays.BASES[len(self.tables) % 2] + 2 * len(self.tables), 64 - max(8, int(len(left)).bit_length() + 2)
            slots = np.full(1 << (64 - shift), -1, np.int32)
            slot = self._slot(self.keys[left], factor, shift)
            slots[slot] = left
            self.tables.append((factor, shift, slots))
            left = left[slots[slot] != left]

    @staticmethod
    def _slot(keys: np.ndarray, factor: int, shift: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(factor)) >> np.uint64(shift)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Place of each pair in `keys`, or -1."""
        asked = first << 32 | second
        found = np.full(len(asked), -1, np.int64)
        for factor, shift, slots in self.tables:
            at = slots[self._slot(asked, factor, shift)]
            hit = (at >= 0) & (self.keys[at] == asked)
            found[hit] = at[hit]
        return found

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words in a row, and where each word's begin (and the end).

        Each pass merges, in every word that still can, all places of its first
        pair in the order of merges; of places that overlap, the leftmost.
        """
        words = words.cast(pa.large_binary())
        sizes = pc.binary_length(words).to_numpy()
        if (sizes > LONG_BYTES).any():
            return self._with_long(words, sizes > LONG_BYTES)
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        token = self.byte_ids[data]
        word = np.repeat(np.arange(len(words)), np.diff(offsets))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        last = len(self.keys)
        while len(token):
            pair = np.full(len(token), -1, np.int64)
            same = word[1:] == word[:-1]
            pair[:-1][same] = self.find(token[:-1][same], token[1:][same])
            order = np.where(pair >= 0, self.order[pair], last)
            begins = np.flatnonzero(np.concatenate([[True], ~same]))
            least = np.minimum.reduceat(order, begins)
            sizes = np.diff(np.append(begins, len(token)))
            goes_on = np.repeat(least < last, sizes)
            if not goes_on.all():
                done.append((word[~goes_on], token[~goes_on]))
                word, token, pair, order = word[goes_on], token[goes_on], pair[goes_on], order[goes_on]
                sizes, least = sizes[least < last], least[least < last]
            if not len(token):
                break
            here = order == np.repeat(least, sizes)
            # Of a run of places that overlap each other, every second one.
            first = here & ~np.concatenate([[False], here[:-1]])
            run_start = np.maximum.accumulate(np.where(first, np.arange(len(here)), 0))
            here &= (np.arange(len(here)) - run_start) % 2 == 0
            token = np.where(here, self.merged[pair], token)
            stays = ~np.concatenate([[False], here[:-1]])
            word, token = word[stays], token[stays]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        word = np.concatenate([w for w, _ in done])
        token = np.concatenate([t for _, t in done])
        by_word = np.argsort(word, kind="stable")
        return token[by_word], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])


    def _with_long(self, words: pa.Array, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`encode` where some words go one by one."""
        others, at = self.encode(words.filter(pa.array(~long)))
        parts = iter(np.split(others, at[1:-1]) if (~long).any() else [])
        coded = [self.encode_long(word.as_py()) if is_long else next(parts) for word, is_long in zip(words, long.tolist(), strict=True)]
        return np.concatenate(coded), np.cumsum([0, *map(len, coded)])

    @functools.cached_property
    def _pairs(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.order.tolist(), self.merged.tolist(), strict=True), strict=True))

    def encode_long(self, word: bytes) -> np.ndarray:
        """The tokens of one word, from a heap of its pairs, so the work grows with n log n."""
        token = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n, pairs = len(token), self._pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            found = pairs.get(token[i] << 32 | token[after[i]]) if after[i] < n else None
            if found:
                heapq.heappush(heap, (found[0], i, token[i], token[after[i]], found[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, first, second, merged = heapq.heappop(heap)
            j = after[i]
            # Void if one of the two has been merged with something since.
            if token[i] != first or j >= n or token[j] != second:
                continue
            token[i], token[j], after[i] = merged, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([t for t in token if t >= 0], np.int64)


def read_ranks(path: str) -> dict[bytes, int]:
    """The pieces of a rank file, each with its rank, which is its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


@functools.cache
def merges_of_ranks(path: str) -> Merges:
    """Any two pieces merge if together they are a piece; its rank is the order."""
    ranks = read_ranks(path)
    pairs = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            first, second = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if first is not None and second is not None:
                pairs[first, second] = (rank, rank)
    return Merges(np.array([ranks[bytes([b])] for b in range(256)], np.int64), pairs)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


@functools.cache
def merges_of_tokenizer(path: str) -> Merges:
    """The listed merges of a byte-level BPE tokenizer file, in their order."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    ids = model["vocab"]
    pairs = {}
    for order, merge in enumerate(model["merges"]):
        first, second = merge if isinstance(merge, list) else merge.split(" ")
        pairs[ids[first], ids[second]] = (order, ids[first + second])
    return Merges(np.array([ids[c] for c in byte_letters()], np.int64), pairs)


class Encoder:
    """Tokens of whole texts.  Words seen before are looked up, up to `remember` of them."""

    def __init__(self, merges: Merges, known: dict[bytes, bytes] | None = None, remember: int = 150_000):
        self.merges = merges
        self.known = known or {}
        self.seen: dict[bytes, bytes] = {}
        self.remember = remember

    def _words(self, words: pa.Array) -> list[bytes]:
        """The tokens of each word as little-endian 32-bit numbers."""
        if len(self.seen) > self.remember:
            self.seen.clear()
        listed = words.to_pylist()
        coded = [self.known.get(w) or self.seen.get(w) for w in listed]
        new = [i for i, c in enumerate(coded) if c is None]
        if new:
            tokens, at = self.merges.encode(words.take(pa.array(new)))
            raw = tokens.astype("<u4").tobytes()
            for i, begin, end in zip(new, (4 * at[:-1]).tolist(), (4 * at[1:]).tolist(), strict=True):
                coded[i] = self.seen[listed[i]] = raw[begin:end]
        return coded

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts in a row, and where each text's begin (and the end)."""
        data, offsets = arrays.text_bytes(texts)
        starts = arrays.pretokens(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        distinct = as_words(data, starts).dictionary_encode()
        coded = self._words(distinct.dictionary)
        tokens = np.frombuffer(b"".join(coded), np.uint32)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) >> 2
        begins = np.cumsum(sizes) - sizes
        index = distinct.indices.to_numpy()
        size = sizes[index]
        ends = np.cumsum(size)
        gathered = tokens[np.repeat(begins[index] - (ends - size), size) + np.arange(ends[-1])]
        return gathered, np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]


def as_words(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The pieces that tile `data` and begin at `starts`."""
    ends = np.append(starts, len(data)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]
    )
